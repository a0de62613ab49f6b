"""Extendible hashing: splits, a doubling directory, writes that touch few buckets, removal of dead versions."""

from pathlib import Path

from pyspark.sql import functions as F

from taproom.operators import overlay
from taproom.sources import hash_table

KEY = ("userId",)


def newest(old, new):
    return overlay.upsert(old, new, ["userId"])


def rows(spark, ids, value):
    return spark.createDataFrame([(str(i), value) for i in ids], "userId string, value long")


def fold(spark, table, ids, value, writer, capacity=50, **options):
    return hash_table.upsert(rows(spark, ids, value), table, KEY, newest, writer, capacity, **options)


def content(spark, table):
    return {int(r.userId): r.value for r in hash_table.current(spark, table).collect()}


def well_formed(buckets, capacity):
    deepest = max(b["depth"] for b in buckets)
    slots = sorted(b["ending"] + (i << b["depth"]) for b in buckets for i in range(1 << (deepest - b["depth"])))
    assert slots == list(range(1 << deepest))  # every ending is in one bucket
    assert all(b["n"] <= capacity for b in buckets)


def test_a_table_that_grows_twentyfold(spark, tmp_path):
    table, want = str(tmp_path / "t"), {}
    sizes = []
    for turn in range(20):
        ids = range(turn * 100, turn * 100 + 100)
        fold(spark, table, ids, turn, f"w{turn}", capacity=60)
        want |= dict.fromkeys(ids, turn)
        _, buckets = hash_table.directory(spark, table)
        well_formed(buckets, 60)
        sizes.append(len(buckets))
        if turn % 7 == 6:
            assert content(spark, table) == want
    assert sizes[0] >= 2 and sizes[-1] >= 2000 / 60 and sum(b["n"] for b in buckets) == 2000
    touched = fold(spark, table, range(0, 2000, 200), 99, "ten", capacity=60)
    assert 0 < len(touched) <= 10
    _, after = hash_table.directory(spark, table)
    assert sum(b["n"] for b in after if b["part"] in touched) <= 10 * 60
    assert len({b["part"] for b in after} - {b["part"] for b in buckets}) == len(touched)
    assert content(spark, table) == want | dict.fromkeys(range(0, 2000, 200), 99)


def test_a_write_that_runs_again(spark, tmp_path):
    table = str(tmp_path / "t")
    fold(spark, table, range(80), 1, "a")
    fold(spark, table, range(40, 200), 2, "b")
    fold(spark, table, range(60, 210), 3, "b")  # the same write once more, with other rows: the first attempt is forgotten
    want = dict.fromkeys(range(60), 1) | dict.fromkeys(range(60, 210), 3)
    assert content(spark, table) == want
    assert [w for _, w in hash_table.versions(spark, table)] == ["a", "b"]


def test_dead_versions_go_and_kept_ones_stay(spark, tmp_path):
    table = str(tmp_path / "t")
    for turn in range(6):
        fold(spark, table, range(30), turn, f"w{turn}", kept=2)
    assert [w for _, w in hash_table.versions(spark, table)] == ["w4", "w5"]
    parts = {p.parent.parent.name for p in Path(table).glob("version=*/bucket=*/*.parquet")}
    assert parts == {"version=w4", "version=w5"}
    # What a reader of the version before has in hand is still there.
    _, old = hash_table.directory(spark, table, before="w5")
    assert all(Path(f).exists() for f in hash_table._files(table, old))


def test_empty_writes_nulls_and_one_key(spark, tmp_path):
    table = str(tmp_path / "t")
    assert hash_table.current(spark, table) is None
    assert fold(spark, table, [], 1, "none") == [] and hash_table.current(spark, table) is None
    null = spark.createDataFrame([(None, 5)], "userId string, value long")
    hash_table.upsert(null, table, KEY, newest, "null", 50)
    assert hash_table.current(spark, table).select("value").collect()[0][0] == 5
    fold(spark, table, [1], 7, "one")
    assert hash_table.current(spark, table).where(F.col("userId") == "1").first()["value"] == 7
