"""Append logs that hold every id once: Bloom filters, levels of them, and look-ups of hit folders only."""

from pyspark.sql import functions as F

from taproom.sources import known_ids, tables

SCHEMA = "eventId string, value long"


def deliver(spark, path, name, ids):
    rows = spark.createDataFrame([(str(i), i) for i in ids], SCHEMA)
    tables.append_once(rows, path, "eventId", name)


def stored(spark, path):
    return sorted(int(r.eventId) for r in spark.read.schema(SCHEMA).parquet(path).collect())


def test_filters_hold_all_their_ids_and_few_others(spark, tmp_path):
    path = str(tmp_path / "log")
    ids = spark.range(30_000).select(F.col("id").cast("string").alias("eventId"))
    known_ids.announce(ids, "eventId", path, "a", 30_000)
    held = known_ids.filters(spark, path)
    assert [(f["name"], f["parts"], f["batches"]) for f in held] == [("a", 16, ["a"])]
    assert known_ids.possible(ids, "eventId", path, held).distinct().count() == 30_000
    others = spark.range(30_000, 90_000).select(F.col("id").cast("string").alias("eventId"))
    assert known_ids.possible(others, "eventId", path, held).count() < 300


def test_repeats_over_many_batches_land_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known_ids.merge_levels, "__defaults__", (3,))
    path = str(tmp_path / "log")
    monkeypatch.setattr(known_ids, "FOLDER_IDS", 8)
    for i in range(11):
        deliver(spark, path, f"b{i:02d}", [*range(i * 10, i * 10 + 12), *range(0, i * 10, 7)])
    assert stored(spark, path) == list(range(112))
    held = known_ids.filters(spark, path)
    assert max(f["level"] for f in held) == 2 and len(held) <= 5
    assert sorted(b for f in held for b in f["batches"]) == [f"b{i:02d}" for i in range(11)]


def test_a_batch_that_runs_again_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    deliver(spark, path, "a", range(10))
    deliver(spark, path, "b", range(5, 20))
    deliver(spark, path, "b", range(8, 25))
    assert stored(spark, path) == list(range(25))


def test_a_filter_without_rows_loses_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(str(i), i) for i in range(50)], SCHEMA)
    known_ids.announce(rows.select("eventId"), "eventId", path, "lost", 50)  # its writer died before the rows were written
    deliver(spark, path, "next", range(60))
    assert stored(spark, path) == list(range(60))


def test_folders_follow_the_size_of_a_batch():
    assert [known_ids.folders(n) for n in (0, 1999, 3999, 4000, 8000, 10**5, 10**9)] == [1, 1, 1, 2, 4, 32, 32]


def test_only_hit_folders_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(known_ids, "FOLDER_IDS", 100)
    path = str(tmp_path / "log")
    deliver(spark, path, "a", range(2000))
    deliver(spark, path, "b", range(2000, 4000))
    ids = spark.createDataFrame([("77",), ("999999",)], "eventId string")
    found = known_ids.known(ids, "eventId", path, "c")
    files = found.inputFiles()
    assert files and all("/batch=a/" in f for f in files) and len(files) <= 2
    fresh = spark.range(5000, 5020).select(F.col("id").cast("string").alias("eventId"))
    few = known_ids.known(fresh, "eventId", path, "c")
    assert few is None or len(few.inputFiles()) <= 2  # a foreign id passes a filter once in 2000 times


def test_null_and_empty_batches(spark, tmp_path):
    path = str(tmp_path / "log")
    deliver(spark, path, "empty", [])
    deliver(spark, path, "a", [1])
    assert stored(spark, path) == [1]
