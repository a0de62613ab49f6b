"""Which ids a log holds already: Bloom filters beside the log, exact look-ups only where a filter says maybe.

A filter covers the ids of one or more batches and is a table of bitmaps: an id's hash picks one bitmap and seven
bits in it, so testing an id reads one row. Filters are merged by levels: as soon as a level has `FANOUT` of them,
one filter over all their batches takes their place, so an id is tested against a number of filters that follows
the logarithm of the number of batches. A filter is written before the rows it tells of; one that tells of rows
that were never written costs a look-up and nothing else. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "_ids"  # beside the batches; the underscore hides it from readers of the log
BITS = 32768  # of one bitmap
IDS = 2000  # of one bitmap, about: sixteen bits an id, one foreign id in 2000 passes
FANOUT = 8
ID_BUCKETS = 32  # folders of a large batch, by the last bits of the hash of the ids; a power of two
FOLDER_IDS = 2000  # of a folder, at least: a small batch has fewer folders, that is, fewer of the bits


def folders(n: int) -> int:
    """Folders of a batch of n ids."""
    return 1 << min(ID_BUCKETS.bit_length() - 1, max(0, (n // FOLDER_IDS).bit_length() - 1))


def folder_of(key: str, n: int) -> Column:
    """Folder of an id within a batch that has n: their number and its own."""
    return F.concat(F.lit(f"{n}-"), bucket_of(key, n))


def bucket_of(key: str, buckets: int = ID_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _bits(key: str) -> Column:
    """Seven places within a bitmap."""
    hashes = [F.xxhash64(F.lit(seed), key) for seed in (1, 2)]
    return F.array(*[F.shiftrightunsigned(hashes[i // 4], 15 * (i % 4)).bitwiseAND(F.lit(BITS - 1)) for i in range(7)])


def _part(key: str, parts) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), key), parts).cast("int")


def filters(spark: SparkSession, path: str) -> list:
    """The filters in force: name, level, parts, batches."""
    try:
        rows = spark.read.schema("name string, level int, parts int, batches array<string>, replaces array<string>").json(
            f"{path}/{FILTERS}/filter-*/about"
        ).collect()  # one row a filter: as many as the logarithm of the batches, and those that were replaced
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    gone = {name for row in rows for name in row["replaces"] or []}
    return [row for row in rows if row["name"] not in gone]


def _write(ids: DataFrame, key: str, n: int, path: str, name: str, level: int, batches: list[str], replaces: list[str]) -> None:
    spark = ids.sparkSession
    parts = 1 + n // IDS
    placed = ids.select(_part(key, F.lit(parts)).alias("part"), F.explode(_bits(key)).alias("bit"))
    maps = placed.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    folder = f"{path}/{FILTERS}/filter-{name}"
    # A bitmap is 4 kB: a thousand of them make a file.
    maps.coalesce(1 + parts // 1000).write.mode("overwrite").parquet(f"{folder}/maps")
    about = spark.range(1, numPartitions=1).select(
        F.lit(name).alias("name"), F.lit(level).alias("level"), F.lit(parts).alias("parts"),
        F.array(*map(F.lit, batches)).alias("batches"), F.array(*map(F.lit, replaces)).alias("replaces"),
    )
    about.write.mode("overwrite").json(f"{folder}/about")


def announce(ids: DataFrame, key: str, path: str, batch: str, n: int) -> None:
    """Write the filter of a batch that is about to be added; n is its number of ids."""
    _write(ids, key, n, path, batch, 0, [batch], [])


def merge_levels(spark: SparkSession, key: str, path: str, current: str, fanout: int = FANOUT) -> None:
    """Put one filter in the place of each full level; `current`, which may be written again, is left alone."""
    while True:
        held = [f for f in filters(spark, path) if current not in f["batches"]]
        levels = sorted({f["level"] for f in held})
        full = next((x for x in levels if sum(f["level"] == x for f in held) >= fanout), None)
        if full is None:
            return
        old = sorted((f for f in held if f["level"] == full), key=lambda f: f["name"])[:fanout]
        batches = sorted(b for f in old for b in f["batches"])
        ids = stored_ids(spark, key, path, batches)
        if ids is None:
            ids = spark.createDataFrame([], f"{key} string")
        _write(ids, key, ids.count(), path, uuid.uuid4().hex, full + 1, batches, [f["name"] for f in old])


def stored_ids(spark: SparkSession, key: str, path: str, batches: list[str], buckets: list[int] | None = None) -> DataFrame | None:
    """The ids of some batches, only of the named buckets (of ID_BUCKETS); None if there are no such files."""
    inner = "idBucket=*"
    if buckets is not None:
        # The bucket by fewer bits is the rest of the same number; a batch has folders of one number of bits.
        names = sorted({f"{1 << bits}-{b % (1 << bits)}" for b in buckets for bits in range(ID_BUCKETS.bit_length())})
        inner = f"idBucket={{{','.join(names)}}}"
    try:
        return spark.read.schema(f"{key} string").parquet(f"{path}/batch={{{','.join(batches)}}}/{inner}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None


def possible(ids: DataFrame, key: str, path: str, held: list) -> DataFrame:
    """(key, filter): ids that a filter may hold. An id is joined with one bitmap of each filter."""
    spark = ids.sparkSession
    tests = None
    for f in held:
        maps = spark.read.schema("part int, bits binary").parquet(f"{path}/{FILTERS}/filter-{f['name']}/maps")
        met = ids.select(key, _part(key, F.lit(f["parts"])).alias("part"), _bits(key).alias("at")).join(maps, "part")

        def is_set(at):
            byte = F.conv(F.hex(F.call_function("substring", "bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            return F.call_function("getbit", byte, at.bitwiseAND(F.lit(7)).cast("int")) == 1

        found = met.where(F.forall("at", is_set)).select(key, F.lit(f["name"]).alias("filter"))
        tests = found if tests is None else tests.unionByName(found)
    return tests


def known(ids: DataFrame, key: str, path: str, current: str) -> DataFrame | None:
    """Those of the distinct ids that batches other than `current` hold; None if no filter knows any.

    Only the buckets in which a filter knows an id are read, and of the batches only those it covers.
    """
    spark = ids.sparkSession
    held = [f for f in filters(spark, path) if f["batches"] != [current]]
    if not held:
        return None
    hits = possible(ids, key, path, held).select("filter", bucket_of(key).alias("bucket")).distinct()
    wanted: dict[str, list[int]] = {}
    for row in hits.collect():  # at most one row a filter and bucket
        wanted.setdefault(row["filter"], []).append(row["bucket"])
    out = None
    for f in held:
        if f["name"] in wanted:
            batches = [b for b in f["batches"] if b != current]
            rows = stored_ids(spark, key, path, batches, wanted[f["name"]])
            if rows is not None:
                out = rows if out is None else out.unionByName(rows)
    return out
