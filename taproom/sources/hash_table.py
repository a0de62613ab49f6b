"""Keyed tables of Parquet files under extendible hashing.

A bucket holds the rows whose hash ends in given bits; how many bits, its depth, differs from bucket to bucket. The
directory has one entry for each ending of the greatest depth, so it doubles when a bucket of that depth is split. A
write rewrites the buckets its keys fall in, splits those that would hold more rows than their capacity, and then
adds a version of the directory; a reader sees the newest version, whole. Files that only older versions name are
removed, but for the last few versions, which readers may still be at. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CAPACITY = 100_000  # rows of a bucket
KEPT = 3  # versions that stay readable; at least two, for a write that runs again starts from the one before its own
MAX_DEPTH = 40
VERSION = "seq long, writer string, depth int, ending long, part string, n long"


def _hash(key: tuple[str, ...]) -> Column:
    return F.xxhash64(*key).bitwiseAND(F.lit((1 << MAX_DEPTH) - 1))


def versions(spark: SparkSession, table: str) -> list[tuple[int, str]]:
    """(seq, writer) of the versions that are kept, oldest first."""
    try:
        rows = spark.read.schema(VERSION).json(f"{table}/directory-*").select("seq", "writer").distinct().collect()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return []
    return sorted((r["seq"], r["writer"]) for r in rows)


def directory(spark: SparkSession, table: str, before: str | None = None) -> tuple[int, list]:
    """Number and buckets (depth, ending, part, n) of the newest version, or of the newest that `before` did not write.

    The driver holds one line a bucket, as a table format holds one a file: rows of the table over the capacity.
    """
    held = [seq for seq, writer in versions(spark, table) if writer != before]
    if not held:
        return 0, []
    rows = spark.read.schema(VERSION).json(f"{table}/directory-{held[-1]:012d}-*")
    return held[-1], rows.collect()


def _files(table: str, buckets: list) -> list[str]:
    return [f"{table}/{b['part']}" for b in buckets if b["part"]]


def current(spark: SparkSession, table: str) -> DataFrame | None:
    """The rows of the newest version, or None before the first write."""
    _, buckets = directory(spark, table)
    files = _files(table, buckets)
    return spark.read.option("basePath", table).parquet(*files).drop("version") if files else None


def _removed(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def vacuum(spark: SparkSession, table: str, kept: int = KEPT) -> list[str]:
    """Remove all but the last versions of the directory, and the bucket folders that only they name."""
    held = versions(spark, table)
    old, live = held[:-kept], held[-kept:]
    if not old:
        return []

    def named(some):
        paths = [f"{table}/directory-{seq:012d}-{writer}" for seq, writer in some]
        rows = spark.read.schema(VERSION).json(paths).where(F.col("part").isNotNull())
        return {r["part"] for r in rows.select("part").distinct().collect()}

    dead = sorted(named(old) - named(live))
    for part in dead:
        _removed(spark, f"{table}/{part}")
    for seq, writer in old:
        _removed(spark, f"{table}/directory-{seq:012d}-{writer}")
    return dead


def _lines(spark: SparkSession, lines: list[tuple], **types: str) -> DataFrame:
    """Lines of the driver as a local table, whose size Spark knows."""
    columns = list(zip(*lines)) or [()] * len(types)
    return spark.createDataFrame(
        pa.table({name: pa.array(list(c), pa.type_for_alias(kind)) for (name, kind), c in zip(types.items(), columns)})
    )


def upsert(
    fresh: DataFrame,
    table: str,
    key: tuple[str, ...],
    merge: Callable[[DataFrame, DataFrame], DataFrame],
    writer: str,
    capacity: int = CAPACITY,
    kept: int = KEPT,
) -> list[str]:
    """Fold rows, one a key, into the table by `merge(old, new)`; returns the bucket folders it wrote.

    A write that runs again under the same name starts from the version before its own and replaces it.
    """
    spark = fresh.sparkSession
    seq, buckets = directory(spark, table, before=writer)
    buckets = buckets or [{"depth": 0, "ending": 0, "part": None, "n": 0}]
    deepest = max(b["depth"] for b in buckets)
    slots = [
        (b["ending"] + (i << b["depth"]), number)
        for number, b in enumerate(buckets) for i in range(1 << (deepest - b["depth"]))
    ]
    slot = _hash(key).bitwiseAND(F.lit((1 << deepest) - 1))
    entries = _lines(spark, slots, slot="int64", bucket="int64")
    # Spark sends the directory to the tasks as long as it is small, and shuffles both sides beyond.
    placed = fresh.withColumn("slot", slot).join(entries, "slot").drop("slot").persist()
    try:
        incoming = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}
        if not incoming:
            return []
        # A bucket that may grow beyond its capacity is split so far that its parts are half full.
        deeper = {}
        for number, more in incoming.items():
            most = buckets[number]["n"] + more
            bits = max(0, -(-2 * most // capacity) - 1).bit_length() if most > capacity else 0
            deeper[number] = min(buckets[number]["depth"] + bits, MAX_DEPTH)
        files = _files(table, [buckets[number] for number in incoming])
        rows = placed.drop("bucket")
        if files:
            rows = merge(spark.read.schema(rows.schema).parquet(*files), rows)
        depths = _lines(spark, [(s, deeper[number]) for s, number in slots if number in deeper], slot="int64", depth="int32")
        rows = rows.withColumn("slot", slot).join(depths, "slot").drop("slot")
        ending = _hash(key).bitwiseAND(F.expr("shiftleft(1L, depth) - 1"))
        rows = rows.withColumn("bucket", F.concat_ws("-", "depth", ending)).drop("depth")
        version = f"version={writer}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/{version}")
    finally:
        placed.unpersist()
    written = spark.read.option("basePath", f"{table}/{version}").schema("bucket string").parquet(f"{table}/{version}")
    counts = {r["bucket"]: r["count"] for r in written.groupBy("bucket").count().collect()}
    lines = [b for number, b in enumerate(buckets) if number not in incoming]
    lines = [(b["depth"], b["ending"], b["part"], b["n"]) for b in lines]
    for number in incoming:
        old, depth = buckets[number], deeper[number]
        for i in range(1 << (depth - old["depth"])):
            end = old["ending"] + (i << old["depth"])
            n = counts.get(f"{depth}-{end}", 0)
            lines.append((depth, end, f"{version}/bucket={depth}-{end}" if n else None, n))
    rows = _lines(
        spark, [(seq + 1, writer, *line) for line in lines],
        seq="int64", writer="string", depth="int32", ending="int64", part="string", n="int64",
    )
    rows.coalesce(1).write.mode("overwrite").json(f"{table}/directory-{seq + 1:012d}-{writer}")
    vacuum(spark, table, kept)
    return sorted(f"{version}/bucket={b}" for b in counts)
