"""Evidence table, feedback log, training set and report sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.operators import quality
from taproom.operators.canonical import chunk_id
from taproom.session import cut
from taproom.sources import known_ids, schemas

FILE_ROWS = 250_000  # rows of a file of a log, about
BUCKET_ROWS = 250_000  # rows of the evidence table in one folder, about


def evidence_table(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Passages with id, vector, its dimension and length; equal passages are kept once.

    `vectors` has text and embedding: the user's model output, one row per distinct text.
    """
    stored = chunks.withColumn("chunkId", chunk_id()).dropDuplicates(["chunkId"])
    joined = stored.join(vectors, "text")
    squares = F.aggregate("embedding", F.lit(0.0), lambda state, value: state + value * value)
    return joined.withColumn("dimensions", F.size("embedding")).withColumn("norm", F.sqrt(squares))


def write_evidence(
    table: DataFrame, path: str, fingerprint: str, model: str, bucket_rows: int = BUCKET_ROWS
) -> None:
    """Replace the evidence table: bucketed by venue so that a candidate read prunes folders.

    The number of folders follows the number of rows, and a folder is written by several tasks, dealt
    by chunk, so that neither a large table nor a large venue is held up by one of them. The rows are
    made once, for their count and for the folders.
    """
    table = cut(table)
    meta = table.agg(
        F.count("*").alias("chunkCount"), F.countDistinct("venueId").alias("venueCount")
    ).withColumn("modelName", F.lit(model)).withColumn("fingerprint", F.lit(fingerprint))
    buckets = 1 + meta.first()["chunkCount"] // bucket_rows
    bucket = F.pmod(F.xxhash64("venueId"), F.lit(buckets)).cast("int")
    placed = table.withColumn("bucket", bucket).withColumn("_deal", F.pmod(F.xxhash64("chunkId"), F.lit(4)))
    placed = placed.repartition(int(4 * buckets), "bucket", "_deal").drop("_deal")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/chunks")
    meta.withColumn("buckets", F.lit(buckets)).write.mode("overwrite").json(f"{path}/metadata")


def read_evidence(spark: SparkSession, path: str, fingerprint: str | None = None) -> DataFrame:
    """Stored passages; a table built for another snapshot is refused."""
    if fingerprint is not None:
        stored = spark.read.json(f"{path}/metadata").first()["fingerprint"]
        if stored != fingerprint:
            raise ValueError("evidence table is stale: rebuild it for the current venues")
    return spark.read.parquet(f"{path}/chunks")


def candidate_chunks(chunks: DataFrame, candidates: DataFrame, buckets: int | None = None) -> DataFrame:
    """Only the passages of the candidate venues; `buckets` (see the table's metadata) prunes folders."""
    wanted = candidates.select("venueId").distinct()
    if buckets is not None:
        bucket = F.pmod(F.xxhash64("venueId"), F.lit(buckets)).cast("int")
        return chunks.join(wanted.withColumn("bucket", bucket), ["bucket", "venueId"], "left_semi")
    return chunks.join(wanted, "venueId", "left_semi")


def once(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the first by `order`, then by the other columns."""
    rest = [c for c in rows.columns if c not in (key, order)]
    first = rows.groupBy(key).agg(F.min(F.struct(order, *rest)).alias("_r"))
    return first.select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in rows.columns])


def append_once(rows: DataFrame, path: str, key: str, name: str) -> None:
    """Add the rows whose key the log at `path` does not hold yet, under the folder `name`.

    Bloom filters beside the log tell which keys it may hold; only the folders they point at are read, to decide
    exactly. What an earlier attempt wrote under the same name is replaced and not compared with.
    """
    spark = rows.sparkSession
    rows = rows.persist()
    try:
        n = rows.count()
        known_ids.merge_levels(spark, key, path, name)
        known = known_ids.known(rows.select(key), key, path, name)
        fresh = rows if known is None else rows.join(known, key, "left_anti")
        known_ids.announce(rows.select(key), key, path, name, n)
        buckets = known_ids.folders(n)
        placed = fresh.withColumn("idBucket", known_ids.folder_of(key, buckets))
        # The files of a bucket follow the size of the batch, not the number of tasks that found its rows.
        files = 1 + n // (buckets * FILE_ROWS)
        deal = F.pmod(F.xxhash64(F.lit(4), key), F.lit(files))
        placed = placed.coalesce(1) if buckets * files == 1 else placed.repartition(buckets * files, F.col("idBucket"), deal)
        placed.write.mode("overwrite").partitionBy("idBucket").parquet(f"{path}/batch={name}")
    finally:
        rows.unpersist()


def append_feedback(events: DataFrame, path: str) -> None:
    """Add events to the immutable log, each event id once."""
    append_once(once(events, "eventId", "recordedAt"), path, "eventId", uuid.uuid4().hex)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The log in insertion order."""
    return spark.read.schema(schemas.FEEDBACK).parquet(path).orderBy("recordedAt", "eventId")


def write_training_set(examples: DataFrame, path: str) -> None:
    examples.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """Small report table as JSON lines."""
    report.write.mode("overwrite").json(path)


def version_stamp(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Twelve characters of the table's fingerprint."""
    return quality.fingerprint(frame, columns).select(
        F.substring("fingerprint", 1, 12).alias("version")
    )
