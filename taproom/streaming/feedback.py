"""Append logs as streams: feedback ingest, current labels, rating upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.functions import text
from taproom.operators import feedback as labels
from taproom.operators import overlay
from taproom.sources import hash_table, tables

TEXT_LIMITS = {
    "venueId": 100, "query": 500, "sessionId": 100, "requestId": 100, "rankingVersion": 100,
    "datasetVersion": 100,
}
EVENT_TYPES = ("impression", "click", "save", "like", "dislike")


def checked(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Trimmed events with `rejectReason` (null when fine). Works on batches and streams."""
    # Event time has to be an instant for watermarks; logs without a zone are read as UTC.
    out = events.withColumn("recordedAt", F.col("recordedAt").cast("timestamp"))
    problems = [F.when(~F.col("eventType").isin(*EVENT_TYPES), F.lit("unknown event type"))]
    for name, limit in TEXT_LIMITS.items():
        if name not in events.columns:
            continue
        out = out.withColumn(name, text.strip(F.col(name)))
        problems.append(F.when(F.col(name) == "", F.lit(f"{name} must not be blank")))
        problems.append(F.when(F.length(name) > limit, F.lit(f"{name} is too long")))
    problems.append(
        F.when(~F.col("recommendationRank").between(1, 20), F.lit("rank must be between 1 and 20"))
    )
    known = venues.select("venueId").distinct().withColumn("_known", F.lit(True))
    problems.append(F.when(F.col("_known").isNull(), F.lit("unknown venue")))
    joined = out.join(known, "venueId", "left")
    return joined.withColumn("rejectReason", F.coalesce(*problems)).drop("_known")


def accepted(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Valid events of a batch, the earliest delivery of each eventId."""
    good = checked(events, venues).where(F.col("rejectReason").isNull()).drop("rejectReason")
    return tables.once(good, "eventId", "recordedAt")


def rejected(events: DataFrame, venues: DataFrame) -> DataFrame:
    """Events of a batch that break a rule, with the reason, each eventId once."""
    bad = checked(events, venues).where(F.col("rejectReason").isNotNull())
    return tables.once(bad, "eventId", "recordedAt")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint: another checkpoint is another stream."""
    return spark.read.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def ingest(stream: DataFrame, venues: DataFrame, target: str, rejects: str, checkpoint: str):
    """Start the ingest: every event lands exactly once, in the log or among the rejects.

    There is no watermark: however late an event comes, it is kept, and however late it comes again, it
    is known: Bloom filters beside the log tell where its id may lie, and those folders decide. A micro-batch
    that runs again replaces what it wrote.
    """

    def fold(batch: DataFrame, batch_id: int) -> None:
        name = f"{_stream_id(batch.sparkSession, checkpoint)}-{batch_id}"
        batch = batch.persist()
        try:
            tables.append_once(accepted(batch, venues), target, "eventId", name)
            tables.append_once(rejected(batch, venues), rejects, "eventId", name)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


RATING_KEY = ("userId", "venueId")


def rating_table(spark: SparkSession, table: str) -> DataFrame | None:
    """The current ratings, or None before the first write."""
    rows = hash_table.current(spark, table)
    return None if rows is None else rows.drop("bucket")


def _folded(stream: DataFrame, checkpoint: str, write):
    """Start a stream that hands each micro-batch to `write(batch, writer)`; the writer's name is that of the batch."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        write(batch, f"{_stream_id(batch.sparkSession, checkpoint)}-{batch_id}")

    return (
        stream.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def upsert_ratings_stream(stream: DataFrame, table: str, checkpoint: str, capacity: int = hash_table.CAPACITY):
    """Fold each micro-batch of ratings into a table laid out by extendible hashing.

    A batch rewrites only the buckets its keys fall in, and a bucket holds at most about `capacity` rows however
    large the table grows. A batch that runs again starts from the version before its own, and a stream with a new
    checkpoint goes on from the table as it is.
    """

    def write(batch: DataFrame, writer: str) -> None:
        fresh = overlay.latest_rating_per_key(batch)
        hash_table.upsert(fresh, table, RATING_KEY, overlay.merge_ratings, writer, capacity)

    return _folded(stream, checkpoint, write)


LABEL_KEY = ("sessionId", "queryKey", "venueId")


def label_table(spark: SparkSession, table: str) -> DataFrame | None:
    """The current labels, or None before the first write."""
    rows = hash_table.current(spark, table)
    return None if rows is None else rows.drop("bucket")


def upsert_labels_stream(stream: DataFrame, table: str, checkpoint: str, capacity: int = hash_table.CAPACITY):
    """Keep the last explicit label per (session, request, venue) in a table laid out by extendible hashing.

    The stream itself holds no state: a label lives in the table for good, and a batch reads and rewrites only the
    buckets its own keys fall in. Labels are compared by their time and id, so events may come late, out of order or
    again and the table is that of one aggregate over all of them. A batch without labels writes nothing.
    """

    def write(batch: DataFrame, writer: str) -> None:
        hash_table.upsert(labels.latest_labels(batch), table, LABEL_KEY, labels.newer_labels, writer, capacity)

    return _folded(stream, checkpoint, write)
