"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.session import checkpoint_dir, tune

BATCH_ROWS = 1000  # rows in an Arrow batch: bounds what a Python task holds at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back: cuts lineage, survives executors."""
    spark = frame.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def most_frequent(frame: DataFrame, n: int, count: str, tie: str) -> list:
    """The n rows of largest count, then smallest `tie`, in this order.

    A histogram of the counts, in steps of a twelfth, first tells how large a count must be, so that
    about n rows in all, and not n of every task, are sent to the driver.
    """
    level = F.floor(F.log2(F.col(count).cast("double")) * 8)
    sizes = sorted(((r[0], r[1]) for r in frame.groupBy(level).count().collect()), reverse=True)
    least, held = None, 0
    for step, rows in sizes:
        least, held = step, held + rows
        if held >= n:
            break
    if least is None:
        return []
    return frame.where(level >= least).orderBy(F.desc(count), tie).limit(n).collect()


def rows_kept(docs: DataFrame, run, keeps) -> DataFrame:
    """The rows of `docs`, with all their columns, for which `keeps` is true; each row is decided on its own.

    `run` turns Arrow batches (doc_id, always null, and text) into batches with a row for each in the same
    order, and `keeps` turns one of these into a list of booleans.
    """
    asked_for = docs.columns.index("text")

    def filtered(batches):
        from collections import deque

        import pyarrow as pa

        waiting = deque()

        def asked():
            for batch in batches:
                waiting.append(batch)
                nobody, text = pa.nulls(batch.num_rows, pa.int64()), batch.column(asked_for).cast(pa.string())
                yield pa.RecordBatch.from_arrays([nobody, text], ["doc_id", "text"])

        marks = []
        for found in run(asked()):
            marks += keeps(found)
            while waiting and len(marks) >= waiting[0].num_rows:
                batch = waiting.popleft()
                mine, marks = marks[: batch.num_rows], marks[batch.num_rows :]
                yield batch.filter(pa.array(mine, pa.bool_()))

    return docs.mapInArrow(filtered, docs.schema)


def worker_cache() -> dict:
    """A dictionary that a reused Python worker keeps from task to task."""
    import sys
    import types

    name = "taproom_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def texts(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
