"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Only at start-up: long column expressions are built call by call, so no stack trace per call.
START_SETTINGS = {
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app: str = "taproom", master: str | None = None, **extra: str) -> SparkSession:
    """Start (or reuse) a session with the settings the jobs rely on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **START_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else started."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only on a local master without a setting."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="taproom-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(configured)
    return context.getCheckpointDir() or configured


def cut(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder and forget its lineage."""
    checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def sized(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared folder as Parquet and read it back, so a join knows how large it is before it deals
    the other side."""
    path = f"{checkpoint_dir(frame.sparkSession)}/sized-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame) -> DataFrame:
    """Deal rows that lie in fewer partitions than there are cores, before work that is costly a row.

    A small file of one row group is one task however many cores wait; tables of more partitions than
    cores are left as they are, so nothing is shuffled at scale.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)
