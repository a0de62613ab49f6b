"""Skew-safe exact deduplication: merge locally, then by salted digest, then globally.

Texts are equal when identical after deleting the six ASCII white-space characters. Every merge
compares the digest and the whole normalised text, so a digest collision merges nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taproom.llm.common import stored, table, texts

SALTS = 16
BLOCK_BYTES = 32 << 20  # text held by the local merge of one task


def _winner(length="n_points", doc="doc_id"):
    # The bitwise complement reverses the order of whole numbers without overflow; null loses.
    return F.struct(F.col(length).alias("n_points"), F.bitwise_not(F.col(doc)).alias("rev"))


def _local(block_bytes: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        def flush(groups):
            rows = list(groups.items())
            for at in range(0, len(rows), 2000):
                part = rows[at : at + 2000]
                yield pa.RecordBatch.from_pydict(
                    {
                        "digest": pa.array([hashlib.sha256(k).digest() for k, _ in part], pa.binary()),
                        "content": pa.array([k for k, _ in part], pa.binary()),
                        "n": pa.array([v[0] for _, v in part], pa.int64()),
                        "n_points": pa.array([v[1] for _, v in part], pa.int64()),
                        "doc_id": pa.array([v[2] for _, v in part], pa.int64()),
                    }
                )

        groups, held = {}, 0
        for batch in batches:
            ids, points = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for doc, text, n in zip(ids, texts(batch.column(1)), points):
                key = text.translate(None, b" \t\n\x0b\x0c\r")
                old = groups.get(key)
                if old is None:
                    groups[key] = [1, n, doc]
                    held += len(key) + 200
                else:
                    old[0] += 1
                    if n > old[1] or n == old[1] and doc is not None and (old[2] is None or doc < old[2]):
                        old[1:] = n, doc
            if held >= block_bytes:
                yield from flush(groups)
                groups, held = {}, 0
        yield from flush(groups)

    return run


def _digests(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        keys = [t.translate(None, b" \t\n\x0b\x0c\r") for t in texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(2),
                pa.array([hashlib.sha256(k).digest() for k in keys], pa.binary()),
            ],
            ["doc_id", "n_points", "digest"],
        )


def exact_groups(docs: DataFrame, salts: int = SALTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_points, digest, keep_id, group_size, kept.

    Null text counts as empty; all empty texts are one group. A null doc_id loses every tie. Rows that
    repeat a doc_id within a group are the same document and carry the same marks. Other columns of
    `docs` are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"),
    )
    local = rows.mapInArrow(
        _local(block_bytes), "digest binary, content binary, n long, n_points long, doc_id long"
    )
    salted = (
        local.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)))
        .groupBy("digest", "salt", "content")
        .agg(F.sum("n").alias("n"), F.max(_winner()).alias("best"))
    )
    merged = salted.repartition("digest").groupBy("digest", "content").agg(
        F.sum("n").alias("n"), F.max("best").alias("best")
    )
    groups = merged.groupBy("digest").agg(
        F.count("*").alias("contents"), F.max("n").alias("group_size"), F.max("best").alias("best")
    )
    checked = F.when(F.col("contents") > 1, F.raise_error(F.lit("two texts share one SHA-256")).cast("long"))
    groups = groups.select("digest", F.coalesce(checked, "group_size").alias("group_size"), "best")
    # Written, so that the join below reads two plain shuffles and its hot digests can be split.
    groups = stored(groups, "copies")
    members = rows.mapInArrow(_digests, "doc_id long, n_points long, digest binary")
    keep = F.bitwise_not(F.col("best.rev"))
    return members.join(groups, "digest").select(
        "doc_id", "n_points", "digest", keep.alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(keep) & (F.col("n_points") == F.col("best.n_points"))).alias("kept"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns, whatever those are called.

    Of equal texts the row with the most code points stays, then that of the smallest doc_id; of rows alike
    in both, one. A null doc_id loses every tie of length.
    """
    digest = F.unhex(F.sha2(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \\t-\\r]", ""), 256))
    length = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    # One key, compared with its nulls: rows of a key lie together after the join, so dropping repeats shuffles nothing.
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), length.alias("n_points"), digest.alias("digest"))
    kept = exact_groups(docs).where("kept").select(F.struct("doc_id", "n_points", "digest").alias("key"))
    rows = docs.select(key.alias("key"), F.struct("*").alias("row"))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact groups of all documents."""
    return exact_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


SQL = """
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]', '', 'g') AS norm
  FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY len DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM n
"""
