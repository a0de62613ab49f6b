"""Cleaning pipeline over the documents; each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the
last return the columns of the documents; the last returns the packed pieces. Every row is judged by its
own text, whatever other rows share its doc_id or have none; a null doc_id stays only where no row of its
group has an id. Null texts have no language, so the first stage drops them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taproom.llm import decontaminate, exact_dedup, langid, packing, simhash
from taproom.llm.common import stored, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised: it has a letter and one language is likelier than all others."""
    return langid.drop_unidentified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their five-word shingles."""
    return simhash.drop_similar(docs)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, packed into sequences."""
    return packing.packed_documents(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", contaminated),
    ("best-fit packing", best_fit),
]
# Language scores, SimHash and token ids are not SQL: the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; the last one's rows are returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
