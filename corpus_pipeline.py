"""A cleaned, mixed and tokenised corpus from the documents table.

Each stage gets the rows that the one before has kept, read again from the Parquet
table it wrote to the shared folder, so a lost executor costs tasks and no stage.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cropline.llm.common import read
from cropline.llm.exact_dedup import exact_dedup
from cropline.llm.mixing import apply_mix
from cropline.llm.queries import pieces_of
from cropline.llm.simhash import near_dedup
from cropline.llm.toxicity import drop_toxic, fit_severity
from cropline.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose grade is more likely 0 than not. Labels come from ``sf_dir``."""
    return drop_toxic(docs, fit_severity(docs, read(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash neighbours, one document: that with the least id."""
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: none, once or twice."""
    return apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, once for each time it is: little-endian unsigned
    32-bit integers, their number and digest, and the digest of what they decode to."""
    return pieces_of(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("mixing", mixing),
    ("sentencepiece", tokens),
]

# Stages 1, 3 and 5 have no SQL form; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
