"""A corpus pipeline: quality filter, exact and near deduplication, benchmark decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns; the last returns
their tokens. run() writes each stage's result to the shared scratch folder and reads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import bpe, decontam, exact_dedup, near_dedup, quality
from lumenframe.llm.queries import table, vocabulary
from lumenframe.llm.shared import materialise, survivors


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose Bradley-Terry score reaches the threshold."""
    return quality.accepted(docs, quality.fit_on_labels(docs, table(spark, sf_dir, "labels")))


def exact_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, the one with the largest id."""
    return survivors(docs, exact_dedup.exact_duplicates(docs), "doc_id")


def near_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class, the document with the largest id."""
    return survivors(docs, near_dedup.near_duplicates(docs), "doc_id")


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each document, and the digests that show that decoding them gives its text."""
    return bpe.tokenised(docs, vocabulary(), outputs=("ids", "n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_filter),
    ("near_dedup", near_filter),
    ("decontamination", benchmark_filter),
    ("bpe", tokens),
]

#: Bit-parallel alignment, ranking and tokenising aren't expressible in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
