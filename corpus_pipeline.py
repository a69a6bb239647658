"""The corpus pipeline: five operators in a row, each over all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import exact_dedup, ngram_join, packing, quality, secret_scan
from leafmill.llm.common import documents, saved, ship
from leafmill.llm.queries import WORD_BPE, vocabulary_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below its threshold go."""
    return quality.keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays."""
    ship(spark)
    return ngram_join.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, n_chars follows; every document stays."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences: one row per piece."""
    ship(spark)
    return packing.pack(docs, vocabulary_path(WORD_BPE))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", dedup_stage),
    ("n-gram Jaccard join", near_dup_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

#: The classifier and the packing can't be expressed in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs, f"stage{i}")
    return docs
