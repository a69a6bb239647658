"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import additive_quantisation, bpe, exact_dedup, hyperminhash, language_id, ngram_join, packing, periodic_runs, pii, quality, secret_scan, sharding, yinyang
from .common import documents, ship

#: Vocabulary files of public tokenizers, by name in the package that holds them.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), vocabulary_path(BYTE_BPE))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive_quantisation.nearest(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary_path(WORD_BPE))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang.cluster(ship(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.join(documents(spark, sf_dir))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.detect(documents(spark, sf_dir), plant=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_secret_scan, op2_bpe, op3_exact_dedup, op4_language_id, op5_ngram_join, op6_sharding, op7_nearest, op8_packing, op9_pii, op10_quality, op11_yinyang, op12_hyperminhash, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    near = ngram_join.oracle(hyperminhash.WORDS, hyperminhash.PERCENT)
    return {
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op5_ngram_join": ngram_join.oracle(),
        "op11_yinyang": yinyang.oracle(),
        "op12_hyperminhash": f"SELECT *, doc_id = component_id AS kept FROM ({near})",
        "op13_periodic_runs": periodic_runs.ORACLE,
    }
