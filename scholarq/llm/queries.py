"""The registered queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scholarq.llm import chat_format, decontamination, importance, language_id, line_dedup, ngram_join, packing, pii, quality_rules, ranked_search, sharding, suffix_dedup, token_counts
from scholarq.llm.common import documents


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat_format.digests(chat_format.format_conversations(chat_format.with_probe(conversations)))


def op4_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.places(documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(documents(spark, sf_dir))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(documents(spark, sf_dir))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predictions(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(documents(spark, sf_dir))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(documents(spark, sf_dir))


def op11_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_jaccard_join, op2_benchmark_decontamination, op3_chat_formatting, op4_hilbert_sharding,
        op5_line_dedup, op6_packing, op7_pii, op8_language_id, op9_quality_rules, op10_token_counts, op11_ranked_lexical_search, op12_suffix_array_dedup, op13_importance_resampling)
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": ngram_join.SQL,
    "op3_chat_formatting": chat_format.SQL,
    "op5_line_dedup": line_dedup.SQL,
    "op9_quality_rules": quality_rules.SQL,
    "op11_ranked_lexical_search": ranked_search.SQL,
    "op13_importance_resampling": importance.SQL,
}
