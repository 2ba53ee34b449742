"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet into the shared folder and reads again as the next stage's ``docs``. All but the last
return the columns of ``documents``:

1. quality rules drop the documents they reject;
2. line dedup drops repeated lines from the texts (``n_chars`` follows the text);
3. n-gram Jaccard join keeps the smallest doc_id of each group of near copies;
4. benchmark decontamination drops documents that hold a benchmark item;
5. packing gives the pieces of what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarq.llm import decontamination, line_dedup, ngram_join, packing, quality_rules
from scholarq.llm.common import documents, stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pieces(docs)


STAGES = [
    ("quality_rules", good),
    ("line_dedup", fresh_lines),
    ("ngram_jaccard_join", one_copy),
    ("benchmark_decontamination", clean_of_benchmark),
    ("packing", packed),
]

#: SQL expresses neither the decontamination nor the tokens; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
