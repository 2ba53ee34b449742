"""Stand-in paper tables derived from the driver's test tables.

Each view is a lazy DataFrame over whole tables; the matching DuckDB SQL
(for the oracles) lives in ``scholarq.plans.oracle_views``.

- v_papers: one paper per order.
- v_mentions_raw: one entity mention per line item (the part it names).
  Parts with p_size <= 10 are named by their second word only, so that
  single-word entities exist for the fallback tiers.  Part types map to
  NER labels: STANDARD->PERSON, PROMO->ORG, ECONOMY->WORK_OF_ART.
- v_arxiv: one arXiv-style record per order, built from its line items.
- v_doc_text / v_docs: documents as paper texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarq.operators.mentions import build_mention_index
from scholarq.operators.search import point_lookup
from scholarq.sources.manifest import derive_paths


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    manifest = o.select(
        F.col("o_orderkey").alias("paper_id"),
        F.concat(F.lit("paper-"), F.col("o_orderkey").cast("string")).alias("paper_name"),
        F.concat(F.lit("paper-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("paper_pdf"),
        F.col("o_orderdate").alias("published"),
        F.col("o_orderstatus").alias("status"),
    )
    return derive_paths(manifest)


def entity_name_of_part(p_name: Column, p_size: Column) -> Column:
    return F.when(p_size <= 10, F.element_at(F.split(p_name, " "), 2)).otherwise(p_name)


def label_of_part_type(p_type: Column) -> Column:
    return (F.when(p_type == "STANDARD", "PERSON")
            .when(p_type == "PROMO", "ORG")
            .when(p_type == "ECONOMY", "WORK_OF_ART")
            .otherwise(p_type))


def v_mentions_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    return (li.join(p, li.l_partkey == p.p_partkey)
            .select(F.col("l_orderkey").alias("paper_id"),
                    F.col("l_linenumber").alias("mention_no"),
                    entity_name_of_part(F.col("p_name"), F.col("p_size")).alias("entity_name"),
                    label_of_part_type(F.col("p_type")).alias("entity_type")))


def v_index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(papers, entities, papers_have_entities)."""
    entities, phe = build_mention_index(v_mentions_raw(spark, sf_dir))
    return v_papers(spark, sf_dir), entities, phe


def v_doc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(paper_id, text): the text of paper k is document k."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("paper_id"), "text")


def v_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def v_arxiv(spark: SparkSession, sf_dir: str, only: int | list[int] | None = None) -> DataFrame:
    """arXiv-style records: one per order (orders without lines have no
    authors, categories or versions).  ``only`` looks one paper (or a few) up before
    its record is built."""
    def pick(df, key):
        if isinstance(only, list):
            return df.filter(F.col(key).isin(only))
        return df if only is None else point_lookup(df, key, only)

    o = pick(table(spark, sf_dir, "orders"), "o_orderkey")
    li = pick(table(spark, sf_dir, "lineitem"), "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey",
                                                  "l_linenumber", "l_shipdate", "l_returnflag")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    d = pick(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("o_orderkey"),
                                                                  F.col("text").alias("abstract"))
    lines = (li.join(p, li.l_partkey == p.p_partkey)
             .join(s, li.l_suppkey == s.s_suppkey))
    parsed = F.when(F.col("l_returnflag") == "R", F.array(F.col("s_name"))).otherwise(
        F.array(F.col("s_name"), F.col("s_nationkey").cast("string")))
    # Orders have a handful of lines each, so the per-order lists are small.  The lines are dealt out as they
    # are and listed there: lists made before the shuffle hold one or two lines and are larger than these.
    per_order = lines.repartition("l_orderkey").groupBy("l_orderkey").agg(
        F.array_join(F.array_sort(F.collect_set("p_type")), " ").alias("categories"),
        F.array_sort(F.collect_set("s_name")).alias("authors"),
        F.array_join(F.array_sort(F.collect_set("p_name")), " ").alias("title_words"),
        F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"),
                                             parsed.alias("a")))).alias("_ap"),
        F.array_sort(F.collect_list(F.struct(
            F.col("l_linenumber").alias("n"),
            F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("version"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("created")))).alias("_v"),
        F.max("l_shipdate").alias("updated"),
    )
    pr, st = F.col("o_orderpriority"), F.col("o_orderstatus")
    update_date = (F.when((pr == "5-LOW") & (st == "F"), F.lit(""))
                   .when((pr == "5-LOW") & (st == "P"),
                         F.concat(F.year("o_orderdate").cast("string"), F.lit("-13-05")))
                   .when((pr == "4-NOT SPECIFIED") & (st == "P"), F.date_format("o_orderdate", "yyyy-M-d"))
                   .when((pr == "4-NOT SPECIFIED") & (st == "F"), F.lit(None).cast("string"))
                   .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    key = F.col("o_orderkey").cast("string")
    return (o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left")
            .join(d, "o_orderkey", "left")
            .select(
                F.concat(F.lit("ax"), key).alias("arxiv_id"),
                F.col("o_orderkey").alias("paper_id"),
                F.concat(F.lit("Study of "), F.coalesce(F.col("title_words"), F.lit("nothing"))).alias("title"),
                "abstract",
                F.coalesce(F.col("authors"), F.array().cast("array<string>")).alias("authors"),
                F.col("categories"),
                F.transform(F.col("_ap"), lambda x: x["a"]).alias("authors_parsed"),
                F.transform(F.col("_v"), lambda x: F.struct(x["version"].alias("version"),
                                                            x["created"].alias("created"))).alias("versions"),
                update_date.alias("update_date"),
                F.when(pr == "1-URGENT", F.concat(F.lit("10.1000/"), key))
                 .when(pr == "2-HIGH", F.lit("")).alias("doi"),
                F.when(st == "F", F.lit("CC-BY-4.0")).when(st == "O", F.lit("")).alias("license"),
                F.when(pr == "3-MEDIUM", F.concat(F.lit("J. Synth. "), F.year("o_orderdate").cast("string")))
                 .alias("journal_ref"),
                F.col("o_orderdate").alias("published"),
                F.coalesce(F.col("updated"), F.col("o_orderdate")).alias("updated"),
            ))
