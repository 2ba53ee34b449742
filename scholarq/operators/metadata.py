"""Metadata statistics over arXiv-style snapshot records (C4).

AGG2-9, AGG15, TOP2, TOP8, FLT10.  Input columns: categories (space
separated string), authors_parsed (array<array<string>>), update_date
(string), versions (array<struct>), doi, license, journal_ref.
Each section is its own lazy aggregation; when several are requested,
``analyse`` caches the pruned input once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K = 20
SECTIONS = ("categories", "authors", "time", "all")


def top_k(counts: DataFrame, key: str, k: int = TOP_K, cnt: str = "n") -> DataFrame:
    """TOP2: k largest counts, ties by key ascending (TakeOrderedAndProject)."""
    return counts.orderBy(F.desc(cnt), F.asc(key)).limit(k)


def category_list() -> Column:
    """Categories split on whitespace (NULL = none)."""
    return F.filter(F.split(F.trim(F.coalesce(F.col("categories"), F.lit(""))), r"\s+"), lambda x: x != "")


def category_counts(records: DataFrame) -> DataFrame:
    """AGG2: categories split on whitespace, counted (NULL = none)."""
    return (records.select(F.explode(category_list()).alias("category"))
            .groupBy("category").agg(F.count(F.lit(1)).alias("n")))


def category_top(records: DataFrame, k: int = TOP_K) -> DataFrame:
    return top_k(category_counts(records), "category", k)


def distinct_count(counts: DataFrame, alias: str) -> DataFrame:
    """AGG3/AGG5: number of distinct keys (counted before any top-k cut)."""
    return counts.agg(F.count(F.lit(1)).alias(alias))


def share_of_total(counts: DataFrame, cnt: str = "n", digits: int = 2) -> DataFrame:
    """AGG15: percentage of the total per row; the total is a one-row
    aggregate joined by broadcast (one row by construction)."""
    total = counts.agg(F.sum(cnt).alias("_total"))
    return (counts.crossJoin(F.broadcast(total))
            .withColumn("pct", F.round(F.lit(100.0) * F.col(cnt) / F.col("_total"), digits))
            .drop("_total"))


def author_list() -> Column:
    """'last, first' of the authors_parsed entries with at least two parts."""
    listed = F.coalesce(F.col("authors_parsed"), F.array().cast("array<array<string>>"))
    return F.transform(F.filter(listed, lambda a: F.size(a) >= 2),
                       lambda a: F.concat_ws(", ", F.element_at(a, 1), F.element_at(a, 2)))


def author_counts(records: DataFrame) -> DataFrame:
    """AGG4: 'last, first' of authors_parsed entries with >= 2 parts; an
    author listed twice in one paper counts twice."""
    return (records.select(F.explode(F.coalesce(F.col("authors_parsed"),
                                                F.array().cast("array<array<string>>"))).alias("a"))
            .filter(F.size("a") >= 2)
            .select(F.concat_ws(", ", F.element_at("a", 1), F.element_at("a", 2)).alias("author"))
            .groupBy("author").agg(F.count(F.lit(1)).alias("n")))


def author_top(records: DataFrame, k: int = TOP_K) -> DataFrame:
    return top_k(author_counts(records), "author", k)


def parsed_year(update_date: Column) -> Column:
    """Year of a 'yyyy-m-d' date; blank or malformed -> NULL."""
    return F.year(F.try_to_timestamp(update_date, F.lit("y-M-d")))


def yearly_distribution(records: DataFrame) -> DataFrame:
    """AGG6 + TOP8: papers per update year, ascending."""
    return (records.select(parsed_year(F.col("update_date")).cast("long").alias("year"))
            .filter(F.col("year").isNotNull())
            .groupBy("year").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("year"))


def version_distribution(records: DataFrame, strict_skip: bool = False) -> DataFrame:
    """AGG7 + TOP8: papers per number of versions (missing -> 0).

    strict_skip=True also drops records whose non-empty update_date does not
    parse (the reference's loop skips the rest of such a record)."""
    r = records
    if strict_skip:
        d = F.col("update_date")
        bad = d.isNotNull() & (d != "") & parsed_year(d).isNull()
        r = r.filter(~bad)
    return (r.select(F.coalesce(F.size("versions"), F.lit(0)).cast("long").alias("n_versions"))
            .groupBy("n_versions").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("n_versions"))


def present(c: Column) -> Column:
    """FLT10: a value counts as present when it is non-NULL and non-empty."""
    return c.isNotNull() & (c != "")


def coverage_stats(records: DataFrame) -> DataFrame:
    """AGG8: one global aggregate (partial per task, one final row)."""
    return records.agg(
        F.count(F.lit(1)).alias("total_papers"),
        F.count_if(present(F.col("doi"))).alias("papers_with_doi"),
        F.count_if(present(F.col("license"))).alias("papers_with_license"),
        F.count_if(present(F.col("journal_ref"))).alias("papers_with_journal_ref"),
    )


def analyse(records: DataFrame, section: str = "all") -> dict[str, DataFrame]:
    """AGG9: the requested sections as named lazy DataFrames; each scans only
    the columns it needs.  Nothing is held in memory: persist ``records``
    yourself where several sections of an expensive source are wanted."""
    if section not in SECTIONS:
        raise ValueError(f"type must be one of {SECTIONS}")
    cols = ["categories", "authors_parsed", "update_date", "versions", "doi", "license", "journal_ref"]
    r = records.select(*cols)
    out: dict[str, DataFrame] = {}
    if section in ("categories", "all"):
        cc = category_counts(r)
        out["category_distribution"] = top_k(cc, "category")
        out["total_categories"] = distinct_count(cc, "total_categories")
    if section in ("authors", "all"):
        ac = author_counts(r)
        out["top_authors"] = top_k(ac, "author")
        out["total_authors"] = distinct_count(ac, "total_authors")
    if section in ("time", "all"):
        out["yearly_distribution"] = yearly_distribution(r)
        out["version_distribution"] = version_distribution(r)
    if section == "all":
        out["basic_stats"] = coverage_stats(r)
    return out
