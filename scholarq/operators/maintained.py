"""Metadata statistics kept up to date (AGG2-8).

A batch of new or replaced records changes the stored counts by its difference: what a replaced
record counted before is retracted, what it counts now is added.  Two tables of runs hold the state:
``state`` the contributions of each record (its categories, authors, year, number of versions and
filled fields), ``counts`` the number of records for each section and value.  A batch looks up its own keys
only; the records themselves are never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarq.operators import metadata as M
from scholarq.operators.delta import DeltaRuns

PART = T.StructType([T.StructField("section", T.StringType()), T.StructField("value", T.StringType())])
FIELDS = {"papers_with_doi": "doi", "papers_with_license": "license", "papers_with_journal_ref": "journal_ref"}


def contributions(records: DataFrame, key: str, *keep: str) -> DataFrame:
    """(key, parts) and the columns ``keep``: the counts that a record takes part in, one (section, value) for each; an author listed
    twice is there twice.  Records without a key are left out, as nothing could retract them."""
    def part(section, value):
        return F.struct(F.lit(section).alias("section"), value.cast("string").alias("value"))

    def when(condition, section, value):
        return F.when(condition, F.array(part(section, value))).otherwise(F.array().cast(T.ArrayType(PART)))

    year = M.parsed_year(F.col("update_date"))
    parts = F.concat(
        F.transform(M.category_list(), lambda c: part("category", c)),
        F.transform(M.author_list(), lambda a: part("author", a)),
        when(year.isNotNull(), "year", year),
        F.array(part("versions", F.coalesce(F.size("versions"), F.lit(0))), part("basic", F.lit("total_papers"))),
        *[when(M.present(F.col(c)), "basic", F.lit(name)) for name, c in FIELDS.items()])
    return records.filter(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), parts.alias("parts"), *keep)


class MaintainedStatistics:
    """Counts under ``root``, fed with batches of rising numbers; a replayed batch changes nothing.

    Defined cases: a record that comes again replaces the stored one, whatever its fields; of a record's rows in one
    batch the one with the largest ``order_col`` counts (without it the largest row); a value that no record has any
    more is not listed; an empty batch changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "arxiv_id", fanout: int = 8):
        self.key = key
        self.state = DeltaRuns(spark, f"{root}/state", T.StructType([
            T.StructField("key", T.StringType()), T.StructField("parts", T.ArrayType(PART))]), ["key"], fanout=fanout)
        self.counts = DeltaRuns(spark, f"{root}/counts", T.StructType([
            *PART.fields, T.StructField("n", T.LongType())]), ["section", "value"], add="n", fanout=fanout)

    def apply(self, batch: int, records: DataFrame, order_col: str | None = None) -> None:
        """Take in a batch.  The state is written first and the difference taken from the written runs, so that a batch
        that failed halfway is completed by its replay and ``records`` is computed once."""
        if self.counts.has(batch):
            return
        self.state.append(batch, contributions(records, self.key, *([order_col] if order_col else [])), order_col)
        new = self.state.run(batch)
        old = self.state.read(before=batch, keys=new)
        signed = (new.select(F.explode_outer("parts").alias("p"), F.lit(1).alias("n"))
                  .unionByName(old.select(F.explode_outer("parts").alias("p"), F.lit(-1).alias("n"))))
        delta = signed.groupBy("p.section", "p.value").agg(F.sum("n").alias("n")).filter("n <> 0 AND section IS NOT NULL")
        self.counts.append(batch, delta)
        self.state.compact()
        self.counts.compact()

    def values(self) -> DataFrame:
        """(section, value, n) of everything that is counted."""
        return self.counts.read().filter("n <> 0")

    def analyse(self) -> dict[str, DataFrame]:
        """AGG9 from the stored counts: the frames of ``metadata.analyse``."""
        def of(section, name, kind="string"):
            return self.values().filter(F.col("section") == section).select(F.col("value").cast(kind).alias(name), "n")

        categories, authors = of("category", "category"), of("author", "author")
        basic = self.values().filter("section = 'basic'").agg(*[
            F.coalesce(F.sum(F.when(F.col("value") == name, F.col("n"))), F.lit(0)).alias(name)
            for name in ["total_papers", *FIELDS]])
        return {
            "category_distribution": M.top_k(categories, "category"),
            "total_categories": M.distinct_count(categories, "total_categories"),
            "top_authors": M.top_k(authors, "author"),
            "total_authors": M.distinct_count(authors, "total_authors"),
            "yearly_distribution": of("year", "year", "long").orderBy("year"),
            "version_distribution": of("versions", "n_versions", "long").orderBy("n_versions"),
            "basic_stats": basic,
        }
