"""Deep pages and stored sketches (TOP3, AGG3, AGG5, AGG11)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.operators import search as S
from scholarq.operators import sketches as K
from scholarq.operators.deep_pages import PageIndex
from scholarq.plans.oracle_views import with_views
from scholarq.plans.registry import query
from scholarq.plans.views import v_arxiv
from scholarq.session import scratch_path

_N = 10
_HAY = "lower(concat_ws(' ', title, abstract, array_to_string(authors, ' '), categories))"
_FOUND = f"SELECT arxiv_id, published, 0.0::DOUBLE AS rel FROM v_arxiv WHERE instr({_HAY}, 'promo') > 0"
_BY_AUTHOR = """SELECT arxiv_id, published, CASE WHEN list_contains(list_transform(authors, lambda a: lower(a)), 'supplier#000000001')
                       THEN 1.0 ELSE 0.8 END::DOUBLE AS rel
                FROM v_arxiv WHERE len(list_filter(authors, lambda a: lower(a) = 'supplier#000000001' OR instr(lower(a), 'supplier#00000001') > 0)) > 0"""


def _pages_sql(found: str) -> str:
    return f"""SELECT CAST(page AS BIGINT) AS page, CAST(place AS BIGINT) AS place, arxiv_id, total_results FROM (
                 SELECT arxiv_id, no // {_N} AS page, no % {_N} AS place, total_results FROM (
                   SELECT arxiv_id, row_number() OVER (ORDER BY rel DESC, published DESC NULLS LAST, arxiv_id) - 1 AS no,
                          count(*) OVER () AS total_results FROM ({found})))
               WHERE page IN (0, 10) OR page = (total_results - 1) // {_N}"""


def _pages(matches: DataFrame, spark, name: str, by_relevance: bool) -> DataFrame:
    path = scratch_path(spark, name)
    matches.write.parquet(path)  # the search runs once, its pages read what it found
    index = PageIndex(spark.read.parquet(path), by_relevance)
    last = (index.total - 1) // _N
    pages = []
    for no in sorted({0, 10, last} & set(range(last + 1))):
        # the rows of one page are numbered in their order
        rows = index.page(no * _N, _N).agg(F.collect_list("arxiv_id").alias("ids"))
        pages.append(rows.select(F.lit(no).cast("long").alias("page"), F.posexplode("ids").alias("place", "arxiv_id"))
                     .withColumn("place", F.col("place").cast("long")).withColumn("total_results", F.lit(index.total).cast("long")))
    return reduce(DataFrame.unionByName, pages)


@query("deep_pages", with_views(_pages_sql(_FOUND), "v_arxiv"), "TOP3 AGG11 (pages 0, 10 and the last one by place, with the total)")
def deep_pages(spark, d):
    return _pages(S.search(v_arxiv(spark, d), "promo", "keyword"), spark, "pages", by_relevance=False)


@query("deep_author_pages", with_views(_pages_sql(_BY_AUTHOR), "v_arxiv"), "TOP3 TOP5 REL2 AGG11 (ordered by relevance first)")
def deep_author_pages(spark, d):
    records = v_arxiv(spark, d)
    found = S.first_wins_union(S.search(records, "Supplier#000000001", "author"), S.search(records, "Supplier#00000001", "author"))
    return _pages(found, spark, "author-pages", by_relevance=True)


_MENTIONED = """SELECT strftime(published, '%Y') AS year, 'category' AS section,
                       unnest(list_filter(string_split_regex(trim(COALESCE(categories, '')), '\\s+'), lambda x: x <> '')) AS value FROM v_arxiv
                UNION ALL SELECT strftime(published, '%Y'), 'author', a[1] || ', ' || a[2]
                          FROM (SELECT published, unnest(authors_parsed) AS a FROM v_arxiv) WHERE len(a) >= 2"""


@query("distinct_sketches", with_views(
    f"""SELECT year, section, count(DISTINCT value) AS n, true AS within_bound FROM ({_MENTIONED}) GROUP BY year, section
        UNION ALL SELECT 'all', section, count(DISTINCT value), true FROM ({_MENTIONED}) GROUP BY section""", "v_arxiv"),
    "AGG3 AGG5 (exact counts of each year and of all years, and whether the merged sketches' estimates keep the stated bound)")
def distinct_sketches(spark, d):
    records = v_arxiv(spark, d)
    early = F.col("published") < F.lit("1998-03-10").cast("timestamp")
    path = scratch_path(spark, "sketches")
    # two batches share a month
    K.merged(K.monthly_sketches(records.filter(early)), K.monthly_sketches(records.filter(~early))).write.parquet(path)
    stored = spark.read.parquet(path)
    year = F.substring("month", 1, 4).alias("year")
    whole = F.lit("all").alias("year")
    values = K.mentioned(records)
    exact = (values.groupBy(year, "section").agg(F.count_distinct("value").alias("n"))
             .unionByName(values.groupBy(whole, "section").agg(F.count_distinct("value").alias("n"))))
    estimates = K.distinct_estimates(stored, year).unionByName(K.distinct_estimates(stored, whole))
    off = F.abs(F.col("estimate") - F.col("n"))
    return (exact.join(estimates, ["year", "section"], "left")
            .select("year", "section", "n", F.coalesce(off <= K.relative_bound() * F.col("n"), F.lit(False)).alias("within_bound")))
