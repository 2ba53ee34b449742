"""Metadata-analysis queries over the v_arxiv records (C4)."""

from __future__ import annotations

from scholarq.operators import metadata as M
from scholarq.plans.oracle_views import with_views
from scholarq.plans.registry import query
from scholarq.plans.views import v_arxiv

_CATS = """(SELECT category, COUNT(*) AS n FROM (
              SELECT unnest(string_split_regex(trim(COALESCE(categories, '')), '\\s+')) AS category FROM v_arxiv)
            WHERE category <> '' GROUP BY category)"""
_AUTH = """(SELECT author, COUNT(*) AS n FROM (
              SELECT a[1] || ', ' || a[2] AS author FROM (SELECT unnest(authors_parsed) AS a FROM v_arxiv)
              WHERE len(a) >= 2) GROUP BY author)"""
_YEAR = "CAST(year(try_strptime(update_date, '%Y-%m-%d')) AS BIGINT)"


@query("category_top20", with_views(f"SELECT category, n FROM {_CATS} ORDER BY n DESC, category LIMIT 20",
                                    "v_arxiv"), "AGG2 TOP2")
def category_top20(spark, d):
    return M.category_top(v_arxiv(spark, d))


@query("category_share", with_views(
    f"SELECT category, n, round(100.0::DOUBLE * n / (SELECT SUM(n) FROM {_CATS}), 2) AS pct FROM {_CATS}", "v_arxiv"),
    "AGG15")
def category_share(spark, d):
    return M.share_of_total(M.category_counts(v_arxiv(spark, d)))


@query("category_distinct", with_views(f"SELECT COUNT(*) AS total_categories FROM {_CATS}", "v_arxiv"), "AGG3")
def category_distinct(spark, d):
    return M.distinct_count(M.category_counts(v_arxiv(spark, d)), "total_categories")


@query("author_top20", with_views(f"SELECT author, n FROM {_AUTH} ORDER BY n DESC, author LIMIT 20", "v_arxiv"),
       "AGG4 TOP2")
def author_top20(spark, d):
    return M.author_top(v_arxiv(spark, d))


@query("author_distinct", with_views(f"SELECT COUNT(*) AS total_authors FROM {_AUTH}", "v_arxiv"), "AGG5")
def author_distinct(spark, d):
    return M.distinct_count(M.author_counts(v_arxiv(spark, d)), "total_authors")


@query("yearly_dist", with_views(
    f"SELECT {_YEAR} AS year, COUNT(*) AS n FROM v_arxiv WHERE {_YEAR} IS NOT NULL GROUP BY 1 ORDER BY 1",
    "v_arxiv"), "AGG6 TOP8")
def yearly_dist(spark, d):
    return M.yearly_distribution(v_arxiv(spark, d))


@query("version_dist", with_views(
    "SELECT CAST(COALESCE(len(versions), 0) AS BIGINT) AS n_versions, COUNT(*) AS n FROM v_arxiv "
    "GROUP BY 1 ORDER BY 1", "v_arxiv"), "AGG7 TOP8")
def version_dist(spark, d):
    return M.version_distribution(v_arxiv(spark, d))


@query("version_dist_strict", with_views(
    "SELECT CAST(COALESCE(len(versions), 0) AS BIGINT) AS n_versions, COUNT(*) AS n FROM v_arxiv "
    f"WHERE NOT (update_date IS NOT NULL AND update_date <> '' AND {_YEAR} IS NULL) GROUP BY 1 ORDER BY 1",
    "v_arxiv"), "AGG7 (skip on malformed date)")
def version_dist_strict(spark, d):
    return M.version_distribution(v_arxiv(spark, d), strict_skip=True)


@query("coverage_stats", with_views(
    """SELECT COUNT(*) AS total_papers,
              CAST(count_if(doi IS NOT NULL AND doi <> '') AS BIGINT) AS papers_with_doi,
              CAST(count_if(license IS NOT NULL AND license <> '') AS BIGINT) AS papers_with_license,
              CAST(count_if(journal_ref IS NOT NULL AND journal_ref <> '') AS BIGINT) AS papers_with_journal_ref
       FROM v_arxiv""", "v_arxiv"), "AGG8 FLT10")
def coverage_stats(spark, d):
    return M.coverage_stats(v_arxiv(spark, d))
