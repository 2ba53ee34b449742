"""The unified search over local papers and remote records."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarq.operators.unified import unified_search
from scholarq.plans.oracle_views import with_views
from scholarq.plans.q_mentions import ORG_MISSING, ROW_SQL, _ORG_LIKE, _parts_sql, _tiered_sql
from scholarq.plans.q_search import KW, _kw_pred, _page_sql
from scholarq.plans.registry import query
from scholarq.plans.views import v_arxiv, v_index

PAGE = 30
_LOCAL = _tiered_sql([f"SELECT {ROW_SQL} FROM v_rows WHERE entity_type = 'ORG' AND entity_name = '{ORG_MISSING}'",
                      _parts_sql("ORG", ["giant", "bolt"]), _ORG_LIKE.format(name=ORG_MISSING)])
_EXTRA = {
    "local": f"SELECT 'local' AS source, CAST(r.paper_id AS VARCHAR) AS key, a.title, 1.0::DOUBLE AS relevance_score "
             f"FROM ({_LOCAL}) r JOIN v_arxiv a ON a.paper_id = r.paper_id",
    "page": f"SELECT arxiv_id, title, relevance_score FROM ({_page_sql(_kw_pred(KW), n=PAGE)})",
}


def _searched(spark, d):
    papers, entities, phe = v_index(spark, d)
    records = v_arxiv(spark, d)
    titled = papers.drop("paper_name").join(records.select("paper_id", F.col("title").alias("paper_name")), "paper_id")
    cache = records.filter("paper_id % 2 = 0").select("arxiv_id", "title")
    return unified_search(titled, phe, entities, records, cache, "organisation", ORG_MISSING, KW, PAGE)


@query("unified_search", with_views(
    "SELECT * FROM local UNION ALL SELECT 'arxiv', arxiv_id, title, relevance_score FROM page WHERE title NOT IN (SELECT title FROM local)",
    "v_rows", "v_arxiv", extra=_EXTRA), "TOP4 REL1 FLT8 TOP3 PRJ6 (local tiers, remote page, known titles skipped)")
def unified(spark, d):
    return _searched(spark, d)[0]


@query("unified_to_store", with_views(
    "SELECT arxiv_id, title FROM page WHERE arxiv_id NOT IN (SELECT arxiv_id FROM v_arxiv WHERE paper_id % 2 = 0)",
    "v_rows", "v_arxiv", extra=_EXTRA), "JN7 FLT8 TOP3 (records of a search to store)")
def unified_store(spark, d):
    return _searched(spark, d)[1]
