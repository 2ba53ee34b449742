"""The unified search: local papers by entity, then remote records, merged.

TOP4 + REL1 + TOP5 (local tiers, shape and relevance), FLT8/REL2/TOP3 (remote search), skip of known
titles, JN7 (records to store), PRJ6 (one list tagged by source).  The result feeds ``clustering``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.operators.local_search import local_search, shape_local_results
from scholarq.operators.search import author_search_with_fallback, search_page, to_store


def unified_search(papers: DataFrame, phe: DataFrame, entities: DataFrame, records: DataFrame, cache: DataFrame,
                   entity_type: str, name: str, query: str = "", max_results: int = 10, limit: str = "all",
                   doc_text: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, records to store).

    Results are (source, key, title, relevance_score): the local papers that mention the entity, and one page
    of remote records -- by ``query`` where there is one, else by the entity's name (a person's as an author, with its
    variants) -- without those whose title a local paper has.  To store are the page's records that ``cache`` lacks.
    """
    rows = local_search(papers, phe, entities, entity_type, name, limit)
    local = shape_local_results(rows, entity_type, name, doc_text).select(
        F.lit("local").alias("source"), F.col("paper_id").cast("string").alias("key"), "title", "relevance_score")
    if query.strip():
        found = search_page(records, query, "keyword", 0, max_results)
    elif entity_type.lower() == "person":
        found = author_search_with_fallback(records, name, 0, max_results)
    else:
        found = search_page(records, name, "keyword", 0, max_results)
    new = found.join(local.select("title"), "title", "left_anti")
    remote = new.select(F.lit("arxiv").alias("source"), F.col("arxiv_id").alias("key"), "title", "relevance_score")
    return local.unionByName(remote), to_store(cache, found.select(*cache.columns))
