"""Record search, paging, author fallbacks and result merging (C3).

FLT6-8, REL2, TOP3, TOP5-7, STR1, AGG11, SET1, SET2, JN6, JN7, PRJ4-7.
Records: arxiv_id, title, abstract, authors array<string>, categories
(space-separated string), published timestamp.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarq.functions.names import surname_first, without_dots
from scholarq.operators.tiers import first_nonempty

SEARCH_TYPES = ("keyword", "author", "title")
PDF_BASE = "https://arxiv.org/pdf/"
ABS_MARK = "/abs/"


def id_from_url(url: Column) -> Column:
    """PRJ7: the id is the text after '/abs/'."""
    return F.element_at(F.split(url, ABS_MARK), -1)


def pdf_url(arxiv_id: Column) -> Column:
    """PRJ7: pdf link of an id."""
    return F.concat(F.lit(PDF_BASE), arxiv_id, F.lit(".pdf"))


def _haystack() -> Column:
    return F.lower(F.concat_ws(" ", F.col("title"), F.col("abstract"),
                               F.array_join(F.col("authors"), " "), F.col("categories")))


def keyword_match(q: str) -> Column:
    """FLT8 keyword: every whitespace token of q occurs in title, abstract,
    authors or categories (case-insensitive)."""
    toks = [t for t in q.lower().split() if t]
    if not toks:
        return F.lit(True)
    hay = _haystack()
    return reduce(lambda a, b: a & b, [F.instr(hay, t) > 0 for t in toks])


def author_match(q: str) -> Column:
    ql = q.lower()
    return F.exists(F.col("authors"), lambda a: F.instr(F.lower(a), ql) > 0)


def title_match(q: str) -> Column:
    return F.instr(F.lower(F.col("title")), q.lower()) > 0


def author_relevance(q: str) -> Column:
    """REL2: 1.0 exact author, 0.8 partial, else 0.4."""
    ql = q.lower()
    return (F.when(F.exists(F.col("authors"), lambda a: F.lower(a) == ql), 1.0)
            .when(F.exists(F.col("authors"), lambda a: F.instr(F.lower(a), ql) > 0), 0.8)
            .otherwise(0.4))


def search(records: DataFrame, q: str, search_type: str = "keyword") -> DataFrame:
    """Matching records with relevance and pdf link (not yet paged)."""
    if search_type not in SEARCH_TYPES:
        raise ValueError(f"search_type must be one of {SEARCH_TYPES}")
    pred = {"keyword": keyword_match, "author": author_match, "title": title_match}[search_type](q)
    rel = author_relevance(q) if search_type == "author" else F.lit(1.0)
    return (records.filter(pred)
            .withColumn("relevance_score", rel)
            .withColumn("pdf_url", pdf_url(F.col("arxiv_id"))))


def page(df: DataFrame, start: int = 0, max_results: int = 10, by_relevance: bool = False) -> DataFrame:
    """TOP3: newest first (relevance first for author searches), then a
    window of ``max_results`` rows from ``start``."""
    if start < 0 or max_results < 1:
        raise ValueError("start must be >= 0 and max_results >= 1")
    keys = [F.desc("published"), F.asc("arxiv_id")]
    if by_relevance:
        keys = [F.desc("relevance_score")] + keys
    return df.orderBy(*keys).offset(start).limit(max_results)


def search_page(records, q, search_type="keyword", start=0, max_results=10) -> DataFrame:
    return page(search(records, q, search_type), start, max_results, by_relevance=search_type == "author")


def search_total(records: DataFrame, q: str, search_type: str = "keyword") -> DataFrame:
    """AGG11: total number of matches (one-row aggregate)."""
    return search(records, q, search_type).agg(F.count(F.lit(1)).alias("total_results"))


def author_search_with_fallback(records: DataFrame, name: str, start: int = 0,
                                max_results: int = 10) -> DataFrame:
    """TOP4 over author-name variants: exact author search; surname-first
    for two-part names; dots removed when the name has dots; keyword search.
    The first tier that finds a record wins, whatever page of it is wanted, so
    a page past its end is empty.  The rows are a sorted page: by relevance,
    then newest first, then id."""
    names = [name]
    if " " in name and (sf := surname_first(name)) is not None:
        names.append(sf)
    if "." in name:
        names.append(without_dots(name))
    tiers = [lambda n=n: search(records, n, "author") for n in names]
    tiers.append(lambda: search(records, name, "keyword"))
    return page(first_nonempty(tiers), start, max_results, by_relevance=True)


def point_lookup(records: DataFrame, key: str, value) -> DataFrame:
    """FLT7: the record with this key.  ``key`` must be a stored column, so
    that the filter reaches the scan."""
    return records.filter(F.col(key) == F.lit(value))


def first_wins_union(*dfs: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """SET2/JN6: union of result lists keeping, per key, the row of the
    earliest list (later lists only add keys not yet present)."""
    tagged = [df.withColumn("_src", F.lit(i)) for i, df in enumerate(dfs)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    others = [c for c in u.columns if c not in (key, "_src")]
    # min_by is a partial aggregate: a key repeated in many lists is
    # combined in the map tasks before the shuffle.
    return (u.groupBy(key).agg(F.min_by(F.struct(*others), F.col("_src")).alias("_r"))
            .select(key, "_r.*"))


def cache_first(cache: DataFrame, source: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """JN7: the whole stored record when there is one, else the source's; a null
    in a stored record stays null.  ``to_store`` gives the records to save then."""
    cols = [c for c in source.columns if c != key]
    c = cache.select(key, F.struct(*cols).alias("_stored"))
    s = source.select(key, F.struct(*cols).alias("_found"))
    # a struct is null only where its side has no row
    return (c.join(s, key, "full_outer")
            .select(key, F.when(F.col("_stored").isNotNull(), F.col("_stored")).otherwise(F.col("_found")).alias("_r"))
            .select(key, "_r.*"))


def to_store(cache: DataFrame, source: DataFrame, key: str = "arxiv_id") -> DataFrame:
    """JN7 "then store it": the source's records whose key the cache lacks, one for each key."""
    others = [c for c in source.columns if c != key]
    missing = source.filter(F.col(key).isNotNull()).join(cache.select(key), key, "left_anti")
    return missing.groupBy(key).agg(F.min(F.struct(*others)).alias("_r")).select(key, "_r.*")


def category_filter(records: DataFrame, category: str) -> DataFrame:
    """FLT6 intent: records listing the category."""
    return records.filter(F.array_contains(F.split(F.coalesce(F.col("categories"), F.lit("")), r"\s+"),
                                           category))


def decode_list(json_col: Column) -> Column:
    """PRJ4: JSON text -> array<string>; malformed or NULL -> []."""
    v = F.try_parse_json(json_col)
    return F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))


def encode_record(*cols: str) -> Column:
    """PRJ5: record -> JSON text."""
    return F.to_json(F.struct(*cols))


def catalog_union(local: DataFrame, remote: DataFrame) -> DataFrame:
    """SET1 + PRJ6: local papers and remote records, different columns,
    tagged by source."""
    return (local.withColumn("source", F.lit("local"))
            .unionByName(remote.withColumn("source", F.lit("arxiv")), allowMissingColumns=True))


def order_mixed(df: DataFrame, *tie: str) -> DataFrame:
    """TOP7: newest first, records without a date last."""
    return df.orderBy(F.desc(F.coalesce(F.col("published").cast("string"), F.lit(""))), *tie)


def order_catalog(df: DataFrame, *tie: str) -> DataFrame:
    """TOP6: relevance descending, then newest first."""
    return df.orderBy(F.desc("relevance_score"), F.desc("published"), *tie)
