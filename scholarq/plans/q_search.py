"""Record search, fallbacks, merging and catalog queries (C3)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.functions.names import surname_first_col, without_dots_col
from scholarq.operators import search as S
from scholarq.operators.text_index import TextIndex
from scholarq.plans.oracle_views import with_views
from scholarq.plans.registry import query
from scholarq.plans.views import table, v_arxiv, v_mentions_raw, v_papers
from scholarq.session import scratch_path, written

OUT = ["arxiv_id", "title", "authors", "categories", "published", "pdf_url", "relevance_score"]


def _out(df):
    return df.select("arxiv_id", "title", F.array_join("authors", "; ").alias("authors"), "categories",
                     F.col("published").cast("string").alias("published"), "pdf_url", "relevance_score")


_OUT_SQL = """arxiv_id, title, array_to_string(authors, '; ') AS authors, categories,
              CAST(published AS VARCHAR) AS published,
              'https://arxiv.org/pdf/' || arxiv_id || '.pdf' AS pdf_url"""
_HAY = "lower(concat_ws(' ', title, abstract, array_to_string(authors, ' '), categories))"


def _author_rel(q):
    q = q.lower()
    return (f"CASE WHEN list_bool_or(list_transform(authors, lambda a: lower(a) = '{q}')) THEN 1.0 "
            f"WHEN list_bool_or(list_transform(authors, lambda a: instr(lower(a), '{q}') > 0)) THEN 0.8 "
            "ELSE 0.4 END")


def _author_pred(q):
    return f"len(list_filter(authors, lambda a: instr(lower(a), '{q.lower()}') > 0)) > 0"


def _kw_pred(q):
    return " AND ".join(f"instr({_HAY}, '{t}') > 0" for t in q.lower().split())


def _page_sql(pred, rel="1.0", start=0, n=10, by_rel=False):
    order = ("relevance_score DESC, " if by_rel else "") + "published DESC, arxiv_id"
    return (f"SELECT * FROM (SELECT {_OUT_SQL}, CAST({rel} AS DOUBLE) AS relevance_score, published AS _p "
            f"FROM v_arxiv WHERE {pred}) ORDER BY {order.replace('published', '_p')} LIMIT {n} OFFSET {start}")


def _strip(sql):
    return f"SELECT {', '.join(OUT)} FROM ({sql})"


KW = "widget promo"


@query("keyword_search", with_views(_strip(_page_sql(_kw_pred(KW), start=5, n=10)), "v_arxiv"),
       "FLT8 TOP3 PRJ7")
def keyword_search(spark, d):
    return _out(S.search_page(v_arxiv(spark, d), KW, "keyword", start=5, max_results=10))


AU_PART = "Supplier#00000001"


@query("author_search", with_views(_strip(_page_sql(_author_pred(AU_PART), _author_rel(AU_PART), 0, 10, True)),
                                   "v_arxiv"), "FLT8 REL2 TOP3 TOP5")
def author_search(spark, d):
    return _out(S.search_page(v_arxiv(spark, d), AU_PART, "author", 0, 10))


AU_EXACT = "supplier#000000042"


@query("author_exact", with_views(_strip(_page_sql(_author_pred(AU_EXACT), _author_rel(AU_EXACT), 10, 20, True)),
                                  "v_arxiv"), "REL2 exact")
def author_exact(spark, d):
    return _out(S.search_page(v_arxiv(spark, d), AU_EXACT, "author", 10, 20))


TI = "red widget"


@query("title_search", with_views(_strip(_page_sql(f"instr(lower(title), '{TI}') > 0", start=0, n=15)), "v_arxiv"),
       "FLT8 title TOP3")
def title_search(spark, d):
    return _out(S.search_page(v_arxiv(spark, d), TI, "title", 0, 15))


@query("search_total", with_views(f"SELECT COUNT(*) AS total_results FROM v_arxiv WHERE {_kw_pred(KW)}", "v_arxiv"),
       "AGG11")
def search_total(spark, d):
    return S.search_total(v_arxiv(spark, d), KW, "keyword")


#: The columns that the searches read or return.
INDEXED = ["arxiv_id", "title", "abstract", "authors", "categories", "published"]


@query("index_keyword_search", with_views(_strip(_page_sql(_kw_pred(KW), start=5, n=10)), "v_arxiv"),
       "FLT8 TOP3 (keyword search through an inverted index)")
def index_keyword_search(spark, d):
    index = TextIndex.build(v_arxiv(spark, d).select(*INDEXED), scratch_path(spark, "records"))
    return _out(S.page(index.search(KW), 5, 10))


# Words, parts of words, phrases across words, nothing found.
SEARCHES = [("keyword", "promo"), ("keyword", "Widget ECON 00000001"), ("keyword", "standard the lorem"), ("keyword", "zzqx"),
            ("keyword", "e"), ("author", "Supplier#00000001"), ("author", "#00"), ("title", "red widget"), ("title", "of b"), ("title", "dy of")]


def _search_pred(kind, q):
    return {"keyword": _kw_pred, "author": _author_pred, "title": lambda t: f"instr(lower(title), '{t.lower()}') > 0"}[kind](q)


@query("index_searches", with_views(" UNION ALL ".join(
    f"SELECT '{k}: {q}' AS search, arxiv_id, CAST({_author_rel(q) if k == 'author' else 1.0} AS DOUBLE) AS relevance_score "
    f"FROM v_arxiv WHERE {_search_pred(k, q)}" for k, q in SEARCHES), "v_arxiv"),
    "FLT8 REL2 (keyword, author and title searches through an inverted index, all matches)")
def index_searches(spark, d):
    index = TextIndex.build(v_arxiv(spark, d).select(*INDEXED), scratch_path(spark, "records"))
    found = [index.search(q, k).select(F.lit(f"{k}: {q}").alias("search"), "arxiv_id", "relevance_score") for k, q in SEARCHES]
    return reduce(DataFrame.unionByName, found)


AU_DOTTED = "Supplier#000000017."


def _built(records):
    """The records with the columns that the searches read, built once: every tier reads them."""
    return written(records.select(*INDEXED), "records")[0]


def _tiered(tiers):
    u = " UNION ALL ".join(f"SELECT *, {i} AS tier FROM ({t})" for i, t in enumerate(tiers))
    return f"SELECT * EXCLUDE (tier) FROM ({u}) WHERE tier = (SELECT min(tier) FROM ({u}))"


@query("author_fallback", with_views(_strip(_tiered([
    _page_sql(_author_pred(AU_DOTTED), _author_rel(AU_DOTTED), 0, 10, True),
    _page_sql(_author_pred("Supplier#000000017"), _author_rel("Supplier#000000017"), 0, 10, True),
    _page_sql(_kw_pred(AU_DOTTED), "1.0", 0, 10)])), "v_arxiv"), "TOP4 STR1 (author variants)")
def author_fallback(spark, d):
    return _out(S.author_search_with_fallback(_built(v_arxiv(spark, d)), AU_DOTTED, 0, 10))


# Pages within and past the end of the winning tier: the second tier has fewer matches than the keyword tier.
PAGES = [0, 3, 10_000_000]


@query("author_fallback_pages", with_views(" UNION ALL ".join(
    f"SELECT {start}::BIGINT AS start, count(*) AS n_rows FROM ({_strip(_page_sql(_author_pred('Supplier#000000017'), start=start))})"
    for start in PAGES), "v_arxiv"), "TOP4 TOP3 (a page past the end is empty)")
def author_fallback_pages(spark, d):
    r = _built(v_arxiv(spark, d))
    return reduce(DataFrame.unionByName, [
        S.author_search_with_fallback(r, AU_DOTTED, start, 10).agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(start).cast("long").alias("start"), "n_rows") for start in PAGES])


AU_FIRST, AU_SURNAME_FIRST = "000000017 Supplier", "Supplier, 000000017"
_RANKED = "SELECT CAST(row_number() OVER (ORDER BY {keys}) AS BIGINT) AS rank, arxiv_id, relevance_score FROM ({rows})"


def _ranked(page, *cols):
    """A page in its own order, numbered: one partition holds a page."""
    return page.coalesce(1).select((F.monotonically_increasing_id() + 1).alias("rank"), *cols)


@query("author_fallback_ranked", with_views(_RANKED.format(
    keys="relevance_score DESC, published DESC, arxiv_id",
    rows=_strip(_page_sql(_author_pred("Supplier#000000017"), _author_rel("Supplier#000000017"), 0, 10, True))), "v_arxiv"),
    "TOP4 TOP5 STR1 (order of the fallback's rows)")
def author_fallback_ranked(spark, d):
    return _ranked(S.author_search_with_fallback(_built(v_arxiv(spark, d)), AU_DOTTED, 0, 10), "arxiv_id", "relevance_score")


@query("author_surname_first", with_views(_RANKED.format(
    keys="relevance_score DESC, published DESC, arxiv_id",
    rows=_strip(_page_sql(_author_pred(AU_SURNAME_FIRST), _author_rel(AU_SURNAME_FIRST), 0, 10, True)).replace("v_arxiv", "v_comma")),
    "v_arxiv", extra={"v_comma": "SELECT * REPLACE (list_transform(authors, lambda a: replace(a, '#', ', ')) AS authors) FROM v_arxiv"}),
    "TOP4 STR1 (the surname-first tier wins)")
def author_surname_first(spark, d):
    r = v_arxiv(spark, d).withColumn("authors", F.transform("authors", lambda a: F.replace(a, F.lit("#"), F.lit(", "))))
    return _ranked(S.author_search_with_fallback(_built(r), AU_FIRST, 0, 10), "arxiv_id", "relevance_score")


@query("catalog_ranked", with_views(
    """SELECT CAST(row_number() OVER (ORDER BY published DESC, arxiv_id) AS BIGINT) AS rank, arxiv_id
       FROM v_arxiv ORDER BY rank LIMIT 40""", "v_arxiv"), "TOP7 (top-k report in order)")
def catalog_ranked(spark, d):
    local = v_papers(spark, d).select("paper_id", F.col("paper_name").alias("title"))
    remote = v_arxiv(spark, d).select("arxiv_id", "title", F.col("published").cast("string").alias("published"))
    return _ranked(S.order_mixed(S.catalog_union(local, remote), "arxiv_id", "paper_id").limit(40), "arxiv_id")


@query("author_variants", with_views(
    """SELECT entity_name AS name,
              CASE WHEN len(string_split_regex(trim(entity_name), '\\s+')) = 2
                   THEN string_split_regex(trim(entity_name), '\\s+')[2] || ', '
                        || string_split_regex(trim(entity_name), '\\s+')[1] END AS surname_first,
              trim(replace(replace(entity_name, '.', ' '), '  ', ' ')) AS without_dots
       FROM (SELECT DISTINCT entity_name FROM v_mentions_raw)""", "v_mentions_raw"), "STR1")
def author_variants(spark, d):
    names = v_mentions_raw(spark, d).select(F.col("entity_name").alias("name")).distinct()
    return names.select("name", surname_first_col(F.col("name")).alias("surname_first"),
                        without_dots_col(F.col("name")).alias("without_dots"))


@query("category_filter", with_views(
    "SELECT arxiv_id, categories FROM v_arxiv "
    "WHERE list_contains(string_split_regex(COALESCE(categories, ''), '\\s+'), 'PROMO')", "v_arxiv"), "FLT6")
def category_filter(spark, d):
    return S.category_filter(v_arxiv(spark, d), "PROMO").select("arxiv_id", "categories")


@query("point_lookup", with_views(
    f"SELECT {_OUT_SQL}, 1.0::DOUBLE AS relevance_score FROM v_arxiv WHERE arxiv_id = 'ax42'", "v_arxiv"), "FLT7")
def point_lookup(spark, d):
    r = v_arxiv(spark, d, only=42)
    return _out(r.withColumn("pdf_url", S.pdf_url(F.col("arxiv_id"))).withColumn("relevance_score", F.lit(1.0)))


@query("catalog_union", with_views(
    """SELECT 'local' AS source, paper_id, NULL::VARCHAR AS arxiv_id, paper_name AS title,
              NULL::VARCHAR AS published FROM v_papers
       UNION ALL
       SELECT 'arxiv' AS source, NULL::BIGINT AS paper_id, arxiv_id, title, CAST(published AS VARCHAR)
       FROM v_arxiv""", "v_papers", "v_arxiv"), "SET1 PRJ6 TOP7")
def catalog_union(spark, d):
    local = v_papers(spark, d).select("paper_id", F.col("paper_name").alias("title"))
    remote = v_arxiv(spark, d).select("arxiv_id", "title", F.col("published").cast("string").alias("published"))
    return S.order_mixed(S.catalog_union(local, remote), "arxiv_id", "paper_id").select(
        "source", "paper_id", "arxiv_id", "title", "published")


@query("catalog_by_relevance", with_views(
    f"""SELECT arxiv_id, title, CAST(published AS VARCHAR) AS published, relevance_score FROM (
          SELECT arxiv_id, title, published, CAST({_author_rel(AU_PART)} AS DOUBLE) AS relevance_score
          FROM v_arxiv) ORDER BY relevance_score DESC, published DESC, arxiv_id LIMIT 25""", "v_arxiv"),
    "TOP6 REL2 (top-k report)")
def catalog_by_relevance(spark, d):
    r = v_arxiv(spark, d).withColumn("relevance_score", S.author_relevance(AU_PART))
    return (S.order_catalog(r, "arxiv_id").limit(25)
            .select("arxiv_id", "title", F.col("published").cast("string").alias("published"), "relevance_score"))


@query("json_roundtrip", with_views(
    """SELECT arxiv_id, j AS authors_json,
              CAST(len(CASE WHEN json_valid(j) THEN CAST(from_json(j, '["VARCHAR"]') AS VARCHAR[])
                            ELSE CAST([] AS VARCHAR[]) END) AS BIGINT) AS n_authors
       FROM (SELECT arxiv_id, CASE WHEN categories IS NULL THEN '[not json'
                                   ELSE CAST(to_json(authors) AS VARCHAR) END AS j FROM v_arxiv)""", "v_arxiv"),
    "PRJ4 PRJ5")
def json_roundtrip(spark, d):
    r = v_arxiv(spark, d).select(
        "arxiv_id", F.when(F.col("categories").isNull(), F.lit("[not json"))
        .otherwise(F.to_json("authors")).alias("authors_json"))
    return r.withColumn("n_authors", F.size(S.decode_list(F.col("authors_json"))).cast("long"))


def _event_lines(spark, d):
    e = table(spark, d, "events")
    text = (F.when(F.col("event_type") == "error", F.expr("substr(props, 1, length(props) - 1)"))
            .when((F.col("event_type") == "view") & (F.col("value") < 50), F.lit(""))
            .otherwise(F.col("props")))
    return e.select("event_id", text.alias("value"))


@query("malformed_json_skip", """
    SELECT event_id, CAST(json_extract(t, '$.k') AS BIGINT) AS k FROM (
      SELECT event_id, CASE WHEN event_type = 'error' THEN substr(props, 1, length(props) - 1)
                            WHEN event_type = 'view' AND value < 50 THEN '' ELSE props END AS t FROM events)
    WHERE trim(t) <> '' AND json_valid(t)""", "SRC5 (blank lines skipped, malformed lines rejected)")
def malformed_json_skip(spark, d):
    lines = _event_lines(spark, d)
    ok = lines.filter((F.trim("value") != "") & F.try_parse_json("value").isNotNull())
    return ok.select("event_id", F.try_variant_get(F.try_parse_json("value"), "$.k", "bigint").alias("k"))


@query("ndjson_snapshot_stats", with_views(
    """SELECT COUNT(*) AS total_papers,
              CAST(count_if(doi IS NOT NULL AND doi <> '') AS BIGINT) AS papers_with_doi,
              CAST(count_if(license IS NOT NULL AND license <> '') AS BIGINT) AS papers_with_license,
              CAST(count_if(journal_ref IS NOT NULL AND journal_ref <> '') AS BIGINT) AS papers_with_journal_ref,
              (SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'P') AS rejected
       FROM v_arxiv""", "v_arxiv"), "SRC5 PRJ5 AGG8 (records -> NDJSON lines -> parsed snapshot)")
def ndjson_snapshot_stats(spark, d):
    from scholarq.operators.metadata import coverage_stats
    from scholarq.sources.files import snapshot_from_lines
    r = v_arxiv(spark, d)
    good = r.select(S.encode_record(F.col("arxiv_id").alias("id"), "title", "abstract", "categories",
                                    "authors_parsed", "versions", "update_date", "doi", "license",
                                    F.col("journal_ref").alias("journal-ref")).alias("value"))
    o = table(spark, d, "orders")
    bad = o.filter(F.col("o_orderstatus") == "P").select(
        F.concat(F.lit('{"id": "'), F.col("o_orderkey").cast("string"), F.lit('"')).alias("value"))
    blank = o.filter(F.col("o_orderpriority") == "5-LOW").select(F.lit("   ").alias("value"))
    recs, rejects = snapshot_from_lines(good.unionByName(bad).unionByName(blank))
    return coverage_stats(recs).crossJoin(rejects.agg(F.count(F.lit(1)).alias("rejected")))
