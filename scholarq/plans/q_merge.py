"""Ingest, upsert and merge queries (C1 ingest, C3 storage).

The stored state and the incoming batch are two overlapping slices of the
same table by date (stored: before the cut; batch: from an earlier date
on), so together they cover the whole table and the overlap exercises
updates.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarq.operators import merge as G
from scholarq.operators import search as S
from scholarq.operators.ids import sequential_ids
from scholarq.operators.mentions import build_mention_index
from scholarq.plans.oracle_views import with_views
from scholarq.plans.registry import query
from scholarq.session import written
from scholarq.plans.views import table, v_arxiv, v_mentions_raw, v_papers
from scholarq.sources.manifest import derive_paths, match_manifest

STORED_BEFORE = "1998-01-01"
BATCH_FROM = "1997-01-01"
PCOLS = ["paper_pdf", "paper_docx", "paper_json", "paper_entities"]


def _paths(df, version: str, seq: int):
    n = F.col("paper_name")
    return df.select("paper_name",
                     F.concat(F.lit(f"Papers/{version}/"), n, F.lit(".pdf")).alias("paper_pdf"),
                     F.concat(F.lit(f"Docs/{version}/"), n, F.lit(".pdf.docx")).alias("paper_docx"),
                     F.concat(F.lit(f"JSON/{version}/"), n, F.lit(".pdf.json")).alias("paper_json"),
                     F.concat(F.lit(f"Ents/{version}/"), n, F.lit(".pdf.json")).alias("paper_entities"),
                     F.lit(seq).alias("seq"))


_P_OLD = ("SELECT paper_id, paper_name, paper_pdf, paper_docx, paper_json, paper_entities FROM v_papers "
          f"WHERE published < TIMESTAMP '{STORED_BEFORE}'")
# In the batch every third paper comes a second time, with later paths.
_P_NEW = ("SELECT paper_name, 'Papers/' || v || '/' || paper_name || '.pdf' AS paper_pdf, "
          "'Docs/' || v || '/' || paper_name || '.pdf.docx' AS paper_docx, "
          "'JSON/' || v || '/' || paper_name || '.pdf.json' AS paper_json, "
          "'Ents/' || v || '/' || paper_name || '.pdf.json' AS paper_entities "
          "FROM (SELECT *, CASE WHEN paper_id % 3 = 0 THEN 'v3' ELSE 'v2' END AS v FROM v_papers) "
          f"WHERE published >= TIMESTAMP '{BATCH_FROM}'")


@query("upsert_papers", with_views(
    """SELECT o.paper_id, o.paper_name, COALESCE(n.paper_pdf, o.paper_pdf) AS paper_pdf,
              COALESCE(n.paper_docx, o.paper_docx) AS paper_docx, COALESCE(n.paper_json, o.paper_json) AS paper_json,
              COALESCE(n.paper_entities, o.paper_entities) AS paper_entities
       FROM p_old o LEFT JOIN p_new n USING (paper_name)
       UNION ALL
       SELECT (SELECT COALESCE(max(paper_id), 0) FROM p_old) + row_number() OVER (ORDER BY n.paper_name),
              n.paper_name, n.paper_pdf, n.paper_docx, n.paper_json, n.paper_entities
       FROM p_new n WHERE n.paper_name NOT IN (SELECT paper_name FROM p_old)""",
    "v_papers", extra={"p_old": _P_OLD, "p_new": _P_NEW}), "SNK2 SNK8")
def upsert_papers(spark, d):
    p = v_papers(spark, d)
    old = p.filter(F.col("published") < F.lit(STORED_BEFORE).cast("timestamp")).select(
        "paper_id", "paper_name", *PCOLS)
    batch = p.filter(F.col("published") >= F.lit(BATCH_FROM).cast("timestamp"))
    new = _paths(batch.filter("paper_id % 3 = 0"), "v3", 1).unionByName(_paths(batch, "v2", 0))
    return G.upsert_by_key(old, new, ["paper_name"], "paper_id", PCOLS, order_col="seq").select(
        "paper_id", "paper_name", *PCOLS)


def _mentions_dated(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("paper_id"), "o_orderdate")
    return v_mentions_raw(spark, d).join(o, "paper_id")


_E_SLICE = """SELECT DISTINCT m.entity_type, m.entity_name FROM v_mentions_raw m
              JOIN orders o ON o.o_orderkey = m.paper_id WHERE o.o_orderdate {op} TIMESTAMP '1997-01-01'"""
_E_OLD = ("SELECT row_number() OVER (ORDER BY entity_type, entity_name) AS entity_id, entity_type, entity_name "
          f"FROM ({_E_SLICE.format(op='<')})")


@query("upsert_entities", with_views(
    """SELECT entity_id, entity_name, entity_type FROM e_old
       UNION ALL
       SELECT (SELECT max(entity_id) FROM e_old) + row_number() OVER (ORDER BY entity_type, entity_name),
              entity_name, entity_type
       FROM e_new n WHERE NOT EXISTS (SELECT 1 FROM e_old o WHERE o.entity_type = n.entity_type
                                                         AND o.entity_name = n.entity_name)""",
    "v_mentions_raw", extra={"e_old": _E_OLD, "e_new": _E_SLICE.format(op=">=")}), "SNK3 SNK8")
def upsert_entities(spark, d):
    m = _mentions_dated(spark, d)
    cut = F.lit("1997-01-01").cast("timestamp")
    old_keys = m.filter(F.col("o_orderdate") < cut).select("entity_type", "entity_name").distinct()
    old = sequential_ids(old_keys, ["entity_type", "entity_name"], 0, "entity_id")
    new = m.filter(F.col("o_orderdate") >= cut).select("entity_type", "entity_name")
    return G.insert_new_keys(old, new, ["entity_type", "entity_name"], "entity_id").select(
        "entity_id", "entity_name", "entity_type")


@query("surrogate_ids", with_views(
    """SELECT row_number() OVER (ORDER BY entity_type, entity_name) AS entity_id, entity_name, entity_type
       FROM (SELECT DISTINCT entity_type, entity_name FROM v_mentions_raw)""", "v_mentions_raw"), "SNK8")
def surrogate_ids(spark, d):
    keys = v_mentions_raw(spark, d).select("entity_type", "entity_name").distinct()
    return sequential_ids(keys, ["entity_type", "entity_name"], 0, "entity_id").select(
        "entity_id", "entity_name", "entity_type")


_C_SLICE = """SELECT m.paper_id, m.entity_name, m.entity_type, COUNT(*) AS count FROM v_mentions_raw m
              JOIN orders o ON o.o_orderkey = m.paper_id WHERE o.o_orderdate {op} TIMESTAMP '{ts}'
              GROUP BY m.paper_id, m.entity_name, m.entity_type"""


def _count_slices(spark, d):
    m = _mentions_dated(spark, d)
    _, old = build_mention_index(m.filter(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp")))
    _, batch = build_mention_index(m.filter(F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp")))
    ents, _ = build_mention_index(m)
    return old, batch, ents


@query("increment_counts", with_views(
    """SELECT paper_id, entity_name, entity_type, count FROM c_old
       WHERE paper_id NOT IN (SELECT paper_id FROM c_new)
       UNION ALL SELECT paper_id, entity_name, entity_type, count FROM c_new""",
    "v_mentions_raw", extra={"c_old": _C_SLICE.format(op="<", ts="1997-01-01"),
                             "c_new": _C_SLICE.format(op=">=", ts="1996-01-01")}), "SNK4 (idempotent replace)")
def increment_counts(spark, d):
    old, batch, ents = _count_slices(spark, d)
    return G.replace_counts(old, batch).join(ents, "entity_id").select(
        "paper_id", "entity_name", "entity_type", "count")


@query("increment_counts_add", with_views(
    """SELECT COALESCE(o.paper_id, n.paper_id) AS paper_id, COALESCE(o.entity_name, n.entity_name) AS entity_name,
              COALESCE(o.entity_type, n.entity_type) AS entity_type,
              COALESCE(o.count, 0) + COALESCE(n.count, 0) AS count
       FROM c_old o FULL OUTER JOIN c_new n
         ON o.paper_id = n.paper_id AND o.entity_name = n.entity_name AND o.entity_type = n.entity_type""",
    "v_mentions_raw", extra={"c_old": _C_SLICE.format(op="<", ts="1997-01-01"),
                             "c_new": _C_SLICE.format(op=">=", ts="1996-01-01")}), "SNK4 (count = count + n)")
def increment_counts_add(spark, d):
    old, batch, ents = _count_slices(spark, d)
    summed = G.add_counts(old, batch, ["entity_id", "paper_id"])
    return summed.join(ents, "entity_id").select("paper_id", "entity_name", "entity_type", "count")


_AX_BATCH = f"""SELECT arxiv_id, 'Draft: ' || title AS title, NULL::DOUBLE AS relevance_score, 0 AS seq FROM v_arxiv
               WHERE published >= TIMESTAMP '{BATCH_FROM}'
               UNION ALL
               SELECT arxiv_id, 'Revised: ' || title, NULL::DOUBLE, 1 FROM v_arxiv
               WHERE published >= TIMESTAMP '{BATCH_FROM}' AND doi IS NOT NULL AND doi <> ''"""


@query("insert_or_replace", with_views(
    f"""SELECT arxiv_id, title, 0.5::DOUBLE AS relevance_score FROM v_arxiv s
        WHERE published < TIMESTAMP '{STORED_BEFORE}' AND arxiv_id NOT IN (SELECT arxiv_id FROM batch)
        UNION ALL
        SELECT arxiv_id, title, COALESCE(relevance_score, 1.0) FROM (
          SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY seq DESC) AS rn FROM batch) WHERE rn = 1""",
    "v_arxiv", extra={"batch": _AX_BATCH}), "SNK5 (last write wins, default score)")
def insert_or_replace(spark, d):
    r = v_arxiv(spark, d)
    stored = r.filter(F.col("published") < F.lit(STORED_BEFORE).cast("timestamp")).select(
        "arxiv_id", "title", F.lit(0.5).alias("relevance_score"))
    b = r.filter(F.col("published") >= F.lit(BATCH_FROM).cast("timestamp"))
    batch = (b.select("arxiv_id", F.concat(F.lit("Draft: "), "title").alias("title"),
                      F.lit(None).cast("double").alias("relevance_score"), F.lit(0).alias("seq"))
             .unionByName(b.filter(F.col("doi").isNotNull() & (F.col("doi") != "")).select(
                 "arxiv_id", F.concat(F.lit("Revised: "), "title").alias("title"),
                 F.lit(None).cast("double").alias("relevance_score"), F.lit(1).alias("seq"))))
    return G.insert_or_replace(stored, batch, "arxiv_id", "seq", {"relevance_score": 1.0})


@query("insert_if_absent", with_views(
    f"""SELECT paper_id, paper_name FROM v_papers WHERE published < TIMESTAMP '{STORED_BEFORE}'
        UNION ALL
        SELECT (SELECT max(paper_id) FROM v_papers WHERE published < TIMESTAMP '{STORED_BEFORE}')
               + row_number() OVER (ORDER BY title), title
        FROM (SELECT DISTINCT title FROM v_arxiv) t
        WHERE title NOT IN (SELECT paper_name FROM v_papers WHERE published < TIMESTAMP '{STORED_BEFORE}')""",
    "v_papers", "v_arxiv"), "SNK6")
def insert_if_absent(spark, d):
    stored = v_papers(spark, d).filter(F.col("published") < F.lit(STORED_BEFORE).cast("timestamp")).select(
        "paper_id", "paper_name")
    batch = v_arxiv(spark, d).select(F.col("title").alias("paper_name"), F.col("paper_id").alias("_ord"))
    return G.insert_if_absent(stored, batch, "paper_name", "_ord", "paper_id")


@query("insert_or_ignore", with_views(
    """SELECT entity_id, entity_name, entity_type FROM e_all
       UNION ALL
       SELECT (SELECT max(entity_id) FROM e_all) + row_number() OVER (ORDER BY entity_type, entity_name),
              entity_name, entity_type
       FROM (SELECT DISTINCT unnest(authors) AS entity_name, 'PERSON' AS entity_type FROM v_arxiv
             UNION
             SELECT DISTINCT unnest(string_split_regex(categories, '\\s+')), 'WORK_OF_ART' FROM v_arxiv
             WHERE categories IS NOT NULL) n
       WHERE NOT EXISTS (SELECT 1 FROM e_all o WHERE o.entity_type = n.entity_type
                                                 AND o.entity_name = n.entity_name)""",
    "v_mentions_raw", "v_arxiv", extra={"e_all": """SELECT row_number() OVER (ORDER BY entity_type, entity_name)
        AS entity_id, entity_type, entity_name FROM (SELECT DISTINCT entity_type, entity_name FROM v_mentions_raw)"""}),
    "SNK7 (authors as PERSON, categories as WORK_OF_ART)")
def insert_or_ignore(spark, d):
    keys = v_mentions_raw(spark, d).select("entity_type", "entity_name").distinct()
    existing = sequential_ids(keys, ["entity_type", "entity_name"], 0, "entity_id")
    r = v_arxiv(spark, d)
    new = (r.select(F.explode("authors").alias("entity_name"), F.lit("PERSON").alias("entity_type"))
           .unionByName(r.select(F.explode(F.split("categories", r"\s+")).alias("entity_name"),
                                 F.lit("WORK_OF_ART").alias("entity_type"))))
    return G.insert_new_keys(existing, new, ["entity_type", "entity_name"], "entity_id").select(
        "entity_id", "entity_name", "entity_type")


_LINKED = """SELECT DISTINCT e.entity_id, r.paper_id FROM (
    SELECT CAST(arxiv_id AS VARCHAR) AS paper_id, unnest(authors) AS entity_name, 'PERSON' AS entity_type FROM v_arxiv
    UNION ALL SELECT arxiv_id, unnest(string_split_regex(categories, '\\s+')), 'WORK_OF_ART' FROM v_arxiv
    WHERE categories IS NOT NULL) r JOIN e_new e USING (entity_type, entity_name)"""
_E_NEW = """SELECT row_number() OVER (ORDER BY entity_type, entity_name) AS entity_id, entity_type, entity_name FROM (
    SELECT DISTINCT unnest(authors) AS entity_name, 'PERSON' AS entity_type FROM v_arxiv
    UNION SELECT DISTINCT unnest(string_split_regex(categories, '\\s+')), 'WORK_OF_ART' FROM v_arxiv
    WHERE categories IS NOT NULL)"""


@query("insert_or_ignore_links", with_views(
    """SELECT entity_id, paper_id, 5 AS count FROM linked WHERE entity_id % 2 = 0
       UNION ALL SELECT entity_id, paper_id, 1 FROM linked WHERE entity_id % 2 <> 0""",
    "v_arxiv", extra={"e_new": _E_NEW, "linked": _LINKED}), "SNK7 JN5 (paper-entity links of remote records)")
def insert_or_ignore_links(spark, d):
    key = ["entity_type", "entity_name"]
    def named(array, entity_type):
        return F.transform(array, lambda x: F.struct(x.alias("entity_name"), F.lit(entity_type).alias("entity_type")))

    # The records are built once, and written as their names.
    categories = F.coalesce(F.split("categories", r"\s+"), F.array().cast("array<string>"))
    names, _ = written(v_arxiv(spark, d).select(F.col("arxiv_id").alias("paper_id"), F.explode(F.concat(
        named(F.col("authors"), "PERSON"), named(categories, "WORK_OF_ART"))).alias("e")).select("paper_id", "e.*"), "names")
    entities = sequential_ids(names.select(*key).distinct(), key, 0, "entity_id")
    # Links to every second entity are stored already, with a count of their own.
    stored, _ = written(G.lookup_ids(names.distinct(), entities, key, "entity_id").filter("entity_id % 2 = 0")
                        .select("entity_id", "paper_id", F.lit(5).cast("long").alias("count")), "stored-links")
    return G.insert_or_ignore_links(stored, names, entities, key)


def _manifest(spark, d):
    o = table(spark, d, "orders")
    name = F.concat(F.lit("paper-"), F.col("o_orderkey").cast("string"))
    first = o.select(name.alias("paper_name"), F.concat(name, F.lit(".pdf")).alias("paper_pdf"),
                     F.lit("draft").alias("title"), (F.col("o_orderkey") * 2).alias("_line"))
    again = o.filter(F.col("o_orderstatus") == "F").select(
        name.alias("paper_name"), F.concat(name, F.lit(".pdf")).alias("paper_pdf"),
        F.lit("final").alias("title"), (F.col("o_orderkey") * 2 + 1).alias("_line"))
    return first.unionByName(again)


def _listing(spark, d):
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("paper-"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("name")).distinct()
    cu = table(spark, d, "customer").select(
        F.concat(F.lit("cust-"), F.col("c_custkey").cast("string"), F.lit(".pdf")).alias("name"))
    return li.unionByName(cu)


_MANIFEST_SQL = """SELECT 'paper-' || CAST(o_orderkey AS VARCHAR) AS paper_name,
                          'paper-' || CAST(o_orderkey AS VARCHAR) || '.pdf' AS paper_pdf, 'draft' AS title,
                          o_orderkey * 2 AS line FROM orders
                   UNION ALL
                   SELECT 'paper-' || CAST(o_orderkey AS VARCHAR), 'paper-' || CAST(o_orderkey AS VARCHAR) || '.pdf',
                          'final', o_orderkey * 2 + 1 FROM orders WHERE o_orderstatus = 'F'"""
_LISTING_SQL = """SELECT DISTINCT 'paper-' || CAST(l_orderkey AS VARCHAR) || '.pdf' AS name FROM lineitem
                  UNION ALL SELECT 'cust-' || CAST(c_custkey AS VARCHAR) || '.pdf' FROM customer"""


@query("manifest_match", with_views(
    """SELECT f.name, m.paper_name, m.title, 'Papers/' || m.paper_pdf AS paper_pdf,
              'Docs/' || m.paper_pdf || '.docx' AS paper_docx, 'JSON/' || m.paper_pdf || '.json' AS paper_json,
              'Ents/' || m.paper_pdf || '.json' AS paper_entities
       FROM files f JOIN (SELECT paper_pdf, arg_max(paper_name, line) AS paper_name, arg_max(title, line) AS title
                          FROM manifest GROUP BY paper_pdf) m ON f.name = m.paper_pdf""",
    extra={"manifest": _MANIFEST_SQL, "files": _LISTING_SQL}), "SRC1 SRC2 JN3 PRJ1")
def manifest_match(spark, d):
    matched, _ = match_manifest(_listing(spark, d), _manifest(spark, d))
    return derive_paths(matched.select("name", "paper_name", "title", "paper_pdf"))


@query("manifest_unmatched", with_views(
    "SELECT name FROM files WHERE name NOT IN (SELECT paper_pdf FROM manifest)",
    extra={"manifest": _MANIFEST_SQL, "files": _LISTING_SQL}), "JN4")
def manifest_unmatched(spark, d):
    _, unmatched = match_manifest(_listing(spark, d), _manifest(spark, d))
    return unmatched.select("name")


_CACHE = f"""(SELECT arxiv_id, CASE WHEN paper_id % 3 <> 0 THEN 'Cached: ' || title END AS title, categories FROM v_arxiv
              WHERE published < TIMESTAMP '{STORED_BEFORE}')"""
_FOUND = "(SELECT arxiv_id, title, CASE WHEN paper_id % 2 = 0 THEN categories END AS categories FROM v_arxiv)"


def _cache_and_source(spark, d):
    """Stored records, some without a title, and the source's, some without categories."""
    r = v_arxiv(spark, d)
    cache = r.filter(F.col("published") < F.lit(STORED_BEFORE).cast("timestamp")).select(
        "arxiv_id", F.when(F.col("paper_id") % 3 != 0, F.concat(F.lit("Cached: "), "title")).alias("title"), "categories")
    return cache, r.select("arxiv_id", "title", F.when(F.col("paper_id") % 2 == 0, F.col("categories")).alias("categories"))


@query("cache_first", with_views(
    f"""SELECT s.arxiv_id, CASE WHEN c.arxiv_id IS NULL THEN s.title ELSE c.title END AS title,
               CASE WHEN c.arxiv_id IS NULL THEN s.categories ELSE c.categories END AS categories
        FROM {_FOUND} s LEFT JOIN {_CACHE} c ON c.arxiv_id = s.arxiv_id""", "v_arxiv"), "JN7 (whole records)")
def cache_first(spark, d):
    return S.cache_first(*_cache_and_source(spark, d), "arxiv_id")


@query("cache_to_store", with_views(
    f"SELECT * FROM {_FOUND} WHERE arxiv_id NOT IN (SELECT arxiv_id FROM {_CACHE})", "v_arxiv"), "JN7 (the records to store)")
def cache_to_store(spark, d):
    return S.to_store(*_cache_and_source(spark, d), "arxiv_id")


@query("merge_first_wins", with_views(
    """SELECT arxiv_id, relevance_score, origin FROM (
         SELECT *, row_number() OVER (PARTITION BY arxiv_id ORDER BY src) AS rn FROM (
           SELECT arxiv_id, 1.0::DOUBLE AS relevance_score, 'keyword' AS origin, 0 AS src FROM v_arxiv
           WHERE instr(lower(concat_ws(' ', title, abstract, array_to_string(authors, ' '), categories)), 'widget') > 0
           UNION ALL
           SELECT arxiv_id, 0.8::DOUBLE, 'author', 1 FROM v_arxiv
           WHERE len(list_filter(authors, lambda a: instr(lower(a), 'supplier#00000001') > 0)) > 0)) WHERE rn = 1""",
    "v_arxiv"), "SET2 JN6")
def merge_first_wins(spark, d):
    r = v_arxiv(spark, d)
    a = S.search(r, "widget", "keyword").select("arxiv_id", "relevance_score", F.lit("keyword").alias("origin"))
    b = S.search(r, "Supplier#00000001", "author").select("arxiv_id", "relevance_score",
                                                         F.lit("author").alias("origin"))
    return S.first_wins_union(a, b)


@query("commit_with_rejects", with_views(
    """SELECT arxiv_id, concat_ws(',',
              CASE WHEN NOT COALESCE(len(versions) > 0, false) THEN 'has_versions' END,
              CASE WHEN NOT COALESCE(update_date IS NULL OR update_date = ''
                                     OR try_strptime(update_date, '%Y-%m-%d') IS NOT NULL, false)
                   THEN 'date_ok' END) AS reason
       FROM v_arxiv
       WHERE NOT COALESCE(len(versions) > 0, false)
          OR NOT COALESCE(update_date IS NULL OR update_date = '' OR try_strptime(update_date, '%Y-%m-%d') IS NOT NULL,
                          false)""", "v_arxiv"), "SNK10 (validation rejects)")
def commit_with_rejects(spark, d):
    r = v_arxiv(spark, d)
    u = F.col("update_date")
    _, rejects = G.split_rejects(r, {
        "has_versions": F.size("versions") > 0,
        "date_ok": u.isNull() | (u == "") | F.try_to_timestamp(u, F.lit("y-M-d")).isNotNull(),
    })
    return rejects.select("arxiv_id", "reason")
