"""Queries over the entity-mention index (C1, C2)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.functions.entities import normalised_type, normalised_type_sql
from scholarq.operators.local_search import local_search, shape_local_results
from scholarq.operators.mentions import (PAPER_COLS, Clause, distinct_entity_types, entity_type_distribution,
                                         like_papers_by_index, mention_like_papers, mention_rows, mention_search, sample_entities)
from scholarq.operators.text_index import SubstringIndex
from scholarq.plans.oracle_views import with_views
from scholarq.plans.registry import query
from scholarq.plans.views import v_doc_text, v_index
from scholarq.session import scratch_path

ROW_COLS = PAPER_COLS + ["entity_name", "entity_type", "count"]
ROW_SQL = ", ".join(ROW_COLS)

PERSON_A = "blue widget"
ORG_B = "red ring"


def _rows(df):
    return df.select(*ROW_COLS)


@query("mention_exact", with_views(
    f"SELECT {ROW_SQL} FROM v_rows WHERE entity_type = 'PERSON' AND entity_name = '{PERSON_A}'", "v_rows"),
    "JN1 FLT1 FLT2 FLT9")
def mention_exact(spark, d):
    p, e, phe = v_index(spark, d)
    return _rows(mention_search(p, phe, e, [Clause("person", PERSON_A)]))


@query("mention_one", with_views(
    f"SELECT {ROW_SQL} FROM v_rows WHERE entity_type = 'PERSON' AND entity_name = '{PERSON_A}' "
    "ORDER BY paper_id, entity_name, entity_type LIMIT 1", "v_rows"),
    "TOP1")
def mention_one(spark, d):
    p, e, phe = v_index(spark, d)
    return _rows(mention_search(p, phe, e, [Clause("person", PERSON_A)], limit="one"))


@query("mention_or_row", with_views(
    f"SELECT {ROW_SQL} FROM v_rows WHERE (entity_type = 'PERSON' AND entity_name = '{PERSON_A}') "
    f"OR (entity_type = 'ORG' AND entity_name = '{ORG_B}')", "v_rows"),
    "FLT3 (row mode)")
def mention_or_row(spark, d):
    p, e, phe = v_index(spark, d)
    return _rows(mention_search(p, phe, e, [Clause("person", PERSON_A), Clause("organisation", ORG_B)],
                                ["or"], mode="row"))


PERSON_C = "hot bolt"
ORG_D = "gear"


@query("mention_and_paper", with_views(
    f"""SELECT {ROW_SQL} FROM v_rows r
        WHERE ((entity_type = 'PERSON' AND entity_name = '{PERSON_C}')
               OR (entity_type = 'ORG' AND entity_name = '{ORG_D}'))
          AND EXISTS (SELECT 1 FROM v_mentions m WHERE m.paper_id = r.paper_id
                      AND m.entity_type = 'PERSON' AND m.entity_name = '{PERSON_C}')
          AND EXISTS (SELECT 1 FROM v_mentions m WHERE m.paper_id = r.paper_id
                      AND m.entity_type = 'ORG' AND m.entity_name = '{ORG_D}')""", "v_rows"),
    "FLT3 (paper mode)")
def mention_and_paper(spark, d):
    p, e, phe = v_index(spark, d)
    return _rows(mention_search(p, phe, e, [Clause("person", PERSON_C), Clause("organisation", ORG_D)],
                                ["and"], mode="paper"))


@query("mention_and_or_paper", with_views(
    f"""SELECT {ROW_SQL} FROM v_rows r
        WHERE ((entity_type = 'PERSON' AND entity_name = '{PERSON_A}')
               OR (entity_type = 'ORG' AND entity_name = '{ORG_B}')
               OR (entity_type = 'WORK_OF_ART' AND entity_name = 'gear'))
          AND ((EXISTS (SELECT 1 FROM v_mentions m WHERE m.paper_id = r.paper_id
                        AND m.entity_type = 'PERSON' AND m.entity_name = '{PERSON_A}')
                AND EXISTS (SELECT 1 FROM v_mentions m WHERE m.paper_id = r.paper_id
                        AND m.entity_type = 'ORG' AND m.entity_name = '{ORG_B}'))
               OR EXISTS (SELECT 1 FROM v_mentions m WHERE m.paper_id = r.paper_id
                        AND m.entity_type = 'WORK_OF_ART' AND m.entity_name = 'gear'))""", "v_rows"),
    "FLT3 (and binds tighter than or)")
def mention_and_or_paper(spark, d):
    p, e, phe = v_index(spark, d)
    return _rows(mention_search(p, phe, e, [Clause("person", PERSON_A), Clause("organisation", ORG_B),
                                            Clause("work", "gear")], ["and", "or"], mode="paper"))


@query("all_papers", with_views(
    "SELECT paper_id, paper_name, paper_pdf, paper_docx, paper_json, paper_entities FROM v_papers", "v_papers"),
    "FLT4 SRC8 PRJ1")
def all_papers(spark, d):
    p, e, phe = v_index(spark, d)
    return mention_search(p, phe, e, [])


@query("mention_like_semi", with_views(
    """SELECT paper_id, paper_name, paper_pdf, paper_docx, paper_json, paper_entities FROM v_papers p
       WHERE EXISTS (SELECT 1 FROM v_mentions m WHERE m.paper_id = p.paper_id
                     AND m.entity_type = 'ORG' AND m.entity_name ILIKE '%IDGE%')""", "v_papers", "v_mentions"),
    "FLT5 JN2")
def mention_like_semi(spark, d):
    p, e, phe = v_index(spark, d)
    return mention_like_papers(p, phe, e, "IDGE", "ORG")


# One to twenty characters, some of them absent.
LIKE_TERMS = ["g", "ED", "idg", "IDGE", "ed wid", "BLUE WIDGET", "x", "qz", "no such name at all!"]


@query("mention_like_index", with_views(" UNION ALL ".join(
    f"""SELECT '{t}' AS term, paper_id, paper_name FROM v_papers p
        WHERE EXISTS (SELECT 1 FROM v_mentions m WHERE m.paper_id = p.paper_id
                      AND m.entity_type = 'ORG' AND m.entity_name ILIKE '%{t}%')""" for t in LIKE_TERMS), "v_papers", "v_mentions"),
    "FLT5 JN2 (substring search through an index of 3-grams)")
def mention_like_index(spark, d):
    p, e, phe = v_index(spark, d)
    names = SubstringIndex.build(e, "entity_name", scratch_path(spark, "names"))
    found = [like_papers_by_index(p, phe, names, t, "ORG").select(F.lit(t).alias("term"), "paper_id", "paper_name") for t in LIKE_TERMS]
    return reduce(DataFrame.unionByName, found)


@query("mention_counts", with_views(
    "SELECT paper_id, entity_name, entity_type, count FROM v_mentions", "v_mentions"),
    "AGG1 SNK4")
def mention_counts(spark, d):
    p, e, phe = v_index(spark, d)
    return phe.join(e, "entity_id").select("paper_id", "entity_name", "entity_type", "count")


@query("entity_type_dist", with_views(
    "SELECT entity_type, COUNT(*) AS n FROM v_rows GROUP BY entity_type", "v_rows"),
    "AGG10")
def entity_type_dist(spark, d):
    p, e, phe = v_index(spark, d)
    return entity_type_distribution(mention_rows(p, phe, e))


@query("entity_types_distinct", with_views(
    "SELECT DISTINCT entity_type FROM v_mentions_raw", "v_mentions_raw"),
    "AGG16")
def entity_types_distinct(spark, d):
    p, e, phe = v_index(spark, d)
    return distinct_entity_types(e)


@query("entity_sample5", with_views(
    """SELECT entity_name, entity_type FROM (SELECT DISTINCT entity_name, entity_type FROM v_mentions_raw)
       WHERE entity_type = 'ORG' ORDER BY entity_name LIMIT 5""", "v_mentions_raw"),
    "TOP9")
def entity_sample5(spark, d):
    p, e, phe = v_index(spark, d)
    return sample_entities(e, "ORG", 5)


@query("type_normalise", with_views(
    f"""SELECT entity_type, {normalised_type_sql('entity_type', 'work')} AS normalised
        FROM (SELECT DISTINCT entity_type FROM v_mentions_raw)""", "v_mentions_raw"),
    "PRJ3")
def type_normalise(spark, d):
    p, e, phe = v_index(spark, d)
    return distinct_entity_types(e).select("entity_type",
                                           normalised_type(F.col("entity_type"), "work").alias("normalised"))


SHAPE_COLS = ["source", "paper_id", "title", "paper_name", "pdf_path", "docx_path", "json_path",
              "entities", "entity_name", "entity_type", "relevance_score"]


def _shape_sql(rows_sql: str, req_type: str, name: str, person: bool) -> str:
    q = name.lower()
    if person:
        rel = (f"""CASE WHEN lower(COALESCE(r.entity_name, '')) = '{q}' THEN 1.0
                    WHEN instr(lower(COALESCE(r.entity_name, '')), '{q}') > 0
                      OR instr('{q}', lower(COALESCE(r.entity_name, ''))) > 0 THEN 0.8
                    WHEN t.text IS NULL THEN 0.3
                    WHEN instr(lower(t.text), '{q}') > 0 THEN 0.6 ELSE 0.4 END""")
    else:
        rel = "1.0"
    return f"""SELECT 'local' AS source, r.paper_id, r.paper_name AS title, r.paper_name,
                      r.paper_pdf AS pdf_path, r.paper_docx AS docx_path, r.paper_json AS json_path,
                      r.paper_entities AS entities, COALESCE(r.entity_name, '{name}') AS entity_name,
                      {normalised_type_sql('r.entity_type', req_type)} AS entity_type,
                      CAST({rel} AS DOUBLE) AS relevance_score
               FROM ({rows_sql}) r LEFT JOIN documents t ON t.doc_id = r.paper_id"""


def _tiered_sql(tiers: list[str]) -> str:
    parts = [f"SELECT *, {i} AS tier FROM ({t})" for i, t in enumerate(tiers)]
    u = " UNION ALL ".join(parts)
    return f"SELECT * EXCLUDE (tier) FROM ({u}) WHERE tier = (SELECT min(tier) FROM ({u}))"


def _parts_sql(label: str, parts: list[str]) -> str:
    arr = "[" + ", ".join(f"'{x}'" for x in parts) + "]"
    return f"""SELECT {ROW_SQL} FROM (
                 SELECT *, row_number() OVER (PARTITION BY paper_id
                   ORDER BY list_position({arr}, entity_name), entity_name, entity_type) AS rn
                 FROM v_rows WHERE entity_type = '{label}' AND list_contains({arr}, entity_name)) WHERE rn = 1"""


PERSON_MISSING = "huge gear"


@query("person_fallback", with_views(_shape_sql(_tiered_sql([
    f"SELECT {ROW_SQL} FROM v_rows WHERE entity_type = 'PERSON' AND entity_name = '{PERSON_MISSING}'",
    _parts_sql("PERSON", ["huge", "gear"])]), "person", PERSON_MISSING, True), "v_rows"),
    "TOP4 FLT11 REL1 PRJ2 PRJ3 PRJ6")
def person_fallback(spark, d):
    p, e, phe = v_index(spark, d)
    rows = local_search(p, phe, e, "person", PERSON_MISSING)
    return shape_local_results(rows, "person", PERSON_MISSING, v_doc_text(spark, d)).select(*SHAPE_COLS)


ORG_MISSING = "giant bolt"
_ORG_LIKE = f"""SELECT paper_id, paper_name, paper_pdf, paper_docx, paper_json, paper_entities,
                NULL::VARCHAR AS entity_name, NULL::VARCHAR AS entity_type, NULL::BIGINT AS count
         FROM v_papers p WHERE EXISTS (SELECT 1 FROM v_mentions m WHERE m.paper_id = p.paper_id
              AND m.entity_type = 'ORG' AND m.entity_name ILIKE '%{{name}}%')"""


@query("org_fallback", with_views(_shape_sql(_tiered_sql([
    f"SELECT {ROW_SQL} FROM v_rows WHERE entity_type = 'ORG' AND entity_name = '{ORG_MISSING}'",
    _parts_sql("ORG", ["giant", "bolt"]), _ORG_LIKE.format(name=ORG_MISSING)]),
    "organisation", ORG_MISSING, False), "v_rows"),
    "TOP4 FLT11 (organisation words)")
def org_fallback(spark, d):
    p, e, phe = v_index(spark, d)
    rows = local_search(p, phe, e, "organisation", ORG_MISSING)
    return shape_local_results(rows, "organisation", ORG_MISSING).select(*SHAPE_COLS)


ORG_PART = "idge"


@query("org_like_fallback", with_views(_shape_sql(_tiered_sql([
    f"SELECT {ROW_SQL} FROM v_rows WHERE entity_type = 'ORG' AND entity_name = '{ORG_PART}'",
    _ORG_LIKE.format(name=ORG_PART)]), "organisation", ORG_PART, False), "v_rows"),
    "TOP4 FLT5 (substring tier)")
def org_like_fallback(spark, d):
    p, e, phe = v_index(spark, d)
    rows = local_search(p, phe, e, "organisation", ORG_PART)
    return shape_local_results(rows, "organisation", ORG_PART).select(*SHAPE_COLS)


@query("person_relevance", with_views(_shape_sql(
    f"SELECT {ROW_SQL} FROM v_rows WHERE (entity_type = 'PERSON' AND entity_name = '{PERSON_A}') "
    f"OR (entity_type = 'PERSON' AND entity_name = 'gear')", "person", "gear", True), "v_rows"),
    "REL1 TOP5")
def person_relevance(spark, d):
    p, e, phe = v_index(spark, d)
    rows = mention_search(p, phe, e, [Clause("person", PERSON_A), Clause("person", "gear")], ["or"], mode="row")
    return shape_local_results(rows, "person", "gear", v_doc_text(spark, d)).select(*SHAPE_COLS)


@query("local_ranked", with_views(f"""
    SELECT CAST(row_number() OVER (ORDER BY relevance_score DESC, paper_id, entity_type, entity_name) AS BIGINT) AS rank,
           paper_id, relevance_score
    FROM ({_shape_sql(
        f"SELECT {ROW_SQL} FROM v_rows WHERE (entity_type = 'PERSON' AND entity_name = '{PERSON_A}') "
        f"OR (entity_type = 'PERSON' AND entity_name = 'gear')", "person", "the", True)}) ORDER BY rank LIMIT 60""", "v_rows"),
    "TOP5 REL1 (order of local results; texts that hold the name score 0.6)")
def local_ranked(spark, d):
    p, e, phe = v_index(spark, d)
    rows = mention_search(p, phe, e, [Clause("person", PERSON_A), Clause("person", "gear")], ["or"], mode="row")
    shaped = shape_local_results(rows, "person", "the", v_doc_text(spark, d)).limit(60)
    return shaped.coalesce(1).select((F.monotonically_increasing_id() + 1).alias("rank"), "paper_id", "relevance_score")
