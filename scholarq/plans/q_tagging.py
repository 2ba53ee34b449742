"""Gazetteer tagging over the documents (NER1 -> AGG1 ingest)."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarq.operators.gazetteer import tag_entities
from scholarq.plans.registry import query
from scholarq.plans.views import table

# Test dictionary of names occurring in the synthetic prose.
TEST_DICTIONARY = [
    ("the", "PERSON"), ("of the", "ORG"), ("in the", "GPE"), ("of the it", "WORK_OF_ART"),
    ("der", "PERSON"), ("in der", "GPE"), ("de la", "ORG"), ("de", "NORP"), ("que", "NORP"),
    ("The", "PERSON"), ("Is and", "ORG"), ("la", "DATE"), ("in the of the it", "EVENT"), ("the it", "LAW"),
    ("it in", "FAC"), ("in. The", "GPE"), ("le la", "ORG"), ("la de", "PERSON"),
]


def _dictionary(spark):
    return spark.createDataFrame(TEST_DICTIONARY, "name string, label string")


_W = r"\p{L}\p{N}_"
_VALUES = ", ".join(f"('{n}', '{lab}')" for n, lab in TEST_DICTIONARY)

# Written independently of the Spark plan: n-grams as slices of each document's
# token list, the greedy choice as a recursion from match to match.
TAGS_SQL = rf"""
WITH RECURSIVE p AS (
  SELECT doc_id, coalesce(text, '') AS t, length(regexp_extract(coalesce(text, ''), '^[^{_W}]*', 0)) AS lead0,
         regexp_extract_all(coalesce(text, ''), '[{_W}]+[^{_W}]*') AS pcs FROM documents),
starts AS (
  SELECT doc_id, t, pcs, i, lead0 + coalesce(sum(length(pcs[i])) OVER (PARTITION BY doc_id ORDER BY i
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
  FROM (SELECT *, unnest(range(1, len(pcs) + 1)) AS i FROM p)),
dict AS (
  SELECT DISTINCT regexp_extract_all(name, '[{_W}]+') AS words, label FROM (VALUES {_VALUES}) v(name, label)),
m AS (
  SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(s + length(array_to_string(pcs[i:i + len(words) - 2], ''))
                    + length(words[len(words)]) AS BIGINT) AS e, min(label) AS label
  FROM starts JOIN dict ON words = list_transform(pcs[i:i + len(words) - 1], lambda x: regexp_extract(x, '^[{_W}]+', 0))
  WHERE len(list_filter(pcs[i:i + len(words) - 2], lambda x: NOT regexp_full_match(x, '[{_W}]+\s+'))) = 0 OR len(words) = 1
  GROUP BY ALL),
chosen AS (
  SELECT doc_id, s, e, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s, e DESC) AS r FROM m) WHERE r = 1
  UNION ALL
  SELECT doc_id, s, e, label FROM (
    SELECT m.*, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.s, m.e DESC) AS r
    FROM chosen c JOIN m ON m.doc_id = c.doc_id AND m.s >= c.e) WHERE r = 1),
tags AS (
  SELECT doc_id, substr(t, s + 1, e - s) AS text, s AS start_char, e AS end_char, label FROM chosen JOIN p USING (doc_id))
"""


def _tags(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return tag_entities(docs, "doc_id", "text", _dictionary(spark))


@query("gazetteer_tags", TAGS_SQL + "SELECT * FROM tags", "NER1")
def gazetteer_tags(spark, d):
    return _tags(spark, d)


@query("gazetteer_mention_counts", TAGS_SQL + """
    SELECT doc_id AS paper_id, text AS entity_name, label AS entity_type, COUNT(*) AS count
    FROM tags GROUP BY doc_id, text, label""", "NER1 AGG1 (tagged mentions -> index counts)")
def gazetteer_mention_counts(spark, d):
    return (_tags(spark, d).groupBy(F.col("doc_id").alias("paper_id"), F.col("text").alias("entity_name"),
                                    F.col("label").alias("entity_type"))
            .agg(F.count(F.lit(1)).alias("count")))
