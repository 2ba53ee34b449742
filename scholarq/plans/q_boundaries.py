"""Learned sentence boundaries (SEN1) over documents with abbreviations, initials and ordinals."""

from __future__ import annotations

from pyspark.sql import functions as F

from scholarq.operators import boundaries as B
from scholarq.plans.registry import query
from scholarq.plans.views import table

#: Stands for each line break of a text.
_JOINT = " cf. Dr. A. Lee et al. on p. 7. und 3. The "


def v_cited(spark, d):
    return table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(_JOINT)).alias("text"))


def _learned(spark, d) -> B.Boundaries:
    return B.learn(v_cited(spark, d), "doc_id", "text")


_LIKE = ("(CASE WHEN ({k}) = 0 THEN 0.0 ELSE ({k}) * ln({p}) END + CASE WHEN ({n}) - ({k}) = 0 THEN 0.0 "
         "ELSE (({n}) - ({k})) * ln(1 - {p}) END)")


def _like(k, n, p):
    return _LIKE.format(k=k, n=n, p=f"(({p})::DOUBLE)")


_SQL = rf"""
WITH docs AS (SELECT doc_id, replace(text, chr(10), '{_JOINT}') AS text FROM documents),
counts AS (
  SELECT rtrim(t, '.') AS word, count_if(suffix(t, '.'))::BIGINT AS n_dot, count_if(NOT suffix(t, '.'))::BIGINT AS n_plain
  FROM (SELECT unnest(regexp_extract_all(lower(text), '{B.WORD}\.?')) AS t FROM docs) GROUP BY 1),
totals AS (SELECT sum(n_dot)::DOUBLE AS dots, sum(n_dot + n_plain)::DOUBLE AS n FROM counts),
scored AS (
  SELECT word, n_dot, n_plain,
         2 * (n_dot * (ln({B.PERIOD_GIVEN_ABBREVIATION}::DOUBLE) - ln(dots / n))
              + n_plain * (ln(1 - {B.PERIOD_GIVEN_ABBREVIATION}::DOUBLE) - ln(1 - dots / n)))
         * (length(word) - length(replace(word, '.', '')) + 1)
         * exp(-length(replace(word, '.', ''))::DOUBLE - n_plain * ln(length(replace(word, '.', '')))) AS score
  FROM counts, totals WHERE dots BETWEEN 1 AND n - 1 AND n_dot > 0 AND regexp_matches(word, '\p{{L}}')),
short AS (SELECT * FROM scored WHERE score >= {B.ABBREVIATION_FROM}),
cut AS (
  SELECT doc_id, unnest(l) AS piece, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?]\s+)', '\1' || chr(1), 'g'), chr(1)) AS l FROM docs)),
pieces AS (
  SELECT *, length(last) = 1 AND regexp_matches(piece, '\p{{Lu}}\.\s+$') AS initial,
         lead(first) OVER (PARTITION BY doc_id ORDER BY pos) AS next, last IN (SELECT word FROM short) AS abbreviation
  FROM (SELECT *, regexp_extract(lower(piece), '({B.WORD})\.\s+$', 1) AS last, regexp_extract(piece, '^({B.WORD})', 1) AS first
        FROM cut WHERE piece <> '')),
firsts AS (
  SELECT lower(next) AS word, regexp_matches(next, '^\p{{Lu}}') AS capital, count(*) AS n_first
  FROM pieces WHERE last <> '' AND NOT abbreviation AND NOT initial AND next IS NOT NULL GROUP BY 1, 2),
paired AS (
  SELECT f.word, f.n_first AS k, e.ends AS n1, c.n_dot + c.n_plain AS c, t.n::BIGINT AS n
  FROM firsts f JOIN counts c ON c.word = f.word, (SELECT sum(n_first)::BIGINT AS ends FROM firsts) e, totals t
  WHERE f.capital),
starters AS (
  SELECT * FROM (
    SELECT word, k AS n_first, c AS n, 2 * ({_like('k', 'n1', 'k / n1')} + {_like('c - k', 'n - n1', '(c - k) / (n - n1)')}
           - {_like('k', 'n1', 'c / n')} - {_like('c - k', 'n - n1', 'c / n')}) AS score
    FROM paired WHERE n > n1 AND k / n1 > c / n) WHERE score >= {B.STARTER_FROM})
"""


@query("learned_marks", _SQL + """
    SELECT 'abbreviation' AS kind, word, n_dot AS n_marked, n_plain + n_dot AS n, round(score, 4) AS score FROM short
    UNION ALL SELECT 'starter', word, n_first, n, round(score, 4) FROM starters""",
       "SEN1 (abbreviations and sentence starters learned from the corpus)")
def learned_marks(spark, d):
    known = _learned(spark, d)
    n = (F.col("n_dot") + F.col("n_plain")).alias("n")
    return (known.abbreviations.select(F.lit("abbreviation").alias("kind"), "word", F.col("n_dot").alias("n_marked"), n,
                                       F.round("score", 4).alias("score"))
            .unionByName(known.starters.select(F.lit("starter").alias("kind"), "word", F.col("n_first").alias("n_marked"), "n",
                                               F.round("score", 4).alias("score"))))


@query("learned_sentences", _SQL + r"""
    SELECT doc_id, sent_idx, sentence FROM (
      SELECT doc_id, sent_idx, regexp_replace(string_agg(piece, '' ORDER BY pos), '^\s+|\s+$', '', 'g') AS sentence FROM (
        SELECT doc_id, pos, piece,
               coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sent_idx
        FROM (SELECT *, CASE WHEN last = '' OR next IS NULL THEN 1
                             WHEN regexp_matches(last, '^\p{N}+$') AND regexp_matches(next, '^\p{Ll}') THEN 0
                             WHEN abbreviation OR initial THEN
                               (lower(next) IN (SELECT word FROM starters) AND regexp_matches(next, '^\p{Lu}'))::INT
                             ELSE 1 END AS ends
              FROM pieces)) GROUP BY doc_id, sent_idx) WHERE sentence <> ''""",
       "SEN1 (sentences by learned boundaries)")
def learned_sentences(spark, d):
    return B.split_sentences(v_cited(spark, d), "doc_id", "text", _learned(spark, d))
