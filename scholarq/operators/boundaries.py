"""Learned sentence boundaries (SEN1), after Kiss & Strunk (2006).

A period ends a sentence unless it belongs to an abbreviation, an initial or an ordinal.  Abbreviations are
learned from the corpus, without a list: words that stand before a period much more often than chance lets expect, by
the log-likelihood ratio of word and period, weighted down for long words and for occurrences without a
period, up for periods inside.  Words that begin sentences more often than chance (a second ratio) are the
frequent starters; after an abbreviation or initial only these begin a new sentence.

Learning is two aggregations over the tokens (combined in the tasks) and two tables that are joined to the pieces between
marks; no text is moved but by document.

Defined cases: null and empty texts have no sentences; a corpus without periods, or with nothing but words before
periods, has no abbreviations; U+0001 counts as a space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarq.functions.text import SENT_MARK, explode_rows
from scholarq.operators.tfidf import by_document
from scholarq.session import removed, written

# Fixed values of the published method.
PERIOD_GIVEN_ABBREVIATION = 0.99
ABBREVIATION_FROM = 0.3
STARTER_FROM = 30.0

WORD = r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"  # periods inside, as in "e.g."


@dataclass(frozen=True)
class Boundaries:
    """``abbreviations`` (word, n_dot, n_plain, score) and ``starters`` (word, n_first, n, score)."""

    abbreviations: DataFrame
    starters: DataFrame


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n_dot, n_plain): lower-cased words with and without a period behind them."""
    tokens = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(WORD + r"\.?"), 0)
    dot = F.col("t").endswith(".")
    return (explode_rows(docs, [], tokens, "t")
            .groupBy(F.when(dot, F.expr("left(t, length(t) - 1)")).otherwise(F.col("t")).alias("word"))
            .agg(F.count_if(dot).alias("n_dot"), F.count_if(~dot).alias("n_plain")))


def _with_total(counts: DataFrame, **totals: Column) -> DataFrame:
    """Each row with the totals, a one-row table."""
    return counts.crossJoin(F.broadcast(counts.agg(*[c.alias(name) for name, c in totals.items()])))


def abbreviations(counts: DataFrame) -> DataFrame:
    """The words whose weighted ratio reaches ``ABBREVIATION_FROM``; numbers are none."""
    all_ = _with_total(counts, dots=F.sum("n_dot"), n=F.sum(F.col("n_dot") + F.col("n_plain")))
    chance = F.col("dots") / F.col("n")
    ratio = 2 * (F.col("n_dot") * (F.log(F.lit(PERIOD_GIVEN_ABBREVIATION)) - F.log(chance))
                 + F.col("n_plain") * (F.log(F.lit(1 - PERIOD_GIVEN_ABBREVIATION)) - F.log(1 - chance)))
    size = F.length(F.replace("word", F.lit("."))).cast("double")
    periods = F.length("word") - size
    score = ratio * (periods + 1) * F.exp(-size - F.col("n_plain") * F.log(size))
    return (all_.filter(F.col("dots").between(1, F.col("n") - 1) & (F.col("n_dot") > 0) & F.col("word").rlike(r"\p{L}"))
            .select("word", "n_dot", "n_plain", score.alias("score")).filter(F.col("score") >= ABBREVIATION_FROM))


def pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, pos, piece, last, initial, first): texts cut behind each mark and its white space, which stay on the
    piece; the word before a closing period (else empty), whether it is one capital letter, and the word at the start."""
    text = F.translate(F.col(text_col), SENT_MARK, " ")
    cut = F.split(F.regexp_replace(text, r"([.!?]\s+)", "$1" + SENT_MARK), SENT_MARK)
    rows = explode_rows(docs, [id_col], cut, "piece", "pos").filter("piece <> ''")
    # Read from the end, so that the pattern is tried at one place only.
    last = F.reverse(F.regexp_extract(F.reverse(F.lower("piece")), r"^\s+\.(" + WORD + ")", 1))
    return rows.withColumns({
        "last": last, "initial": (F.length(last) == 1) & F.col("piece").rlike(r"\p{Lu}\.\s+$"),
        "first": F.regexp_extract("piece", "^(" + WORD + ")", 1)})


def _followed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Pieces with ``next``, the first word of the piece behind (null at the end of a text)."""
    rows = pieces(by_document(docs.select(id_col, text_col), id_col), id_col, text_col)
    return rows.withColumn("next", F.lead("first").over(Window.partitionBy(id_col).orderBy("pos")))


def _flagged(rows: DataFrame, short: DataFrame) -> DataFrame:
    known = short.select(F.col("word").alias("last"), F.lit(True).alias("abbreviation"))
    return rows.join(known, "last", "left").withColumn("abbreviation", F.coalesce("abbreviation", F.lit(False)))


def _capital(word: str) -> Column:
    return F.col(word).rlike(r"^\p{Lu}")


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    def times_log(a, b):
        return F.when(a == 0, F.lit(0.0)).otherwise(a * F.log(b))
    return times_log(k, p) + times_log(n - k, 1 - p)


def starters(counts: DataFrame, docs: DataFrame, id_col: str, text_col: str, short: DataFrame) -> DataFrame:
    """The capitalised words that follow a closing period (of no abbreviation or initial) more often than chance."""
    ends = _flagged(_followed(docs, id_col, text_col), short).filter(
        (F.col("last") != "") & ~F.col("abbreviation") & ~F.col("initial") & F.col("next").isNotNull())
    firsts = ends.groupBy(F.lower("next").alias("word"), _capital("next").alias("capital")).agg(F.count(F.lit(1)).alias("n_first"))
    firsts, _ = written(firsts, "first-words")  # a row for each word; its totals need it again
    firsts = _with_total(firsts, ends=F.sum("n_first")).filter("capital")
    words = _with_total(counts.select("word", (F.col("n_dot") + F.col("n_plain")).alias("n")), words=F.sum("n"))
    k, n1, c, n = (F.col(x).cast("double") for x in ("n_first", "ends", "n", "words"))
    ratio = 2 * (_likelihood(k, n1, k / n1) + _likelihood(c - k, n - n1, (c - k) / (n - n1))
                 - _likelihood(k, n1, c / n) - _likelihood(c - k, n - n1, c / n))
    return (firsts.join(words, "word").filter((n > n1) & (k / n1 > c / n))
            .select("word", "n_first", "n", ratio.alias("score")).filter(F.col("score") >= STARTER_FROM))


def learn(docs: DataFrame, id_col: str, text_col: str) -> Boundaries:
    """What the corpus tells, as tables stored in the shared folder, so that texts are tokenised once."""
    counts, path = written(word_counts(docs, text_col), "word-counts")
    short, _ = written(abbreviations(counts), "abbreviations")
    first, _ = written(starters(counts, docs, id_col, text_col, short), "starters")
    removed(docs.sparkSession, path)
    return Boundaries(short, first)


def split_sentences(docs: DataFrame, id_col: str, text_col: str, known: Boundaries) -> DataFrame:
    """(id, sent_idx, sentence): sentences numbered from 0, without white space around them. Ids are unique."""
    begins = known.starters.select(F.col("word").alias("_next"), F.lit(True).alias("starter"))
    rows = _flagged(_followed(docs, id_col, text_col), known.abbreviations).withColumn("_next", F.lower("next"))
    rows = rows.join(begins, "_next", "left")
    new_after_short = F.coalesce("starter", F.lit(False)) & _capital("next")
    ends = (F.when(F.col("last") == "", True)
            .when(F.col("last").rlike(r"^\p{N}+$") & F.col("next").rlike(r"^\p{Ll}"), False)
            .when(F.col("abbreviation") | F.col("initial"), new_after_short)
            .otherwise(True))
    before = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("sent_idx", F.coalesce(F.sum(F.coalesce(ends, F.lit(True)).cast("long")).over(before), F.lit(0)))
    # the pieces of one sentence of one text
    whole = numbered.groupBy(id_col, "sent_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    sentence = F.regexp_replace(F.array_join("p.piece", ""), r"^\s+|\s+$", "")
    return whole.select(id_col, "sent_idx", sentence.alias("sentence")).filter("sentence <> ''")
