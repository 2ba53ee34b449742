"""Lexicon sentiment for documents and sentences (C5: SEN1-8).

A lexicon-and-rules scorer in the style of Hutto & Gilbert (2014): each
token gets its lexicon valence; a token in capitals among others in small
letters counts more; a booster (or dampener) up to three tokens before it
moves the valence away from (or towards) zero, less the farther it is; a
negator among the three tokens before it flips and damps it; exclamation
marks move the sum away from zero.  Per text: compound = s / sqrt(s^2 + alpha)
with s the sum of valences; pos/neg are the shares of sum(v+1 | v>0),
sum(v-1 | v<0) and the count of neutral tokens.  Polarity = compound,
subjectivity = (pos + neg) / 2, label by +-0.3.

One pass: a text is scored in its row, from the codes of its distinct tokens; a lexicon given as a
table of any size is joined to the exploded tokens instead.  Neither the sums nor the texts are joined back.  The reference's
statistical sentence splitter and the library's own lexicon are not
reproduced; lexicons are inputs, as DataFrames or small dictionaries.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarq.functions.text import WORD, explode_rows, sentences
from scholarq.operators.tfidf import by_document

# Fixed values of the published method (Hutto & Gilbert 2014).
NEGATION_SCALAR = -0.74
BOOSTER_INCREMENT = 0.293
CAPITALS_INCREMENT = 0.733
EXCLAMATION_INCREMENT = 0.292
MOST_EXCLAMATIONS = 4
DISTANCE_SCALARS = (1.0, 0.95, 0.9)
NORMALISATION_ALPHA = 15.0
# Label cut-offs (strict inequalities; +-0.3 itself is Neutral).
POSITIVE_ABOVE = 0.3
NEGATIVE_BELOW = -0.3
#: Texts that a task scores at once.
TEXTS_AT_ONCE = 256
SUMS = "struct<_sum: double, _ps: double, _ns: double, _neu: double>"


@dataclass(frozen=True)
class Lexicon:
    """Valences as a dictionary, or as a (token, valence) DataFrame of any size."""

    valences: dict[str, float] | DataFrame
    negators: tuple[str, ...] = ()
    boosters: tuple[str, ...] = ()
    dampeners: tuple[str, ...] = ()
    pattern: str = field(default=WORD)

    def dataframe(self, spark) -> DataFrame:
        df = self.valences
        if not isinstance(df, DataFrame):
            df = spark.createDataFrame(sorted(df.items()), "token string, valence double")
        return df.select(F.lower("token").alias("_t"), F.col("valence").cast("double").alias("_base"))

    def plain(self) -> dict[str, float] | None:
        """The valences by lower-cased token; None for a table, or if tokens differ in case only (each then counts)."""
        if isinstance(self.valences, DataFrame):
            return None
        low = {t.lower(): float(v or 0.0) for t, v in self.valences.items()}
        return low if len(low) == len(self.valences) else None


def _context(toks: Column, low: Column, lex: Lexicon, i: Column) -> list[Column]:
    """Context of token i: boost (sum of increments of the three tokens
    before it), whether a negator is among them, whether it is in capitals."""
    boost = F.lit(0.0)
    for back, scalar in enumerate(DISTANCE_SCALARS, 1):
        before = F.get(low, i - back)
        boost = boost + (F.when(before.isin(*lex.boosters), F.lit(scalar * BOOSTER_INCREMENT))
                         .when(before.isin(*lex.dampeners), F.lit(-scalar * BOOSTER_INCREMENT)).otherwise(F.lit(0.0)))
    negated = F.lit(False)
    for back in range(1, len(DISTANCE_SCALARS) + 1):
        negated = negated | F.coalesce(F.get(low, i - back).isin(*lex.negators), F.lit(False))
    t = F.get(toks, i)
    return [boost.alias("boost"), negated.alias("negated"), ((t == F.upper(t)) & (t != F.lower(t))).alias("capitals")]


def _adjust(base: Column, c: Column, mixed: Column) -> Column:
    """The valence of a token after the rules; 0 stays 0."""
    v = base + F.signum(base) * (F.when(c["capitals"] & mixed, CAPITALS_INCREMENT).otherwise(0.0) + c["boost"])
    return F.when(base == 0, F.lit(0.0)).when(c["negated"], v * NEGATION_SCALAR).otherwise(v)


def _tokenised(df: DataFrame, key_cols: list[str], text_col: str, lex: Lexicon) -> DataFrame:
    """(key_cols, _text, _toks, _bangs)."""
    d = df.select(*key_cols, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    bangs = F.least(F.lit(MOST_EXCLAMATIONS), F.length("_text") - F.length(F.translate("_text", "!", "")))
    return d.withColumns({"_toks": F.regexp_extract_all("_text", F.lit(lex.pattern), 0), "_bangs": bangs * EXCLAMATION_INCREMENT})


def _scored(tokens: pa.ListArray, valences: dict[str, float], lex: Lexicon) -> list[np.ndarray]:
    """The sums of ``SUMS`` for each list of tokens."""
    sizes = np.diff(tokens.offsets.to_numpy())
    row = np.repeat(np.arange(len(sizes)), sizes)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    coded = tokens.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    low = [w.lower() for w in words]
    base = np.array([valences.get(t, 0.0) for t in low], dtype=float)
    shift = np.array([1.0 if t in lex.boosters else -1.0 if t in lex.dampeners else 0.0 for t in low])
    negator = np.array([t in lex.negators for t in low], dtype=bool)
    plain = np.array([w != w.upper() for w in words], dtype=bool)
    capitals = np.array([w == w.upper() and w != t for w, t in zip(words, low, strict=True)], dtype=bool)
    mixed = np.zeros(len(sizes), dtype=bool)
    mixed[row[plain[codes]]] = True
    at = np.flatnonzero(base[codes])
    own, boost, negated = base[codes[at]], np.zeros(len(at)), np.zeros(len(at), dtype=bool)
    for back, scalar in enumerate(DISTANCE_SCALARS, 1):
        inside = at - back >= first[at]
        before = codes[np.where(inside, at - back, at)]
        boost += np.where(inside, shift[before] * (scalar * BOOSTER_INCREMENT), 0.0)
        negated |= inside & negator[before]
    v = own + np.sign(own) * (np.where(capitals[codes[at]] & mixed[row[at]], CAPITALS_INCREMENT, 0.0) + boost)
    v = np.where(negated, v * NEGATION_SCALAR, v)
    def total(x):
        return np.bincount(row[at], weights=x, minlength=len(sizes))
    return [total(v), total(np.where(v > 0, v + 1, 0.0)), total(np.where(v < 0, v - 1, 0.0)), sizes - total((v != 0).astype(float))]


def _row_parts(df: DataFrame, key_cols: list[str], text_col: str, lex: Lexicon, valences: dict[str, float]) -> DataFrame:
    """(key_cols, _text, _bangs and the columns of ``SUMS``) of each text, scored in its row."""
    def run(toks: pa.Array) -> pa.Array:
        found = [_scored(toks.slice(i, TEXTS_AT_ONCE), valences, lex) for i in range(0, len(toks), TEXTS_AT_ONCE)]
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 4
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], ["_sum", "_ps", "_ns", "_neu"])

    run.__annotations__ = {"toks": pa.Array, "return": pa.Array}
    scores = F.arrow_udf(run, SUMS)(F.col("_toks"))
    return _tokenised(df, key_cols, text_col, lex).withColumn("_p", scores).select(*key_cols, "_text", "_bangs", "_p.*")


def _joined_parts(df: DataFrame, key_cols: list[str], text_col: str, lex: Lexicon) -> DataFrame:
    """As ``_row_parts``, with the lexicon joined to the tokens; a text's tokens are summed with their neighbours."""
    d = _tokenised(by_document(df, key_cols[0]), key_cols, text_col, lex).withColumn("_low", F.transform("_toks", F.lower))
    toks, low = F.col("_toks"), F.col("_low")
    # Once per text, on its first token's row (a text without tokens has one row, too).
    once = F.struct(F.col("_bangs").alias("bangs"), F.col("_text").alias("text"))
    ctx = F.transform(low, lambda t, i: F.struct(t.alias("_t"), *_context(toks, low, lex, i)))
    # Capitals stand out only where not all words are in capitals.
    mixed = F.exists(toks, lambda t: t != F.upper(t))
    rows = d.select(*key_cols, once.alias("_once"), mixed.alias("_mixed"), F.posexplode_outer(ctx).alias("_pos", "_c"))
    rows = rows.select(*key_cols, F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_once")).alias("_once"), "_mixed", "_c",
                       F.col("_c._t").alias("_t"))
    v = F.coalesce(_adjust(F.col("_base"), F.col("_c"), F.col("_mixed")), F.lit(0.0))
    scored = rows.join(lex.dataframe(df.sparkSession), "_t", "left").select(
        *key_cols, "_once", F.when(F.col("_t").isNotNull(), v).alias("_v"))
    return scored.select(
        *key_cols, F.col("_once.text").alias("_text"), F.col("_once.bangs").alias("_bangs"), F.coalesce("_v", F.lit(0.0)).alias("_sum"),
        F.when(F.col("_v") > 0, F.col("_v") + 1).otherwise(F.lit(0.0)).alias("_ps"),
        F.when(F.col("_v") < 0, F.col("_v") - 1).otherwise(F.lit(0.0)).alias("_ns"),
        F.when(F.col("_v") == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("_neu"))


def score_columns(df: DataFrame, key_cols: list[str], text_col: str, lex: Lexicon, out_col: str = "s",
                  text_out: str | None = None) -> DataFrame:
    """(key_cols, out_col struct<polarity, subjectivity, pos, neg>) for the text
    of each key, and the text itself as ``text_out`` if asked for.  Keys must be unique."""
    valences = lex.plain()
    parts = _joined_parts(df, key_cols, text_col, lex) if valences is None else _row_parts(df, key_cols, text_col, lex, valences)
    if text_out:  # one sort by key, behind the exchange
        parts = parts.repartition(*key_cols)
    sums = parts.groupBy(*key_cols).agg(
        F.sum("_sum").alias("_sum"), F.sum("_ps").alias("_ps"), F.sum("_ns").alias("_ns"), F.sum("_neu").alias("_neu"),
        F.max("_bangs").alias("_bangs"), *([F.max("_text").alias(text_out)] if text_out else []))
    bang = F.col("_bangs")
    sums = sums.withColumns({
        "_sum": F.col("_sum") + F.signum("_sum") * bang,
        "_ps": F.col("_ps") + F.when(F.col("_ps") > F.abs("_ns"), bang).otherwise(0.0),
        "_ns": F.col("_ns") - F.when(F.col("_ps") < F.abs("_ns"), bang).otherwise(0.0)})
    s, ps, ns = F.col("_sum"), F.col("_ps"), F.col("_ns")
    total = ps + F.abs(ns) + F.col("_neu")
    compound = F.when(s == 0, F.lit(0.0)).otherwise(
        F.least(F.greatest(s / F.sqrt(s * s + NORMALISATION_ALPHA), F.lit(-1.0)), F.lit(1.0)))
    pos = F.when(total > 0, F.round(F.abs(ps / total), 3)).otherwise(F.lit(0.0))
    neg = F.when(total > 0, F.round(F.abs(ns / total), 3)).otherwise(F.lit(0.0))
    return sums.select(*key_cols, *([text_out] if text_out else []),
                       F.struct(F.round(compound, 4).alias("polarity"), ((pos + neg) / 2).alias("subjectivity"),
                                pos.alias("pos"), neg.alias("neg")).alias(out_col))


def label(polarity: Column) -> Column:
    """SEN6."""
    return (F.when(polarity > POSITIVE_ABOVE, "Positive")
            .when(polarity < NEGATIVE_BELOW, "Negative").otherwise("Neutral"))


def split_sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """SEN1: (id, sent_idx, sentence); pieces trimmed of surrounding
    whitespace, empty ones dropped (indices keep their original position)."""
    return (explode_rows(docs, [id_col], sentences(F.col(text_col)), "sentence", "sent_idx")
            .withColumn("sentence", F.regexp_replace("sentence", r"^\s+|\s+$", ""))
            .filter(F.col("sentence") != ""))


def document_sentiment(docs: DataFrame, id_col: str, text_col: str, lex: Lexicon) -> DataFrame:
    """SEN4 + SEN6: the whole text is scored once (not the mean of its
    sentences)."""
    return (score_columns(docs, [id_col], text_col, lex)
            .select(id_col, F.col("s.polarity").alias("polarity"), F.col("s.subjectivity").alias("subjectivity"),
                    label(F.col("s.polarity")).alias("label")))


def sentence_sentiment(docs: DataFrame, id_col: str, text_col: str, lex: Lexicon) -> DataFrame:
    """SEN5: one row per sentence with polarity and subjectivity."""
    sents = split_sentences(docs, id_col, text_col)
    return (score_columns(sents, [id_col, "sent_idx"], "sentence", lex, text_out="sentence")
            .select(id_col, "sent_idx", "sentence", F.col("s.polarity").alias("polarity"),
                    F.col("s.subjectivity").alias("subjectivity")))


def attach_sentiment(results: DataFrame, text_col: str, lex: Lexicon, key_cols: list[str]) -> DataFrame:
    """SEN7: label and score (rounded to 2) of each result's text; a result
    without text gets label 'N/A' and a NULL score.  ``key_cols`` are unique
    per result; only the keys and scores are joined to the results."""
    has = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    scored = score_columns(results.filter(has), key_cols, text_col, lex, "_s")
    return (results.join(scored, key_cols, "left")
            .withColumn("sentiment_label", F.when(F.col("_s").isNotNull(), label(F.col("_s.polarity"))).otherwise(F.lit("N/A")))
            .withColumn("sentiment_score", F.round(F.col("_s.polarity"), 2))
            .drop("_s"))


def paper_sentiment(texts: DataFrame, paper_id, lex: Lexicon, id_col: str = "paper_id",
                    text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """SEN8: (overall, sentences) of one paper; empty frames when absent."""
    one = texts.filter(F.col(id_col) == F.lit(paper_id))
    return document_sentiment(one, id_col, text_col, lex), sentence_sentiment(one, id_col, text_col, lex)
