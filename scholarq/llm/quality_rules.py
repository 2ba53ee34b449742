"""Quality rules: a short-circuit cascade ordered by rejection per cost, both estimated on a sample.

A rule tests counts of a text. Counts are bound once, at the first rule that needs them, and a rule runs only on what the
earlier ones let through. One pass over a bounded sample tells, for each set of rules that reject a text, how many texts
and characters there are; from that table the order is built rule by rule: next comes the one that rejects most of the
texts still there for the cost of the counts not bound yet. Cost is characters times the count's own rate, so the same
sample always gives the same order. The order decides the cost, never the verdict.

Everything is a DataFrame expression; no Python runs on executors.

Defined cases: null and empty texts have no words and are rejected by
``few_words``; repeated rows get the same verdict each; an empty table gives an
empty result; all other columns pass through unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarq.llm.common import SPACE_CHARS, SPACE_CLASS, let

MIN_WORDS = 50
#: Rows of the sample from which cost and selectivity are estimated; it is aggregated as it is read and never held.
SAMPLE_ROWS = 2000


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "")).cast("long")


def n_symbols(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))


def n_dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


def n_repeat_words(text: Column) -> Column:
    return repeat_words(words(text))


def repeat_words(words_: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are hashed to 64 bits. Only a text with equal windows pays for the sort
    that brings them together; the words they cover follow from their sorted starts.
    """
    def windows(h):
        return F.when(F.size(h) >= 3, F.transform(
            F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)),
        )).otherwise(F.array().cast("array<bigint>"))

    def covered(w):
        by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        starts = let(by_hash, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda e, j: F.coalesce(F.get(s, j + 1)["x"] == e["x"], F.lit(False))
                     | ((j > 0) & F.coalesce(F.get(s, F.greatest(j - 1, F.lit(0)))["x"] == e["x"], F.lit(False)))),
            lambda e: e["i"])))
        return F.aggregate(
            starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
            lambda a: a["n"])

    hashes = F.transform(words_, lambda w: F.xxhash64(w))
    return let(let(hashes, windows), lambda w: F.when(
        F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(covered(w))).cast("long")


def letters(text: Column) -> Column:
    """Letters and combining marks, in code points."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{M}]+", ""))


def capitals(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Lu}]+", ""))


@dataclass(frozen=True)
class Count:
    """A value of a text: ``value(text, *of)`` from the text and other counts, at ``rate`` for a character."""

    value: Callable[..., Column]
    rate: float
    of: tuple[str, ...] = ()


#: Measured times for a character, as multiples of one translating pass over the text, and that of a test.
RATES = {"words": 1.0, "chars": 1.0, "symbols": 1.2, "lines": 0.1, "dup_lines": 0.1, "repeat_words": 3.0, "letters": 0.9,
         "capitals": 0.4}
TEST_RATE = 0.01

COUNTS = {
    "words": Count(words, RATES["words"]),
    "n_words": Count(lambda text, w: F.size(w).cast("long"), 0.0, ("words",)),
    "chars": Count(word_chars, RATES["chars"]),
    "symbols": Count(n_symbols, RATES["symbols"]),
    "lines": Count(worded_lines, RATES["lines"]),
    "n_lines": Count(lambda text, a: F.size(a), 0.0, ("lines",)),
    "dup_lines": Count(lambda text, a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"), RATES["dup_lines"], ("lines",)),
    "repeat_words": Count(lambda text, w: repeat_words(w), RATES["repeat_words"], ("words",)),
    "letters": Count(letters, RATES["letters"]),
    "capitals": Count(capitals, RATES["capitals"]),
}


@dataclass(frozen=True, eq=False)
class Rule:
    """Rejects where ``test`` of the counts ``needs`` of ``text`` is true."""

    name: str
    text: Column
    needs: tuple[str, ...]
    test: Callable[..., Column]

    def unbound(self, bound: Sequence[str]) -> list[str]:
        """Counts to bind before the rule can run, those that others are taken from first."""
        todo: list[str] = []

        def add(name: str) -> None:
            if name not in bound and name not in todo:
                for other in COUNTS[name].of:
                    add(other)
                todo.append(name)

        for name in self.needs:
            add(name)
        return todo


def default_rules(text: Column) -> list[Rule]:
    return [
        Rule("few_words", text, ("n_words",), lambda w: w < MIN_WORDS),
        Rule("repeated_windows", text, ("repeat_words", "n_words"), lambda r, w: 100 * r > 50 * w),
        Rule("symbols", text, ("symbols", "n_words"), lambda s, w: 10 * s > w),
        Rule("repeated_lines", text, ("dup_lines", "n_lines"), lambda d, n: 2 * d > n),
        Rule("word_length", text, ("chars", "n_words"), lambda c, w: (c < 3 * w) | (c > 10 * w)),
        Rule("few_letters", text, ("letters", "chars"), lambda a, c: 10 * a < 7 * c),
        Rule("shouting", text, ("capitals", "letters"), lambda u, a: 2 * u > a),
    ]


def _bind(text: Column, names: Sequence[str], bound: dict[str, Column], body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` with the counts ``names`` evaluated once each, in that order."""
    if not names:
        return body(bound)
    count = COUNTS[names[0]]
    return let(count.value(text, *[bound[o] for o in count.of]),
               lambda value: _bind(text, names[1:], {**bound, names[0]: value}, body))


def cascade(rules: Sequence[Rule], bound: dict[str, Column] | None = None) -> Column:
    """True where a text passes all rules; each rule, and each count, runs only if the earlier rules pass.
    ``bound`` are counts that are there already."""
    def step(at: int, bound: dict[str, Column]) -> Column:
        if at == len(rules):
            return F.lit(True)
        rule = rules[at]

        def verdict(bound: dict[str, Column]) -> Column:
            rejected = F.coalesce(rule.test(*[bound[n] for n in rule.needs]), F.lit(False))
            return F.when(rejected, F.lit(False)).otherwise(step(at + 1, bound))

        return _bind(rule.text, rule.unbound(bound), bound, verdict)

    return step(0, bound or {})


def order_rules(docs: DataFrame, rules: Sequence[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of the cascade, from one pass over a sample of ``docs``."""
    if not rules:
        return []
    share = min(1.0, sample_rows / max(1, docs.count()))
    sample = docs.sample(fraction=share, seed=9) if share < 1 else docs
    names = list(dict.fromkeys(n for r in rules for n in r.unbound([])))
    flags = _bind(rules[0].text, names, {}, lambda bound: F.array(*[
        F.coalesce(r.test(*[bound[n] for n in r.needs]), F.lit(False)) for r in rules]))
    seen = [(r["rejects"], r["texts"], r["chars"]) for r in sample.select(
        flags.alias("rejects"), F.coalesce(F.length(rules[0].text), F.lit(0)).alias("chars"))
        .groupBy("rejects").agg(F.count(F.lit(1)).alias("texts"), F.sum("chars").alias("chars")).collect()]
    order: list[int] = []
    bound: list[str] = []
    while len(order) < len(rules):
        left = [x for x in seen if not any(x[0][i] for i in order)]
        chars = 1 + sum(c for _, _, c in left)

        def gain(i: int) -> tuple[float, float]:
            cost = chars * (sum(COUNTS[n].rate for n in rules[i].unbound(bound)) + TEST_RATE)
            return sum(n for rejects, n, _ in left if rejects[i]) / cost, -cost

        best = max((i for i in range(len(rules)) if i not in order), key=lambda i: (gain(i), -i))
        order.append(best)
        bound += rules[best].unbound(bound)
    return [rules[i] for i in order]


def keep_good(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None,
              sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that a rule rejects; columns unchanged."""
    rules = default_rules(F.col(text_col)) if rules is None else rules
    return docs.filter(cascade(order_rules(docs.select(text_col), rules, sample_rows)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """All counts and the verdict for each document."""
    text = F.col(text_col)
    counted = docs.select(
        F.col(id_col).alias("doc_id"), text.alias("text"), n_words(text).alias("n_words"),
        word_chars(text).alias("word_chars"), n_symbols(text).alias("n_symbols"),
        n_dup_lines(text).alias("n_dup_lines"), n_repeat_words(text).alias("n_repeat_words"))
    order = [r.name for r in order_rules(docs.select(text_col), default_rules(text), sample_rows)]
    rules = {r.name: r for r in default_rules(F.col("text"))}
    known = {"n_words": F.col("n_words"), "chars": F.col("word_chars"), "symbols": F.col("n_symbols"),
             "dup_lines": F.col("n_dup_lines"), "repeat_words": F.col("n_repeat_words")}
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), cascade([rules[n] for n in order], known).alias("kept"))


#: DuckDB's form of ``score`` over ``documents``.
SQL = r"""
WITH w AS (
  SELECT rowid_, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM (SELECT row_number() OVER () AS rowid_, doc_id, coalesce(text, '') AS t FROM documents)
), tri AS (
  SELECT rowid_, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rowid_, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), rep AS (
  SELECT rowid_, count(DISTINCT p) AS n
  FROM (SELECT rowid_, unnest([i, i + 1, i + 2]) AS p
        FROM (SELECT rowid_, i, count(*) OVER (PARTITION BY rowid_, g) AS c FROM tri) WHERE c >= 2)
  GROUP BY rowid_
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         len(ls) AS n_lines, length(regexp_replace(t, '[^\p{L}\p{M}]+', '', 'g')) AS letters,
         length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS capitals
  FROM w LEFT JOIN rep USING (rowid_)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * letters < 7 * word_chars
            OR 2 * capitals > letters) AS kept
FROM m
"""
