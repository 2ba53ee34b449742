"""Deep pages of a search without sorting all that it found (TOP3, AGG11).

A page far down an ordered result is found by its place: keys of a bounded sample cut the
order into ranges, one pass counts the rows of each range, and the running sum of these counts says
in which range a page starts and ends.  Only the keys of that range are sorted; the page's rows are
those between its first and last key.  Pages equal those of ``search.page`` at any depth, and the
counts give the total along with them.

The order is that of ``search.page``: relevance (if asked for), newest first, records without a
date last, then id.  Rows with equal keys lie in no defined order among themselves, but none is lost or shown twice
in number.  Null ids come before others; ids are ordered as text.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cuts in two levels: a row is compared with the coarse ones, then with those between two of them.
COARSE, FINE = 64, 64
_KEY = "struct<r:double,p:bigint,i:string>"
_UNDATED = (1 << 63) - 1


def _key(by_relevance: bool, id_col: str) -> Column:
    """Ascending in the order of the pages."""
    published = F.unix_micros(F.col("published").cast("timestamp"))
    return F.struct((-F.col("relevance_score") if by_relevance else F.lit(0.0)).cast("double").alias("r"),
                    F.coalesce(-published, F.lit(_UNDATED)).alias("p"), F.col(id_col).cast("string").alias("i"))


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps({"v": value})), f"struct<v:{kind}>")["v"]


def _plain(key) -> dict:
    return {"r": key["r"], "p": key["p"], "i": key["i"]}


class PageIndex:
    """Pages of ``matches``, a search's rows in any order. They are read once for the sample, once for the counts and
    about three times a page (the range's keys, its rows); store them first where the search itself is dear."""

    def __init__(self, matches: DataFrame, by_relevance: bool = False, id_col: str = "arxiv_id"):
        self.matches, self.by_relevance, self.key = matches, by_relevance, _key(by_relevance, id_col)
        # a uniform sample of fixed size: the rows of the smallest hashes
        hashed = matches.select(self.key.alias("k")).withColumn("h", F.xxhash64("k"))
        sample = [_plain(r["k"]) for r in hashed.orderBy("h").limit(COARSE * FINE).select("k").orderBy("k").collect()]
        self.cuts = [sample[i:i + FINE] for i in range(0, len(sample), FINE)]
        counts = {r["b"]: r["n"] for r in
                  matches.groupBy(self._range().alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        #: rows of each range; at most COARSE * FINE + 1 numbers
        self.counts = [counts.get(b, 0) for b in range(len(sample) + 1)]
        self._ends = list(accumulate(self.counts))
        self.total = self._ends[-1]

    def _range(self) -> Column:
        """The number of cuts at or before a row."""
        if not self.cuts:
            return F.lit(0)
        key, coarse = self.key, _literal([group[0] for group in self.cuts], f"array<{_KEY}>")
        fine = _literal(self.cuts, f"array<array<{_KEY}>>")
        group = F.size(F.filter(coarse, lambda c: c <= key))
        inside = F.size(F.filter(F.get(fine, group - 1), lambda c: c <= key))
        return F.when(group == 0, F.lit(0)).otherwise((group - 1) * FINE + inside)

    def _between(self, low: dict | None, high: dict | None, closed: bool) -> DataFrame:
        """The rows from ``low`` to ``high`` (with it if ``closed``); the dates' bounds reach the scan."""
        rows = self.matches
        if not self.by_relevance:
            if low and low["p"] != _UNDATED:
                newest = F.timestamp_micros(F.lit(-low["p"]))
                rows = rows.filter(F.col("published").isNull() | (F.col("published") <= newest))
            if high and high["p"] != _UNDATED:
                rows = rows.filter(F.col("published") >= F.timestamp_micros(F.lit(-high["p"])))
        if low:
            rows = rows.filter(self.key >= _literal(low, _KEY))
        if high:
            bound = _literal(high, _KEY)
            rows = rows.filter(self.key <= bound if closed else self.key < bound)
        return rows

    def page(self, start: int = 0, max_results: int = 10) -> DataFrame:
        """Rows ``start`` to ``start + max_results - 1``, in order; none past the end."""
        if start < 0 or max_results < 1:
            raise ValueError("start must be >= 0 and max_results >= 1")
        if start >= self.total:
            return self.matches.limit(0)
        first = bisect_right(self._ends, start)
        last = bisect_right(self._ends, min(start + max_results, self.total) - 1)
        flat = [cut for group in self.cuts for cut in group]
        held = self._between(flat[first - 1] if first else None, flat[last] if last < len(flat) else None, closed=False)
        skip = start - (self._ends[first - 1] if first else 0)
        keys = held.select(self.key.alias("k"))
        ends = keys.orderBy("k").offset(skip).limit(max_results).agg(F.min("k").alias("low"), F.max("k").alias("high")).first()
        low, high = _plain(ends["low"]), _plain(ends["high"])
        ahead = skip - keys.filter(F.col("k") < _literal(low, _KEY)).count()  # rows of the first key that an earlier page has
        rows = self._between(low, high, closed=True).orderBy(self.key)
        return (rows.offset(ahead) if ahead else rows).limit(max_results)

    def last_page(self, max_results: int = 10) -> DataFrame:
        return self.page((max(self.total, 1) - 1) // max_results * max_results, max_results)
