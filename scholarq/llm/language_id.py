"""Language identification by hierarchical discrimination.

First the language family is predicted, then the language within it. Both steps vote
over one-versus-one linear support vector machines: between families, and between
the languages of a family. Features are relative frequencies of hashed byte pairs and
triples of the lower-cased words; language tag, source and id are never inputs.

Training takes a bounded sample: about ``sample_rows`` documents for each language, chosen by a
hash of the id, with at most ``sample_chars`` characters from the middle of each (the bound of
training only; predictions read whole texts). Machines are fitted by dual coordinate
descent on the driver over that bounded sample.

Defined cases: a null text or one without a letter gives ``und`` with score 0; rows
without a language are not learned from; a table with nothing to learn from gives ``und``
everywhere; one learned language is predicted for all texts with letters; ties in
votes go to the larger margin, then to the smaller name; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.llm.common import utf8

#: Languages by family; a language that is not listed is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ca": "romance", "ro": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "bg": "slavic", "sr": "slavic",
}
BUCKET_BITS = 13
SAMPLE_ROWS = 600
SAMPLE_CHARS = 4000
HELD_OUT_FOLD, FOLDS = 2, 4
LETTER = regex.compile(r"\p{L}")
#: Bytes that are no part of a word become one separator; capitals become small.
FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], dtype=np.uint32)


def features(text: bytes) -> np.ndarray:
    """Hashed pairs and triples of the folded bytes, one number per position and size."""
    x = FOLD[np.frombuffer(b" " + text + b"  ", dtype=np.uint8)]
    pairs = x[:-1] * np.uint32(256) + x[1:]
    inside = x[:-1] != 32
    triples = (pairs[:-1] * np.uint32(0x9E3779B1)) ^ (x[2:] * np.uint32(0x85EBCA6B))
    shift = np.uint32(32 - BUCKET_BITS)
    h = np.concatenate([(pairs[inside] * np.uint32(0xC2B2AE35)) >> shift, (triples[inside[:-1]] * np.uint32(0x27D4EB2F)) >> shift])
    return h.astype(np.int64)


def vector(text: bytes) -> np.ndarray:
    h = features(text)
    v = np.bincount(h, minlength=1 << BUCKET_BITS).astype(np.float64)
    return np.sqrt(v / max(1, len(h)))


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the bias) of a linear machine with hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.full((len(x), 1), 0.3)])
    norms, alpha, w = (x * x).sum(1), np.zeros(len(x)), np.zeros(x.shape[1])
    rng = np.random.default_rng(8)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(x)):
            new = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i], 0.0), c)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


class Hierarchy:
    """Machines for each pair of families and for each pair of languages of a family."""

    def __init__(self, vectors: np.ndarray, langs: list[str], families: dict[str, str]):
        family = [families.get(x, x) for x in langs]
        self.languages = {f: sorted({x for x, g in zip(langs, family, strict=True) if f == g}) for f in sorted(set(family))}
        tests = [("", sorted(self.languages), family)] + [(f, ls, langs) for f, ls in self.languages.items()]
        self.pairs: list[tuple[str, str, str]] = []
        weights = []
        for group, names, own in tests:
            own = np.array(own)
            for a, b in combinations(names, 2):
                rows = np.flatnonzero((own == a) | (own == b))
                weights.append(fit_svm(vectors[rows], np.where(own[rows] == a, 1.0, -1.0)))
                self.pairs.append((group, a, b))
        self.weights = np.array(weights) if weights else np.zeros((0, (1 << BUCKET_BITS) + 1))

    def _vote(self, group: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        votes, sums = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (g, a, b), m in zip(self.pairs, margins.tolist(), strict=True):
            if g == group:
                votes[a if m >= 0 else b] += 1
                sums[a] += m
                sums[b] -= m
        best = max(sorted(names), key=lambda n: (votes[n], sums[n]))
        least = min(m if a == best else -m for (g, a, b), m in zip(self.pairs, margins.tolist(), strict=True)
                    if g == group and best in (a, b))
        return best, float(1 / (1 + np.exp(-np.clip(2 * least, -30, 30))))

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text.decode()):
            return "und", 0.0
        margins = self.weights[:, :-1] @ vector(text) + 0.3 * self.weights[:, -1]
        family, p = self._vote("", list(self.languages), margins)
        lang, q = self._vote(family, self.languages[family], margins)
        return lang, p * q


def fold(id_col) -> F.Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS, F.lit(0))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          families: dict[str, str] | None = None, sample_rows: int = SAMPLE_ROWS,
          sample_chars: int = SAMPLE_CHARS) -> Hierarchy:
    """Fit on rows outside the held-out fold that have a language."""
    known = docs.filter((fold(F.col(id_col)) != HELD_OUT_FOLD) & F.col(lang_col).isNotNull())
    n = F.create_map(*[F.lit(v) for r in known.groupBy(F.col(lang_col).alias("l")).count().collect()
                       for v in (r["l"], float(r["count"]))] or [F.lit(""), F.lit(1.0)])
    uniform = F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 20)) / float(1 << 20)
    middle = F.substring(text_col, F.greatest(F.lit(1), (F.length(text_col) / 2).cast("int") - sample_chars // 2), F.lit(sample_chars))
    rows = known.filter(uniform * n[F.col(lang_col)] < sample_rows).select(middle.alias("t"), F.col(lang_col).alias("l")).collect()
    rows = [(r["t"].encode(), r["l"]) for r in rows if r["t"] and LETTER.search(r["t"])]
    vectors = np.array([vector(t) for t, _ in rows]).reshape(len(rows), 1 << BUCKET_BITS)
    return Hierarchy(vectors, [x for _, x in rows], FAMILIES if families is None else families)


def identify(docs: DataFrame, model: Hierarchy, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of each document, from its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages^2 * 2^BUCKET_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def predictions(docs: DataFrame) -> DataFrame:
    return identify(docs, learn(docs)).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT_FOLD).alias("held_out"), "lang_pred", "score")
