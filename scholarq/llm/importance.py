"""Importance resampling towards a target distribution (hashed word n-grams).

A document's features are its runs of 1 to ``most_words`` consecutive words. Each feature falls
into a bucket; a bucket's gain is the log ratio of its share in the target to its share in the
corpus, and a document's weight is the sum of the gains of its features. Documents are drawn without
replacement by adding Gumbel noise to the weight and taking the highest scores.

1. An untrained ``Split`` of the tokenizers library cuts the text, lowered in ASCII, by a regex and
   gives words with their offsets. Features are windows over those offset pairs, and the CRC of a
   feature's bytes names its bucket. Each document is read once; its buckets are written as one array of small integers.
2. Every task counts its arrays into one histogram; the histograms of all tasks are summed,
   for the corpus and for the target. Gains are one number for each bucket.
3. Weights are sums of gains over the written arrays. Scores are ranked by a range
   sort, so that no task holds all rows.

Defined cases: a null or empty text, or one without words, has no feature and weight 0; a null id
hashes as an empty string and sorts before others of its score; repeated rows are documents of their
own; an empty corpus gives an empty result, an empty target a histogram of zeros; long texts are
cut into pieces between words, windows cross the cuts; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from scholarq.llm.common import partitions, row_slices, stored, utf8
from scholarq.operators.ids import sequential_ids

BUCKETS = 10_000
MOST_WORDS = 1
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
#: A text is cut into words in pieces of about so many characters.
PIECE_CHARS = 1 << 16
#: Features whose buckets a task remembers.
KNOWN_FEATURES = 1 << 18
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPLIT = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


class Buckets(dict):
    """The bucket of each feature; remembers a bounded number of them."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, feature: str) -> int:
        if len(self) >= KNOWN_FEATURES:
            self.clear()
        self[feature] = found = zlib.crc32(feature.encode()) % self.size
        return found


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces that end between words."""
    at = 0
    while at < len(text):
        cut = _BETWEEN.search(text, at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else None
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def features(text: bytes, most_words: int = MOST_WORDS) -> Iterator[list[str]]:
    """The features of ``text``, in lists; the first list of each piece holds its words."""
    held: list[str] = []
    for piece in pieces(text.lower().decode()):
        found = _SPLIT.pre_tokenize_str(piece)
        yield [word for word, _ in found]
        if most_words > 1:
            words = held + [piece[start:end] for _, (start, end) in found]
            for n in range(2, most_words + 1):
                # windows that end in this piece
                yield [" ".join(words[i:i + n]) for i in range(max(0, len(held) - n + 1), len(words) - n + 1)]
            held = words[max(0, len(words) - most_words + 1):]


def n_words_and_buckets(text: bytes, known: Buckets, most_words: int = MOST_WORDS) -> tuple[int, np.ndarray]:
    """The number of words, and the sorted buckets of all features."""
    words, parts = 0, []
    for i, some in enumerate(features(text, most_words)):
        if i % most_words == 0:
            words += len(some)
        parts.append(np.fromiter(map(known.__getitem__, some), dtype=np.uint32, count=len(some)))
    return words, np.sort(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint32)


def bucketed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS,
             buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the buckets of all features of each text, as an array of unsigned integers."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in row_slices(batches):
            found = [n_words_and_buckets(t, known, most_words) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()),
                 pa.array([x.astype(kind).tobytes() for _, x in found], pa.binary())],
                ["doc_id", "n_words", "n_features", "buckets"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, FEATURES)


def arrays(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket arrays of a column end to end, and the length of each."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind), np.array([len(x) // kind.itemsize for x in rows], dtype=np.int64)


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in a table of ``bucketed``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in row_slices(batches):
            total += np.bincount(arrays(batch.column(0), buckets)[0], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own])], ["bucket", "n"])

    counts = np.zeros(buckets, dtype=np.int64)
    rows = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most ``buckets`` rows
        counts[r["bucket"]] = r["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(share in the target / share in the corpus)) of each bucket, with one added to each count."""
    n = len(corpus)
    all_s, all_t = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_s / ((s + 1.0) * all_t)))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighted(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for a table of ``bucketed``."""
    shared = found.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in row_slices(batches):
            flat, lengths = arrays(batch.column(3), len(own))
            upto = np.concatenate([[0], np.cumsum(own[flat])])
            ends = np.cumsum(lengths)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(upto[ends] - upto[ends - lengths])],
                                             ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noisy(seed: int = SEED):
    """Gumbel noise of a document, from its id and the seed alone; in thousandths, as the weight."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", most_words: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED,
             least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Every document with n_features, weight, score and its rank among the drawn ones (null: not drawn).

    Drawn are ``percent`` of the documents of at least ``least_words`` words, by falling score, then smaller id.
    """
    found = stored(bucketed(docs, id_col, text_col, most_words, buckets), "buckets")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text_col).alias("text"))
    gain = gains(histogram(found, buckets), histogram(bucketed(wanted, most_words=most_words, buckets=buckets), buckets))
    n_drawn = percent * found.filter(F.col("n_words") >= least_words).count() // 100
    scored = weighted(found, gain).select(
        "doc_id", "n_features", "weight", (F.col("weight") + noisy(seed)).alias("score"),
        (F.col("n_words") < least_words).alias("out"),
        # tells rows apart that are equal in all else, so that a range of them can be split
        F.monotonically_increasing_id().alias("row"))
    ranked = sequential_ids(scored.withColumn("falling", -F.col("score")), ["out", "falling", "doc_id", "row"], id_col="place",
                            num_partitions=partitions(docs.sparkSession))
    return ranked.select("doc_id", "n_features", "weight", "score",
                         F.when(F.col("place") <= n_drawn, F.col("place")).alias("rank"))


#: DuckDB has no CRC: it is computed byte by byte, for each distinct word.
SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
texts AS (
  SELECT 'd' AS side, row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words
  FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), NULL,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')
  FROM benchmark),
counts AS (SELECT side, row, word, count(*) AS n FROM (SELECT side, row, unnest(words) AS word FROM texts) GROUP BY ALL),
walk(word, bytes, c) AS (
  SELECT word, hex(encode(word)), 4294967295::BIGINT FROM (SELECT DISTINCT word FROM counts)
  UNION ALL
  SELECT w.word, w.bytes[3:], xor(w.c >> 8, b.c)
  FROM walk w JOIN bits b ON b.k = 8 AND b.i = xor(w.c, ('0x' || w.bytes[1:2])::BIGINT) & 255
  WHERE w.bytes <> ''),
bucket AS (SELECT word, xor(c, 4294967295) % {BUCKETS} AS bucket FROM walk WHERE bytes = ''),
hist AS (
  SELECT bucket, sum(n) FILTER (side = 'd') AS s, sum(n) FILTER (side = 'b') AS t
  FROM counts JOIN bucket USING (word) GROUP BY bucket),
total AS (
  SELECT coalesce(sum(len(words)) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(len(words)) FILTER (side = 'b'), 0)::DOUBLE AS t FROM texts),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(h.t, 0)::DOUBLE + 1) * (total.s + {BUCKETS})
                                 / ((coalesce(h.s, 0)::DOUBLE + 1) * (total.t + {BUCKETS}))))::BIGINT AS g
  FROM hist h, total),
weights AS (SELECT row, sum(n * g)::BIGINT AS weight FROM counts JOIN bucket USING (word) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT::DOUBLE
                                                      + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weights USING (row) WHERE side = 'd'),
places AS (
  SELECT *, row_number() OVER (ORDER BY n_features < {LEAST_WORDS}, score DESC, doc_id NULLS FIRST) AS place,
         count(*) FILTER (n_features >= {LEAST_WORDS}) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM places
"""
