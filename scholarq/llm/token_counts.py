"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text longer than a chunk is encoded as overlapping chunks with offsets. Two
neighbouring encodings are spliced at a common boundary that is proven stable: a
position inside the overlap where both have a token start and the character before
it is ASCII white space, across which the vocabulary's pre-tokenizer never joins.
Up to there the left encoding is right, from there on the right one is. When
the overlap has no such position it is widened; when the whole left chunk has none,
the chunk grows, up to the whole text.

Memory is bounded by a chunk's encoding, unless a text has no white space at all.

Defined cases: null and empty texts have no tokens; the vocabulary's special strings
inside texts are one token each, as by the library's default; repeated rows are
counted each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.llm.common import SPACE_CHARS, row_slices, utf8
from scholarq.llm.tokens import chunk_cache, tokenizer, vocabulary_path

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
LIMIT = 2048


def _encoded(t, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and start positions in ``text`` of the tokens of text[start:end]."""
    e = t.encode(text[start:end], add_special_tokens=False)
    return np.asarray(e.ids, dtype="<u4"), np.asarray([o[0] for o in e.offsets], dtype=np.int64) + start


def _stable(text: str, left: np.ndarray, right: np.ndarray, low: int) -> int | None:
    """The first position after ``low`` where both encodings start a token behind white space."""
    for p in np.intersect1d(left, right).tolist():
        if p > low and text[p - 1] in SPACE_CHARS:
            return p
    return None


def encode_long(t, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[np.ndarray]:
    """Ids of ``text`` in pieces, equal in sum to the library's for the whole text."""
    begin, end = 0, min(chunk, len(text))
    ids, starts = _encoded(t, text, begin, end)
    while end < len(text):
        width = overlap
        while True:
            at = max(begin, end - width)
            following = min(len(text), at + max(chunk, 2 * width))
            ids2, starts2 = _encoded(t, text, at, following)
            p = _stable(text, starts, starts2, at)
            if p is not None or at == begin:
                break
            width *= 2
        if p is None:  # no white space in the whole chunk: encode it together with more
            end = min(len(text), begin + 2 * (end - begin))
            ids, starts = _encoded(t, text, begin, end)
            continue
        yield ids[starts < p]
        keep = starts2 >= p
        ids, starts, begin, end = ids2[keep], starts2[keep], p, following
    yield ids


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
          chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each document."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, t = chunk_cache(path), tokenizer(path)
        for part in row_slices(batches):
            texts = utf8(part.column(1))
            short = cache.encode([x if len(x) <= chunk else b"" for x in texts])
            n = [len(s) // 4 if len(x) <= chunk else sum(map(len, encode_long(t, x.decode(), chunk, overlap)))
                 for x, s in zip(texts, short, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long")


def counts(docs: DataFrame) -> DataFrame:
    return count(docs).withColumn("over_limit", F.col("n_tokens") > LIMIT)
