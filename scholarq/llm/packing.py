"""Cost-balanced packing of documents into training sequences.

Tasks tokenise their rows in blocks of a fixed number of tokens and pack each block
by itself, so nothing is shuffled and memory is bounded by the block. Within a
block a document's full sequences stand alone; what remains of each document is
assigned, longest first, to the sequence of lowest estimated cost that still has
room. The cost of a piece is linear plus quadratic in its length (attention). Pieces
that fit nowhere are cut to fill the gaps, so a block leaves less than one
sequence of padding.

Sequence ids are the task's partition number times 2^32 plus a counter; a task that
runs again gives the same ids.

Defined cases: a null or empty text is the end token alone; a null id stays null;
repeated rows are packed each; an empty table gives an empty result; extra columns
are not read. A very long text is tokenised as a whole and cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.llm.common import row_slices, utf8
from scholarq.llm.tokens import chunk_cache, vocabulary_path

CAPACITY = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
#: A piece of this many tokens costs as much in attention as in all else.
EVEN_LENGTH = 4096
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def cost(length):
    return length + length * length / EVEN_LENGTH


def place(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items with these lengths."""
    pieces, sequences, rest = [], 0, []
    for item, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((item, start, capacity, sequences, 0))
            sequences += 1
        if n % capacity:
            rest.append((n % capacity, item, n - n % capacity))
    total = sum(n for n, _, _ in rest)
    if not total:
        return pieces
    room = np.full(-(-total // capacity), capacity, dtype=np.int64)
    load = np.zeros(len(room))

    def put(item, start, n, k):
        pieces.append((item, start, n, sequences + int(k), int(capacity - room[k])))
        room[k] -= n
        load[k] += cost(n)

    unplaced = []
    for n, item, start in sorted(rest, key=lambda x: (-x[0], x[1])):
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(item, start, n, fits[np.argmin(load[fits])])
        else:
            unplaced.append((n, item, start))
    for n, item, start in unplaced:
        while n:
            k = int(np.argmax(room))
            part = min(n, int(room[k]))
            put(item, start, part, k)
            n, start = n - part, start + part
    return pieces


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
         capacity: int = CAPACITY, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each piece, with its ids as little-endian unsigned 32-bit integers."""
    path = vocabulary or vocabulary_path()
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def packed(first: int, ids: list, tokens: list[bytes]) -> tuple[pa.RecordBatch, int]:
        placed = place([len(t) // 4 for t in tokens], capacity)
        columns = [[] for _ in range(7)]
        for item, start, n, sequence, offset in placed:
            row = (ids[item], start, n, tokens[item][4 * start:4 * (start + n)], len(tokens[item]) // 4,
                   first + sequence, offset)
            for c, v in zip(columns, row, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        return batch, max(p[3] for p in placed) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache, following = chunk_cache(path), TaskContext.get().partitionId() << 32
        ids, tokens, size = [], [], 0
        for part in row_slices(batches):
            for doc_id, t in zip(part.column(0).to_pylist(), cache.encode(utf8(part.column(1))), strict=True):
                ids.append(doc_id)
                tokens.append(t + end)
                size += len(t) // 4 + 1
                if size >= block_tokens:
                    batch, used = packed(following, ids, tokens)
                    following += used
                    ids, tokens, size = [], [], 0
                    yield batch
        if ids:
            yield packed(following, ids, tokens)[0]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def pieces(docs: DataFrame) -> DataFrame:
    return pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
