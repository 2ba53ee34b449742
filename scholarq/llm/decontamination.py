"""Benchmark decontamination: documents that hold a benchmark item up to small edits.

Texts are sequences of words (small letters; ASCII signs are separators).
A document holds an item of L words if some run of its words is at an edit distance
(in words) of at most ``EDITS`` * L.

1. Item-sized windows start at each word of each whole text, for each length class of the items. An edit
   breaks two word pairs at most, so a window with too few pairs of the class's items cannot match and is passed over.
2. The CGK random walk embeds a window: each step emits the word under the pointer, and a random bit of step and
   word decides whether the pointer moves on. After an edit two walks meet again by chance, so a small edit
   distance gives a small Hamming distance. A walk has two steps a word and so crosses the whole window; half of the
   walks run from the window's start, half from its end, so that edits at one end leave the steps of the others alone.
3. Bit sampling: a table samples a few steps of a walk; equal samples make a candidate. The walks of a
   class are added until copies of its own items, edited to the full limit at the front, at the back, in
   one block and all over, are found with the target recall; an exact copy is always found.
4. Candidates are verified by exact edit distance (Myers' bit vectors) over all words
   that a run around the window can reach.

The benchmark is the stated query set: it is read in blocks of bounded size, each of
which is broadcast and run against all documents. Documents are not shuffled.

Defined cases: null and empty texts hold nothing; items without a word match nothing; repeated
items and documents are reported each; a null id stays null; empty tables give an
empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarq.llm.common import row_slices, utf8
from scholarq.llm.shingles import mixed, word_hashes

#: Edits per item word.
EDITS = 0.2
#: Recall wanted of items at their full distance, and the walks and tables that reach it: walks are added in
#: rounds up to a most, then doubled; each has some tables, and a table samples some steps.
TARGET_RECALL = 0.99
WALKS_A_ROUND, MOST_WALKS = 8, 96
TABLES_A_WALK, SAMPLES = 6, 3
#: Items of a class differ by at most this factor in length; windows are as long as the shortest.
CLASS_RATIO = 1.15
#: Items of a class that are edited to measure its recall.
MEASURED_ITEMS = 24
#: Windows embedded at once, times walks and steps.
HELD = 1 << 21
#: Bound of a block of the benchmark, in bytes of text.
BLOCK_BYTES = 8 << 20
PAIR_BITS = 22
HITS = "doc_id long, item_id long, distance long, item_words long, start_word long, end_word long"
#: ASCII signs become separators.
SEPARATED = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def folded(text: bytes) -> bytes:
    return text.decode().lower().encode().translate(SEPARATED)


def pair_hashes(words: np.ndarray) -> np.ndarray:
    return (mixed(words[:-1] * np.uint64(3) + words[1:], 7) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def distance_within(item: list[int], words: list[int]) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any run of ``words``, and where the first such run ends."""
    size = len(item)
    where: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        where[w] |= 1 << i
    mask, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score, best, end = mask, 0, size, size, 0
    for j, w in enumerate(words):
        eq = where.get(w, 0)
        x = eq | down
        d0 = ((((x & up) + up) ^ up) | x) & mask
        plus, minus = (down | ~(d0 | up)) & mask, up & d0
        score += 1 if plus & top else -1 if minus & top else 0
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = (minus | ~(d0 | plus)) & mask, plus & d0
        if score < best:
            best, end = score, j + 1
    return best, end


def edited(item: np.ndarray, wrong: int, kind: str, rng: np.random.Generator) -> np.ndarray:
    """``item`` with ``wrong`` words replaced, dropped or added: at its front or back, in one block, or all over."""
    words = item.tolist()
    if kind == "spread":
        places = rng.choice(len(words), wrong, replace=False)
    else:
        first = {"front": 0, "back": len(words) - wrong, "block": int(rng.integers(len(words) - wrong + 1))}[kind]
        places = np.arange(first, first + wrong)
    for p in sorted(places.tolist(), reverse=True):
        new = int(rng.integers(1, 2**63))
        words[p:p + 1] = ([new], [new], [], [words[p], new])[int(rng.integers(4))]
    return np.array(words, dtype=np.uint64)


KINDS = ("front", "back", "block", "spread")


class Walks:
    """Walks and tables for the items of one length class."""

    def __init__(self, items: list[np.ndarray], wrong: list[int], seed: int, recall: float = TARGET_RECALL):
        self.items, self.wrong = items, max(wrong)
        self.size = min(map(len, items))
        self.steps = 2 * self.size
        self.rng = np.random.default_rng(seed)
        self.bits = np.zeros((0, self.steps), dtype=np.uint64)
        self.samples = np.zeros((0, TABLES_A_WALK, min(SAMPLES, self.steps)), dtype=np.int64)
        words = np.concatenate(items)
        ends = np.cumsum([len(x) for x in items])
        self.own = words, ends - [len(x) for x in items], ends
        trials = self._trials(wrong) if self.wrong else None
        while len(self.bits) < MOST_WALKS:
            self._more()
            if trials is None or self._recall(*trials) >= recall:
                break
        if trials is not None:  # the trials are few: as many walks again
            for _ in range(len(self.bits) // WALKS_A_ROUND):
                self._more()
        keys = self._keys(*self.own).ravel()
        #: The keys of all tables in order, and their items.
        self.order = np.argsort(keys, kind="stable")
        self.keys, self.order = keys[self.order], self.order % len(items)

    def _more(self) -> None:
        n = WALKS_A_ROUND
        odd = self.rng.integers(1, 2**63, (n, self.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.bits = np.concatenate([self.bits, odd])
        some = [[np.sort(self.rng.choice(self.steps, self.samples.shape[2], replace=False)) for _ in range(TABLES_A_WALK)] for _ in range(n)]
        self.samples = np.concatenate([self.samples, np.array(some)])

    def _keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, walks: slice = slice(None)) -> np.ndarray:
        """(walk, table, window): the sampled steps of each walk, as one number. Even walks cross the first ``size`` words of
        words[start:end] forwards, odd ones the last ``size`` words backwards; what lies beyond is 0."""
        bits, samples = self.bits[walks], self.samples[walks]
        n, held = len(starts), np.minimum(ends - starts, self.size)
        back = (np.arange(len(bits)) % 2 == 1)[:, None]
        origin, way = np.where(back, ends - 1, starts), np.where(back, -1, 1)
        gone = np.zeros((len(bits), n), dtype=np.int64)  # words passed
        emitted = np.empty((len(bits), self.steps, n), dtype=np.uint64)
        for step in range(self.steps):
            word = np.where(gone < held, words[np.where(gone < held, origin + way * gone, 0)], np.uint64(0))
            emitted[:, step] = word
            gone += ((word * bits[:, step, None]) >> np.uint64(63)).astype(np.int64)
        # a number of its own for each table
        keys = np.broadcast_to(np.arange(samples.shape[0] * TABLES_A_WALK, dtype=np.uint64).reshape(-1, TABLES_A_WALK, 1), (*samples.shape[:2], n))
        for k in range(samples.shape[2]):
            keys = mixed(keys ^ emitted[np.arange(len(bits))[:, None], samples[:, :, k]], 8)
        return keys

    def _trials(self, wrong: list[int]):
        """Edited copies among random words: (words, window starts, window ends, trial of each window, item of each trial)."""
        rng = np.random.default_rng(3)
        texts, starts, trial, item = [], [], [], []
        at = 0
        for i in np.linspace(0, len(self.items) - 1, min(MEASURED_ITEMS, len(self.items))).astype(int).tolist():
            for kind in KINDS:
                for _ in range(max(1, MEASURED_ITEMS // len(self.items))):
                    around = wrong[i] + 1
                    copy = edited(self.items[i], wrong[i], kind, rng)
                    text = np.concatenate([rng.integers(1, 2**63, around, dtype=np.uint64), copy, rng.integers(1, 2**63, len(self.items[i]), dtype=np.uint64)])
                    own = np.arange(at, at + 2 * around + 1)
                    texts.append(text)
                    starts.append(own)
                    trial.append(np.full(len(own), len(item)))
                    item.append((i, KINDS.index(kind)))
                    at += len(text)
        starts, item = np.concatenate(starts), np.array(item)
        return np.concatenate(texts), starts, starts + self.size, np.concatenate(trial), item

    def _recall(self, words, starts, ends, trial, item) -> float:
        """The least recall of a kind of edits, of all walks so far."""
        last = slice(len(self.bits) - WALKS_A_ROUND, None)
        if last.start == 0:
            self.found = np.zeros(len(item), dtype=bool)
        theirs, own = self._keys(words, starts, ends, last), self._keys(*self.own, last)
        hit = (theirs == own[:, :, item[trial, 0]]).any(axis=(0, 1))
        self.found[trial[hit]] = True
        return min(self.found[item[:, 1] == k].mean() for k in range(len(KINDS)))

    def candidates(self, words: np.ndarray, known: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows' first words, items) of all table hits, some more than once; known[i]: pairs that the class's items have, before word i."""
        starts = np.arange(len(words))
        upto = np.minimum(starts + self.size - 1, ends - 1)
        enough = (known[upto] - known[starts]) >= max(0, self.size - 1 - 2 * self.wrong)
        starts = starts[enough & (ends - starts >= self.size - self.wrong)]
        at_once = max(1, HELD // (len(self.bits) * self.steps))
        for low in range(0, len(starts), at_once):
            some = starts[low:low + at_once]
            keys = self._keys(words, some, np.minimum(some + self.size, ends[some])).ravel()
            first, last = (np.searchsorted(self.keys, keys, side=side) for side in ("left", "right"))
            hit = np.flatnonzero(last > first)
            many = (last - first)[hit]
            place = np.repeat(first[hit] - np.cumsum(many) + many, many) + np.arange(many.sum())
            yield np.repeat(some[hit % len(some)], many), self.order[place]


class Block:
    """A bounded block of benchmark items, ready to be matched."""

    def __init__(self, rows: list[tuple[int, str]], edits: float = EDITS, recall: float = TARGET_RECALL):
        texts = [folded((t or "").encode()) for _, t in rows]
        words, counts = word_hashes(texts)
        found = np.split(words, np.cumsum(counts)[:-1])
        self.ids = [i for (i, _), x in zip(rows, found, strict=True) if len(x)]
        self.items = [x for x in found if len(x)]
        self.codes = [np.unique(pair_hashes(x)) for x in self.items]
        self.sizes = np.array([len(x) for x in self.items], dtype=np.int64)
        self.wrong = np.array([int(edits * len(x)) for x in self.items], dtype=np.int64)
        by_class: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(self.items):
            by_class[int(math.log(len(x)) / math.log(CLASS_RATIO))].append(i)
        self.classes = [(np.array(own), Walks([self.items[i] for i in own], self.wrong[own].tolist(), 11 + c, recall))
                        for c, own in sorted(by_class.items())]
        #: For each pair code the classes whose items have it, as bits (several classes share a bit beyond 64).
        self.pairs = np.zeros(1 << PAIR_BITS, dtype=np.uint64)
        for c, (own, _) in enumerate(self.classes):
            for i in own.tolist():
                self.pairs[self.codes[i]] |= np.uint64(1 << c % 64)

    def hits(self, texts: list[bytes]) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item id, distance, item words, start, end) for each text and item it holds."""
        words, counts = word_hashes([folded(t) for t in texts])
        if not len(words) or not self.items:
            return []
        bounds = np.concatenate([[0], np.cumsum(counts)])
        text_of = np.repeat(np.arange(len(texts)), counts)
        codes = pair_hashes(words)
        pairs = self.pairs[codes]
        near: dict[tuple[int, int], set[int]] = defaultdict(set)
        for c, (numbers, walks) in enumerate(self.classes):
            known = np.concatenate([[0], np.cumsum(pairs >> np.uint64(c % 64) & np.uint64(1), dtype=np.int64)])  # pairs of the class before word i
            for starts, own in walks.candidates(words, known, bounds[1:][text_of]):
                for start, item in zip(starts.tolist(), numbers[own].tolist(), strict=True):
                    near[int(text_of[start]), item].add(start)
        out = []
        for (text, item), starts in sorted(near.items()):
            best = self._best(words, codes, int(bounds[text]), int(bounds[text + 1]), item, sorted(starts))
            if best[0] <= self.wrong[item]:
                out.append((text, self.ids[item], best[0], int(self.sizes[item]), best[1] - int(bounds[text]), best[2] - int(bounds[text])))
        return out

    def _best(self, words, codes, first, last, item, starts) -> tuple[int, int, int]:
        """The best run in the words around the windows; windows near each other share one search."""
        own, size, wrong = self.items[item].tolist(), int(self.sizes[item]), int(self.wrong[item])
        best = (size + 1, 0, 0)
        k = 0
        while k < len(starts) and best[0]:
            start = upto = starts[k]
            while k + 1 < len(starts) and starts[k + 1] - upto <= size:
                k += 1
                upto = starts[k]
            k += 1
            # a walk may find an item some words off its place; one from the end may miss the item's first words
            low, high = max(first, start - size // 4 - 2 * wrong - 1), min(last, upto + size + 2 * wrong + 1)
            if np.isin(codes[low:high - 1], self.codes[item]).sum() < size - 1 - 2 * wrong:
                continue
            region = words[low:high].tolist()
            found, end = distance_within(own, region)
            if found < best[0]:
                back, length = distance_within(own[::-1], region[:end][::-1])
                best = (found, low + end - length, low + end)
        return best


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((row["i"], row["t"]))
        size += len(row["t"] or "")
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """One row for each document and benchmark item it holds, with the distance and the words' place."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def against(rows: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(Block(rows, edits))  # at most BLOCK_BYTES of items

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = shared.value
            for part in row_slices(batches):
                ids = part.column(0).to_pylist()
                found = block.hits(utf8(part.column(1)))
                columns = [[ids[h[0]] for h in found]] + [[h[i] for h in found] for i in range(1, 6)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["doc_id", "item_id", "distance", "item_words", "start_word", "end_word"])

        return source.mapInArrow(run, HITS)

    parts = [against(rows) for rows in blocks(benchmark, item_id_col, item_text_col)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], HITS)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id",
                      item_text_col: str = "text", edits: float = EDITS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; ids decide nothing, and no row moves."""
    def without(rows: list[tuple[int, str]]) -> Callable[[Column], Column]:
        shared = docs.sparkSession.sparkContext.broadcast(Block(rows, edits))  # at most BLOCK_BYTES of items

        @F.arrow_udf("boolean")
        def clean(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            block = shared.value
            for part in parts:
                flags = []
                for batch in row_slices([pa.RecordBatch.from_arrays([part], ["text"])]):
                    bad = {h[0] for h in block.hits(utf8(batch.column(0)))}
                    flags += [i not in bad for i in range(batch.num_rows)]
                yield pa.array(flags, pa.bool_())

        return clean

    for rows in blocks(benchmark, item_id_col, item_text_col):
        docs = docs.filter(without(rows)(F.col(text_col)))
    return docs
