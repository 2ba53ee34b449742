"""Repeated byte strings of the corpus, by a distributed, hash-compared suffix sort.

Each byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else (in another text, or elsewhere
in its own) is removed. Texts are UTF-8 bytes; strings do not cross texts and are judged on the input.

1. Anchors. Among the starts of ``GRAM`` bytes in a window of ``LENGTH`` bytes, the one of smallest hash is
   the window's anchor. Equal windows have their anchors at the same offset, so all copies of a
   string meet at anchors of one gram. An anchor's context is the union of its windows; about one suffix in 85 is an anchor.
   Contexts that are equal within a task are one from here on (their places are known to be repeated).
2. Grams found once are dropped. Equal contexts of different tasks are counted (with partial sums, so that a passage
   of very many copies costs a row a task) and repeated ones are marked whole.
3. Suffix sort. Distinct contexts of one gram are sorted by what follows the anchor, and again by what precedes
   it, backwards: a mergesort in which two suffixes are compared by a binary search for their common extension over
   polynomial prefix hashes. Common extensions of neighbours are then verified byte by byte; a group with a collision
   is sorted anew by its bytes.
4. Strings. Suffixes that share ``d`` bytes lie together in the sorted order. Among them the neighbours in the backward order share
   the most bytes before the anchor, say ``l``: where l + d >= LENGTH, the l + d bytes are a repeated string. Every such
   set of suffixes is visited, so that no pair is missed though no pairs are formed.
5. A gram of more than ``MOST_CONTEXTS`` distinct contexts would be a group too large for a task; the windows of its contexts are
   counted instead, by their digests and with partial sums. The result is the same.

Texts move twice, to meet their contexts' places and to meet their repeated spans.

Defined cases: null and empty texts have no byte; texts below LENGTH bytes lose nothing; of equal texts of at least LENGTH bytes
each is removed whole; repeated rows and null ids are rows of their own; an empty table gives an empty result; very long
texts are hashed in pieces that overlap by LENGTH - 1 bytes; columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarq.llm.common import partitions, row_slices, stored, unstored, utf8
from scholarq.llm.shingles import mixed

LENGTH = 200
GRAM = 32
#: Distinct contexts of one gram that a task sorts.
MOST_CONTEXTS = 2000
#: Window starts hashed at once.
PIECE = 1 << 18
#: Anchors whose contexts are compared within a task at once; bytes of contexts sorted at once.
HELD_ANCHORS, HELD_BYTES = 1 << 19, 4 << 20
ANCHORS = "gram long, context long, d1 long, d2 long, place long"
SPANS = "d1 long, d2 long, start long, end long"
CONTEXTS = "gram long, d1 long, d2 long, place long, known boolean, hot boolean, bytes binary"
KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                steps = np.full(n, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
        return self.up[:n], self.down[:n]


_POWERS = [Powers(b) for b in _BASES]


def prefix_hashes(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """(h, down): the hash of data[i:j] is (h[j] - h[i]) * down[i]."""
    up, down = powers.upto(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=h[1:])
    return h, down


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x)
    full = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


def anchors(pieces: list[bytes]) -> tuple[np.ndarray, ...]:
    """For all windows of all pieces: (piece, anchor, least and most offset of the anchor in its windows, hash of the gram, hash of the context)."""
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    h, down = prefix_hashes(data, _POWERS[0])
    grams = mixed((h[GRAM:] - h[:-GRAM]) * down[:len(data) - GRAM + 1])
    bits = np.uint64(len(grams).bit_length())
    # ties go to the first place; the windows' place has no part in it
    least = sliding_least((grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64), LENGTH - GRAM + 1)
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    piece = np.searchsorted(ends, np.arange(len(at)), side="right")
    whole = np.arange(len(at)) + LENGTH <= ends[piece]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (piece[1:] != piece[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    first, last = first[whole[first]], last[whole[first]]
    h, down = prefix_hashes(data, _POWERS[1])
    context = mixed((h[last + LENGTH] - h[first]) * down[first] + (last - first).astype(np.uint64), 3)
    begin = ends - [len(p) for p in pieces]
    own = piece[first]
    return own, at[first] - begin[own], at[first] - last, at[first] - first, grams[at[first]], context


def merged(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans [start, end) of each text, as disjoint spans in order."""
    if not len(text):
        return text, start, end
    order = np.lexsort((start, text))
    shift = text[order] * np.int64(1 << 40)
    low, high = start[order] + shift, np.maximum.accumulate(end[order] + shift)
    first = np.flatnonzero(np.append(True, low[1:] > high[:-1]))
    last = np.append(first[1:], len(low)) - 1
    return text[order][first], start[order][first], high[last] - shift[last]


def digest_halves(text: Column) -> list[Column]:
    """128 bits that name a text."""
    h = F.sha2(text.cast("binary"), 256)
    return [F.conv(F.substring(h, at, 16), 16, -10).cast("long").alias(name) for name, at in (("d1", 1), ("d2", 17))]


def anchored(docs: DataFrame) -> DataFrame:
    """Anchors of all texts (d1, d2, text), one of each context in a task, and as rows without a gram
    the spans (from ``place`` to ``context``) that are repeated within the task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names: list[tuple[int, int]] = []
        held: list[tuple[np.ndarray, ...]] = []
        pieces: list[tuple[int, int, bytes]] = []  # (text, offset, bytes)
        size = 0

        def hashed() -> None:
            text, offset = (np.array([p[i] for p in pieces], dtype=np.int64) for i in (0, 1))
            own, at, low, high, gram, context = anchors([p[2] for p in pieces])
            held.append((text[own], at + offset[own], low, high, gram.view(np.int64), context.view(np.int64)))
            pieces.clear()

        def flushed() -> pa.RecordBatch:
            text, at, low, high, gram, context = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((context, gram))
            new = np.append(True, (gram[order][1:] != gram[order][:-1]) | (context[order][1:] != context[order][:-1]))
            alone = new & np.append(new[1:], True)
            again, one = order[~alone], order[new]
            t, start, end = merged(text[again], at[again] - high[again], at[again] - low[again] + LENGTH)
            d = np.array(names, dtype=np.int64).reshape(-1, 2)[np.concatenate([text[one], t])]
            none = np.zeros(len(d), dtype=bool)
            none[len(one):] = True
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([gram[one], np.zeros(len(t), dtype=np.int64)]), mask=none),
                 pa.array(np.concatenate([context[one], end])), pa.array(d[:, 0]), pa.array(d[:, 1]),
                 pa.array(np.concatenate([at[one] << 16 | low[one] << 8 | high[one], start]))],
                ["gram", "context", "d1", "d2", "place"])

        for batch in batches:
            for part in row_slices([batch], 64):
                for d1, d2, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)), strict=True):
                    if (d1, d2) in seen or len(text) < LENGTH:
                        continue
                    seen.add((d1, d2))
                    names.append((d1, d2))
                    for offset in range(0, len(text) - LENGTH + 1, PIECE):
                        piece = text[offset:offset + PIECE + LENGTH - 1]
                        pieces.append((len(names) - 1, offset, piece))
                        size += len(piece)
                        if size >= PIECE:
                            hashed()
                            size = 0
                    if sum(len(x[0]) for x in held) >= HELD_ANCHORS:
                        if pieces:
                            hashed()
                            size = 0
                        yield flushed()
        if pieces:
            hashed()
        if held:
            yield flushed()

    return docs.select("d1", "d2", "text").mapInArrow(run, ANCHORS)


class Suffixes:
    """Suffixes that start at anchors ``at`` of ``data``, with ``right`` bytes from there on and ``left`` bytes before."""

    def __init__(self, data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, powers: Powers | None = None):
        self.data, self.at, self.room = data, at, {1: right, -1: left}
        self.h, self.down = prefix_hashes(data, powers or _POWERS[0])

    def _hash(self, x: np.ndarray, n: np.ndarray, way: int) -> np.ndarray:
        low, high = (self.at[x], self.at[x] + n) if way > 0 else (self.at[x] - n, self.at[x])
        return (self.h[high] - self.h[low]) * self.down[low]

    def common(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        """How many bytes the suffixes x and y share, forwards (1) or backwards (-1): a binary search over hashes."""
        low, high = np.zeros(len(x), dtype=np.int64), np.minimum(self.room[way][x], self.room[way][y])
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self._hash(x, middle, way) == self._hash(y, middle, way)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def _next(self, x: np.ndarray, n: np.ndarray, way: int) -> np.ndarray:
        """The byte after n common ones; -1 at the end of the suffix."""
        inside = n < self.room[way][x]
        at = self.at[x] + n if way > 0 else self.at[x] - 1 - n
        return np.where(inside, self.data[np.where(inside, at, 0)].astype(np.int64), -1)

    def compared(self, x: np.ndarray, y: np.ndarray, way: int) -> np.ndarray:
        n = self.common(x, y, way)
        return self._next(x, n, way) - self._next(y, n, way)

    def sorted(self, begin: np.ndarray, size: np.ndarray, way: int) -> np.ndarray:
        """All groups [begin, begin + size) of suffixes in order: a mergesort, all merges of one width at once."""
        order = np.arange(len(self.at))
        start, members = np.repeat(begin, size), np.repeat(size, size)
        place = np.arange(len(order)) - start
        width = 1
        while (members > width).any():
            slot = np.flatnonzero(members > width)
            block = start[slot] + place[slot] // (2 * width) * (2 * width)
            second = place[slot] // width % 2 == 1
            other = np.where(second, block, block + width)
            low = np.zeros(len(slot), dtype=np.int64)
            high = np.clip(start[slot] + members[slot] - other, 0, width)
            while len(open_ := np.flatnonzero(low < high)):
                middle = (low[open_] + high[open_]) // 2
                sign = self.compared(order[other[open_] + middle], order[slot[open_]], way)
                before = (sign < 0) | ((sign == 0) & second[open_])
                low[open_], high[open_] = np.where(before, middle + 1, low[open_]), np.where(before, high[open_], middle)
            after = order.copy()
            after[block + place[slot] % width + low] = order[slot]
            order = after
            width *= 2
        return order

    def shared(self, order: np.ndarray, group: np.ndarray, way: int) -> np.ndarray:
        """Bytes that each suffix shares with the next in order (0 after a group's last), verified byte by byte.

        A group in which hashes collided is put in order by its bytes, in place.
        """
        n = np.zeros(len(order), dtype=np.int64)
        pairs = np.flatnonzero(np.append(group[1:] == group[:-1], False)[:len(order)])
        n[pairs] = self.common(order[pairs], order[pairs + 1], way)
        wrong = np.concatenate([self._wrong(order, pairs, n[pairs], way),
                                np.flatnonzero(np.bincount(order, minlength=len(order)) != 1)])  # merged by contradictory comparisons
        for g in np.unique(group[wrong]).tolist():
            slots = np.flatnonzero(group == g)  # its suffixes have these numbers, too
            texts = {x: self._bytes(x, way) for x in slots.tolist()}
            order[slots] = sorted(texts, key=lambda x: (texts[x], x))
            for s in slots[:-1].tolist():
                a, b = (np.frombuffer(texts[int(order[i])], dtype=np.uint8) for i in (s, s + 1))
                k = min(len(a), len(b))
                n[s] = np.append(np.flatnonzero(a[:k] != b[:k]), k)[0]
        return n

    def _bytes(self, x: int, way: int) -> bytes:
        at, room = int(self.at[x]), int(self.room[way][x])
        return self.data[at:at + room].tobytes() if way > 0 else self.data[at - room:at][::-1].tobytes()

    def _wrong(self, order: np.ndarray, pairs: np.ndarray, n: np.ndarray, way: int) -> np.ndarray:
        """The slots of ``pairs`` whose suffixes differ within their n common bytes, or are out of order after them."""
        if not len(pairs):
            return pairs
        x, y = order[pairs], order[pairs + 1]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i, j = (self.at[np.repeat(z, n)] + (step if way > 0 else -1 - step) for z in (x, y))
        differ = np.bincount(np.repeat(np.arange(len(pairs)), n)[self.data[i] != self.data[j]], minlength=len(pairs)) > 0
        return pairs[differ | (self._next(x, n, way) > self._next(y, n, way))]


def repeated(suffixes: Suffixes, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix, l, r): strings from l bytes before to r bytes after an anchor that also occur at another suffix of its group."""
    group = np.repeat(np.arange(len(begin)), size)
    forward = suffixes.sorted(begin, size, 1)
    right = suffixes.shared(forward, group, 1)
    two = begin[size == 2]
    x, y = forward[two], forward[two + 1]
    pairs = np.column_stack([x, y]).ravel()
    left = np.zeros(len(suffixes.at), dtype=np.int64)
    # a pair is its own only neighbour; larger groups are sorted backwards too
    backward = np.arange(len(suffixes.at))
    many = size > 2
    if many.any():
        slots = np.flatnonzero(np.repeat(many, size))
        part = Suffixes(suffixes.data, suffixes.at[slots], suffixes.room[-1][slots], suffixes.room[1][slots])
        part.h, part.down = suffixes.h, suffixes.down
        own = part.sorted(np.cumsum(size[many]) - size[many], size[many], -1)
        backward[slots] = slots[own]
    left = suffixes.shared(backward, group, -1)
    found = [(pairs, np.repeat(left[two], 2), np.repeat(right[two], 2))]
    for b, m in zip(begin[many].tolist(), size[many].tolist(), strict=True):
        found += _strings(forward[b:b + m], right[b:b + m - 1], backward[b:b + m], left[b:b + m])
    suffix, left, right = (np.concatenate(c) for c in zip(*found, strict=True))
    long = left + right >= LENGTH
    return suffix[long], left[long], right[long]


def _strings(forward: np.ndarray, right: np.ndarray, backward: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each set of suffixes that share more than their neighbours do: its members with the most bytes they share backwards
    within the set, and the bytes they share forwards."""
    first = int(forward.min())
    rank = np.empty(len(forward), dtype=np.int64)
    rank[backward - first] = np.arange(len(forward))
    open_ = [(0, len(forward))]
    while open_:
        low, high = open_.pop()
        d = int(right[low:high - 1].min())
        members = forward[low:high]
        ranks = rank[members - first]
        order = np.argsort(ranks)
        between = np.minimum.reduceat(left, ranks[order])[:-1]  # of neighbours within the set
        most = np.empty(len(members), dtype=np.int64)
        most[order] = np.maximum(np.append(0, between), np.append(between, 0))
        yield members, most, np.full(len(members), d)
        cuts = [low, *(np.flatnonzero(right[low:high - 1] == d) + low + 1).tolist(), high]
        open_ += [(a, b) for a, b in zip(cuts, cuts[1:]) if b - a > 1]


def sorted_spans(contexts: DataFrame) -> DataFrame:
    """The repeated spans of contexts, from a suffix sort of the contexts of each gram."""
    def solved(table: pa.Table) -> pa.RecordBatch:
        gram, d1, d2, place, known = (table.column(i).to_numpy() for i in range(5))
        rows = table.column(5).to_pylist()
        at, low, high = place >> 16, place >> 8 & 255, place & 255
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        data = np.frombuffer(b"".join(rows), dtype=np.uint8)
        suffixes = Suffixes(data, np.cumsum(sizes) - sizes + high, high, LENGTH - low)
        begin = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        x, left, right = repeated(suffixes, begin, np.diff(np.append(begin, len(gram))))
        fresh = ~known[x]
        x, left, right = x[fresh], left[fresh], right[fresh]
        x, start, end = merged(x, at[x] - left, at[x] + right)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (d1[x], d2[x], start, end)], ["d1", "d2", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in row_slices(batches, 1024):
            held.append(batch)
            size += sum(map(len, batch.column(5).to_pylist()))
            if size >= HELD_BYTES:
                table = pa.Table.from_batches(held)
                gram = table.column(0).to_numpy()
                if cut := int(np.searchsorted(gram, gram[-1])):  # the last gram may go on
                    yield solved(table.slice(0, cut))
                    held = table.slice(cut).combine_chunks().to_batches()
                    size = sum(len(x) for b in held for x in b.column(5).to_pylist())
        if held:
            yield solved(pa.Table.from_batches(held))

    return (contexts.select("gram", "d1", "d2", "place", "known", "bytes")
            .repartition(partitions(contexts.sparkSession), "gram").sortWithinPartitions("gram").mapInArrow(run, SPANS))


def counted_spans(contexts: DataFrame) -> DataFrame:
    """The repeated spans of contexts whose grams have too many of them for one task: windows found more than once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            columns: list[list[int]] = [[], [], [], [], []]
            for d1, d2, place, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                start = (place >> 16) - (place & 255)
                for i in range(len(text) - LENGTH + 1):
                    w = hashlib.blake2b(text[i:i + LENGTH], digest_size=16).digest()
                    for c, v in zip(columns, (int.from_bytes(w[:8], "big", signed=True), int.from_bytes(w[8:], "big", signed=True),
                                              d1, d2, start + i), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["w1", "w2", "d1", "d2", "start"])

    windows = contexts.select("d1", "d2", "place", "bytes").mapInArrow(run, "w1 long, w2 long, d1 long, d2 long, start long")
    windows = stored(windows, "windows")
    # written, so that the join below reads two plain exchanges and a hot window's rows can be split
    again = stored(windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("w1", "w2"), "repeated-windows")
    return windows.join(again, ["w1", "w2"]).select("d1", "d2", "start", (F.col("start") + LENGTH).alias("end"))


def context_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The contexts of ``wanted`` (gram, d1, d2, place, known, hot) with their bytes; ``texts``: (d1, d2, text)."""
    lists = wanted.groupBy("d1", "d2").agg(F.collect_list(F.struct("gram", "place", "known", "hot")).alias("wanted"))  # of one text
    one = texts.groupBy("d1", "d2").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            columns: list[list] = [[], [], [], [], [], [], []]
            for d1, d2, text, own in zip(*(batch.column(i).to_pylist() for i in (0, 1)), utf8(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                for w in own:
                    at, low, high = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    for c, v in zip(columns, (w["gram"], d1, d2, w["place"], w["known"], w["hot"], text[at - high:at - low + LENGTH]), strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 4 + [pa.bool_()] * 2 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             ["gram", "d1", "d2", "place", "known", "hot", "bytes"])

    return one.join(lists, ["d1", "d2"]).select("d1", "d2", "text", "wanted").mapInArrow(run, CONTEXTS)


def spans(texts: DataFrame, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """(d1, d2, start, end): spans of the texts (d1, d2, text) whose bytes lie in repeated strings; they may overlap.

    Equal texts count once here.
    """
    found = stored(anchored(texts), "anchors")
    # written, so that the join below reads two plain exchanges and a hot gram's rows can be split
    grams = stored(found.filter("gram is not null").groupBy("gram")
                   .agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("low"), F.max("context").alias("high"))
                   .filter("n > 1").select("gram", (F.col("low") != F.col("high")).alias("several")), "grams")
    again = stored(found.join(grams, "gram"), "repeated-grams")
    start, end = (F.shiftright("place", 16) - F.col("place").bitwiseAND(255),
                  F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(255) + LENGTH)
    whole = ["d1", "d2", start.alias("start"), end.alias("end")]
    local = found.filter("gram is null").select("d1", "d2", F.col("place").alias("start"), F.col("context").alias("end"))
    equal = again.filter("not several").select(*whole)

    several = again.filter("several")
    distinct = several.groupBy("gram", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("d1", "d2", "place")).alias("first"))
    known = several.join(distinct.filter("n > 1").select("gram", "context"), ["gram", "context"]).select(*whole)
    size = distinct.groupBy("gram").agg(F.count(F.lit(1)).alias("size"))
    wanted = distinct.join(size, "gram").select(
        "gram", "first.d1", "first.d2", "first.place", (F.col("n") > 1).alias("known"), (F.col("size") > most_contexts).alias("hot"))
    contexts = stored(context_bytes(texts, wanted), "contexts")
    out = stored(local.unionByName(equal).unionByName(known)
                 .unionByName(sorted_spans(contexts.filter("not hot")))
                 .unionByName(counted_spans(contexts.filter("hot"))), "spans")
    for df in (found, grams, again, contexts):
        unstored(df)
    return out


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """For each row of ``docs``: doc_id, n_bytes, the removed spans [start, end) in order, and the bytes that are left."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    long = F.octet_length("text") >= LENGTH
    named = rows.filter(long).select("doc_id", *digest_halves(F.col("text")), "text")
    found = spans(named.drop("doc_id"), most_contexts)
    copies = (named.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).cast("long").alias("end"))
              .filter("n > 1").select("d1", "d2", F.lit(0).cast("long").alias("start"), "end"))
    of_text = found.unionByName(copies).groupBy("d1", "d2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_slices(batches, 64):
            texts = utf8(batch.column(1))
            cuts, left = [], []
            for text, own in zip(texts, batch.column(2).to_pylist(), strict=True):
                at = np.array([(s["start"], s["end"]) for s in own or []], dtype=np.int64).reshape(-1, 2)
                _, start, end = merged(np.zeros(len(at), dtype=np.int64), at[:, 0], at[:, 1])
                cuts.append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                left.append(b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(cuts, kind), pa.array(left, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"])

    cut = named.join(of_text, ["d1", "d2"], "left").select("doc_id", "text", "spans").mapInArrow(run, KEPT)
    short = rows.filter(~long).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:long,end:long>>").alias("spans"), F.col("text").cast("binary").alias("kept"))
    return cut.unionByName(short)


def digests(docs: DataFrame) -> DataFrame:
    """Counts and the hash of what is left, for each row."""
    return kept(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
