"""Dictionary (gazetteer) entity tagging (NER1), the re-aimed stand-in for
the statistical tagger: (doc, text, start_char, end_char, label) for every
occurrence of a dictionary name as a run of word tokens with only white
space between them; ``text`` is the text at the offsets. Overlaps are resolved
from the left, a longer match before a shorter one at the same start.

The names become a token automaton: a trie over their tokens from the last to the first, with failure
links. One walk over a text's tokens from its end gives for each token the longest name that
starts there, whatever the names are, and a second walk from the start takes the matches: the time
is linear in the text. Texts are not shuffled; the walks run in the tasks that read them.

The automaton goes to every task, so its size is bounded: a dictionary of more than ``MOST_NAMES`` names
is cut into shards by a hash of the name, each of which gives its longest name at each token; those candidates
meet by document (``id_col`` must be unique then) and are resolved by the same second walk.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_W = r"\p{L}\p{N}_"
#: Letters, digits and the underscore; Python's class for that.
TOKEN = re.compile(r"\w+")
#: White space that a name may have between its tokens.
GAP = re.compile(r"[ \t\n\x0b\f\r]+")
#: Names of one automaton.
MOST_NAMES = 200_000
#: Rows of one output batch, about.
BATCH_ROWS = 8192


class Automaton:
    """All names as a trie over tokens from the last to the first, with failure links."""

    def __init__(self, names: list[tuple[str, str]]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, depth, label = [0], [0], [None]
        for name, own in names:
            at = 0
            for token in reversed(name.split(" ")):
                if token not in self.next[at]:
                    self.next[at][token] = len(self.next)
                    self.next.append({})
                    self.fail.append(0)
                    depth.append(depth[at] + 1)
                    label.append(None)
                at = self.next[at][token]
            label[at] = own if label[at] is None else min(own, label[at])
        #: For each state the longest name that ends in it: (tokens, label), or None.
        self.longest: list[tuple[int, str] | None] = [None] * len(self.next)
        queue = [0]
        for at in queue:  # breadth first; grows while it is walked
            for token, to in self.next[at].items():
                queue.append(to)
                if at:
                    self.fail[to] = self._step(self.fail[at], token)
                self.longest[to] = (depth[to], label[to]) if label[to] is not None else self.longest[self.fail[to]]

    def _step(self, at: int, token: str) -> int:
        while at and token not in self.next[at]:
            at = self.fail[at]
        return self.next[at].get(token, 0)

    def candidates(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, label) of the longest name that starts at each token, by falling start."""
        spans = [m.span() for m in TOKEN.finditer(text)]
        out, at = [], 0
        for i in range(len(spans) - 1, -1, -1):
            start, end = spans[i]
            if at and not GAP.fullmatch(text, end, spans[i + 1][0]):
                at = 0
            at = self._step(at, text[start:end])
            if found := self.longest[at]:
                out.append((start, spans[i + found[0] - 1][1], found[1]))
        return out


def taken(candidates: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """The matches kept of candidates by rising start, the longest of each start first."""
    reached = 0
    for start, end, label in candidates:
        if start >= reached:
            reached = end
            yield start, end, label


def dictionary_names(dictionary: DataFrame, name_col: str, label_col: str) -> DataFrame:
    """(name, label): names as tokens joined by one space, one label each (the smallest)."""
    name = F.array_join(F.regexp_extract_all(F.col(name_col), F.lit(f"[{_W}]+"), 0), " ")
    return (dictionary.select(name.alias("name"), F.col(label_col).alias("label")).filter("name <> '' AND label IS NOT NULL")
            .groupBy("name").agg(F.min("label").alias("label")))


def _rows(id_type: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    kinds = [id_type, pa.string(), pa.int64(), pa.int64(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      ["id", "text", "start_char", "end_char", "label"])


def _walk(texts: DataFrame, names: list[tuple[str, str]], whole: bool) -> DataFrame:
    """Matches of ``texts`` (id, text), or with ``whole`` false all candidates, for one automaton."""
    shared = texts.sparkSession.sparkContext.broadcast(Automaton(names))  # at most MOST_NAMES names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            kind, rows = batch.column(0).type, []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = automaton.candidates(text)[::-1]
                rows += [(key, text[s:e], s, e, label) for s, e, label in (taken(found) if whole else found)]
                if len(rows) >= BATCH_ROWS:
                    yield _rows(kind, rows)
                    rows = []
            yield _rows(kind, rows)

    return texts.mapInArrow(run, _schema(texts))


def _schema(texts: DataFrame) -> str:
    return f"id {texts.schema['id'].dataType.simpleString()}, text string, start_char long, end_char long, label string"


def _resolved(candidates: DataFrame) -> DataFrame:
    """The matches of candidates of several automata."""
    match = F.struct("start_char", (-F.col("end_char")).alias("longest"), "text", "label")
    by_doc = candidates.groupBy("id").agg(F.array_sort(F.collect_list(match)).alias("found"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).type
            for key, found in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(m["start_char"], -m["longest"], (m["text"], m["label"])) for m in found.as_py()]
                yield _rows(kind, [(key, text, s, e, label) for s, e, (text, label) in taken(rows)])

    return by_doc.mapInArrow(run, _schema(candidates))


def tag_entities(docs: DataFrame, id_col: str, text_col: str, dictionary: DataFrame,
                 name_col: str = "name", label_col: str = "label", most_names: int = MOST_NAMES) -> DataFrame:
    """Tags of each document. A null text has none; of several labels of a name the smallest is taken; a name without one is not used."""
    names = dictionary_names(dictionary, name_col, label_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shards = -(-names.count() // most_names)
    if shards <= 1:
        found = _walk(texts, [tuple(r) for r in names.collect()], True)
    else:
        shard = F.pmod(F.xxhash64("name"), F.lit(shards))
        found = _resolved(reduce(DataFrame.unionByName, [
            _walk(texts, [tuple(r) for r in names.filter(shard == i).collect()], False) for i in range(shards)]))
    return found.withColumnRenamed("id", id_col)
