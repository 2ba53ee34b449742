r"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole and encoded once with offsets; the sorted
character spans of the assistant's texts are then intersected with the sorted
token spans by binary search. The template is

    ### <role>:\n<text></turn>\n

for each turn. Control strings inside roles and texts get a backslash in front, as
does the backslash itself, so the rendering can be parsed back exactly.

A conversation is one value of the result, so it must fit a task; conversations are
independent of each other.

Defined cases: null role and null text are empty; turns sort by turn (null first),
then role, then text, so repeated rows are repeated turns; an assistant's empty text
has no loss; rows without a conversation id form one conversation with a null id; an
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.llm.tokens import tokenizer, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
LEARNED_ROLE = "assistant"
OPEN, COLON, CLOSE = "### ", ":\n", "</turn>\n"
TEXT_CONTROL = re.compile(r"\\|###|</turn>")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
TURN = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*):\n((?:\\(?:\\|###|</turn>)|(?!</turn>)[^\\])*)</turn>\n")
FORMATTED = ("conv_id long, formatted string, ids array<int>, loss_mask array<boolean>, "
             "loss_spans array<struct<start:long,end:long>>")

Turn = tuple[str, str]


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the learned role's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + ROLE_CONTROL.sub(r"\\\g<0>", role) + COLON
        body = TEXT_CONTROL.sub(r"\\\g<0>", text)
        if role == LEARNED_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[Turn]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a formatted conversation at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def intersect(offsets: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch a span, and the characters they share with spans, as merged ranges.

    For each span two binary searches over the token spans give its first and last token.
    """
    mask = np.zeros(len(offsets), dtype=bool)
    starts, ends = offsets[:, 0], offsets[:, 1]
    shared: list[tuple[int, int]] = []
    for s, e in spans:
        low, high = np.searchsorted(ends, s, side="right"), np.searchsorted(starts, e, side="left")
        mask[low:high] = True
        for a, b in zip(np.maximum(starts[low:high], s).tolist(), np.minimum(ends[low:high], e).tolist(), strict=True):
            if shared and a <= shared[-1][1] and shared[-1][0] >= s:
                shared[-1] = (shared[-1][0], max(b, shared[-1][1]))
            elif a < b:
                shared.append((a, b))
    return mask, shared


def gathered(conversations: DataFrame) -> DataFrame:
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"))
    return conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(turn)).alias("turns"))


def format_conversations(conversations: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """One row for each conversation: text, token ids, loss mask per token, loss ranges in characters."""
    path = vocabulary or vocabulary_path(VOCABULARY)
    kinds = [pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_()),
             pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        t.encode_special_tokens = True  # their strings in a text are ordinary text
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rendered = [render([(x["role"], x["text"]) for x in turns]) for turns in part.column(1).to_pylist()]
                encoded = t.encode_batch([r[0] for r in rendered], add_special_tokens=False)
                found = [intersect(np.asarray(e.offsets, dtype=np.int64).reshape(-1, 2), r[1])
                         for e, r in zip(encoded, rendered, strict=True)]
                columns = [part.column(0), [r[0] for r in rendered], [e.ids for e in encoded], [f[0] for f in found],
                           [[{"start": a, "end": b} for a, b in f[1]] for f in found]]
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    ["conv_id", "formatted", "ids", "loss_mask", "loss_spans"])

    return gathered(conversations).mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """Turns and loss text, read back from the formatted conversations."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[x["start"]:x["end"]]) for x in spans)
                rows.append((conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(),
                             len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: A conversation full of control strings, formatted with every table.
PROBE = r"\### Assistant: </turn> ok"


def with_probe(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame(
        [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


#: DuckDB's form of the query over ``conversations``.
SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(regexp_replace(role, '\\|###|</turn>|:', '\\\0', 'g'))
           + length(regexp_replace(text, '\\|###|</turn>', '\\\0', 'g')) + 14)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
