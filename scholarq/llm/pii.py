"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, schemes, plus signs, digits and
identifier cues. At each anchor a deterministic local parser expands to the left and
right and validates what it finds. Base kinds (``email``, ``ip``, ``card``, ``phone``) take,
per kind, the leftmost candidates that do not overlap; a candidate that fails
validation is used up. Further kinds: ``url`` (from a scheme) and ``account``
(an IBAN with valid check digits, or digits, behind a cue such as "account"); these
are dropped where they overlap a base span.

Spans are in code points, end exclusive. Work on a text is linear in its length.

Defined cases: null and empty texts have no spans; repeated rows give the same spans
each; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.llm.common import row_slices

KINDS = ["email", "ip", "card", "phone", "url", "account"]
BASE = KINDS[:4]
#: Words that announce an account number; part of the method, a parameter.
CUES = ["account", "acct", "iban", "konto", "compte", "cuenta"]
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
#: The shapes of the base kinds behind their anchors.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL_REST = re.compile(r"[^\s<>\"'`|]+")
CLOSING = frozenset(".,;:!?)]}")
ACCOUNT = re.compile(r"[\s:#.]{0,4}(?:(?:number|num|no|nr)\b[\s:#.]{0,4})?([A-Za-z]{2}[0-9]{2}(?:\x20?[A-Za-z0-9]{2,4}){3,8}|[0-9](?:[\x20-]?[0-9]){5,17})(?![A-Za-z0-9])")
SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban(text: str) -> bool:
    text = text.replace(" ", "").upper()
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


@lru_cache(maxsize=4)
def automaton(cues: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for mark in ["@", "://", "+", *"0123456789"]:
        a.add_word(mark, (mark, 1))
    for cue in cues:
        for form in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def find(text: str, cues: tuple[str, ...] = tuple(CUES)) -> list[Span]:
    """All spans of ``text`` by start, then kind."""
    base: list[Span] = []
    more: list[Span] = []
    used = dict.fromkeys(BASE, 0)  # up to here each kind's candidates have taken the text
    run_end = run_kept = 0  # the last address run met: its end, and that without closing marks
    ip_failed = -2  # where the last digit stood that starts no address; the next in its run starts none either
    for last, (mark, size) in automaton(cues).iter(text):
        if mark == "@":
            start = last
            while start > used["email"] and text[start - 1] in LOCAL_PART:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                used["email"] = m.end()
                base.append(("email", start, m.end()))
        elif mark == "+":
            if last >= used["phone"] and (m := PHONE.match(text, last)):
                used["phone"] = m.end()
                if 10 <= len(digits_of(m[0])) <= 15:
                    base.append(("phone", last, m.end()))
        elif mark == "://":
            start = left = last - 2
            while left > 0 and text[left - 1] in SCHEME:
                left -= 1
            while left < start and not text[left].isalpha():
                left += 1
            if last + 1 >= run_end and (m := URL_REST.match(text, last + 1)):  # a run is read once, whatever anchors it holds
                run_end = run_kept = m.end()
                while run_kept > last + 1 and text[run_kept - 1] in CLOSING:
                    run_kept -= 1
            if left < start and last + 1 < run_kept:
                more.append(("url", left, run_kept))
        elif mark == "cue":
            if (m := ACCOUNT.match(text, last + 1)) and (m[1][0].isdigit() or iban(m[1])):
                more.append(("account", m.start(1), m.end(1)))
        else:
            if last >= used["card"] and (m := CARD.match(text, last)):
                used["card"] = m.end()
                if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                    base.append(("card", last, m.end()))
            if last >= used["ip"] and last != ip_failed + 1:
                if m := IP.match(text, last):
                    used["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                        base.append(("ip", last, m.end()))
                else:
                    ip_failed = last
            elif last == ip_failed + 1:
                ip_failed = last
    base.sort(key=lambda s: s[1])
    starts, reach = [s[1] for s in base], list(accumulate((s[2] for s in base), max))
    taken: list[tuple[int, int]] = []  # added spans by start; they do not overlap
    for kind, start, end in more:
        before, own = bisect_left(starts, end), bisect_left(taken, (end,))
        if not (before and reach[before - 1] > start or own and taken[own - 1][1] > start):
            taken.insert(own, (start, end))
            base.append((kind, start, end))
    return sorted(set(base), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cues: list[str] | None = None) -> DataFrame:
    """doc_id and the sorted array of (kind, start, end) of each document."""
    marks = tuple(CUES if cues is None else cues)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, marks)] if t else []
                     for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SPANS)


def digests(docs: DataFrame) -> DataFrame:
    def listed(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans(docs).select(
        "doc_id", *map(counted, BASE),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
