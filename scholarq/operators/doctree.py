"""Document trees (SRC4, DOC1-3, AGG12).

A document is a JSON tree ``{"TYPE": ..., "VALUE": str | [node, ...], ...}``
of unbounded depth.  DOC1 returns the VALUE of every object whose TYPE is
'text', depth-first in document order, descending into every object and
array (also inside table cells and style objects).

Spark has no recursive built-in and its maps and variants sort the keys of
an object, so the walk is one function per JSON text with an
explicit stack: linear in the text, no depth bound, keys in file order. Texts go to Python
a hundred at a time: an Arrow batch holds 10,000 trees, however large they are.
The rest (exploding, joining texts) is built-in and stays in the row.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarq.functions.text import explode_rows

_SPACE = re.compile(r"[ \t\n\r]*")
_LONE_SURROGATE = re.compile("[\ud800-\udfff]")
_SCALAR = json.JSONDecoder().scan_once


def _parse(text: str):
    """The value of a JSON text, by the grammar of the standard parser (whose scanner reads all strings,
    numbers and constants) but with an explicit stack: nesting of any depth, and the same verdict at each."""
    def after(at: int) -> int:
        return _SPACE.match(text, at).end()

    def key(at: int) -> tuple[str, int]:
        if text[at:at + 1] != '"':
            raise ValueError("a key is missing")
        name, at = _SCALAR(text, at)
        at = after(at)
        if text[at:at + 1] != ":":
            raise ValueError("a colon is missing")
        return name, after(at + 1)

    open_: list[dict | list] = []
    names: list[str | None] = []
    at = after(0)
    while True:
        first = text[at:at + 1]
        if first in ("{", "["):
            value: object = {} if first == "{" else []
            at = after(at + 1)
            if text[at:at + 1] != ("}" if first == "{" else "]"):
                open_.append(value)
                name, at = key(at) if first == "{" else (None, at)
                names.append(name)
                continue
            at += 1
        else:
            try:
                value, at = _SCALAR(text, at)
            except StopIteration:
                raise ValueError("a value is missing") from None
        while True:  # a value is whole: put it where it belongs
            at = after(at)
            if not open_:
                if at != len(text):
                    raise ValueError("more than one value")
                return value
            inside = open_[-1]
            if isinstance(inside, dict):
                inside[names[-1]] = value
            else:
                inside.append(value)
            sign = text[at:at + 1]
            if sign == ",":
                at = after(at + 1)
                if isinstance(inside, dict):
                    names[-1], at = key(at)
                break
            if sign != ("}" if isinstance(inside, dict) else "]"):
                raise ValueError("a comma is missing")
            value = open_.pop()
            names.pop()
            at += 1


def text_values(json_text: str | None) -> list[str]:
    """DOC1 for one document; text that is not JSON holds no text nodes.
    A number or boolean as VALUE gives its JSON form; null and containers
    are no text. A lone surrogate escape, which no text can hold, becomes U+FFFD."""
    if not json_text:
        return []
    try:
        try:
            root = json.loads(json_text)
        except RecursionError:  # the same grammar without recursion
            root = _parse(json_text)
    except ValueError:
        return []
    found: list[str] = []
    # An entry is a container still to open, or a value already known to be text.
    stack: list[tuple[bool, object]] = [(False, root)]
    while stack:
        is_text, node = stack.pop()
        if is_text:
            found.append(_LONE_SURROGATE.sub("\ufffd", node) if isinstance(node, str) else json.dumps(node))
            continue
        inside: list[tuple[bool, object]] = []
        if isinstance(node, dict):
            for name, child in node.items():
                if name == "TYPE" and child == "text":
                    if "VALUE" in node and isinstance(node["VALUE"], str | int | float):
                        inside.append((True, node["VALUE"]))
                elif isinstance(child, dict | list):
                    inside.append((False, child))
        elif isinstance(node, list):
            inside = [(False, child) for child in node if isinstance(child, dict | list)]
        stack.extend(reversed(inside))
    return found


_text_nodes = F.udf(text_values, T.ArrayType(T.StringType()), useArrow=False)


def with_text_nodes(trees: DataFrame, json_col: str, out_col: str = "texts") -> DataFrame:
    """DOC1: add ``out_col`` array<string> of text-node values in document order."""
    return trees.withColumn(out_col, _text_nodes(F.col(json_col)))


def extract_texts(trees: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """DOC1 long form: (id, pos, text), one row per text node."""
    return explode_rows(with_text_nodes(trees.select(id_col, json_col), json_col, "_t"),
                        [id_col], F.col("_t"), "text", "pos")


def full_text(trees: DataFrame, id_col: str, json_col: str, sep: str = " ") -> DataFrame:
    """AGG12 (sep=' ') / DOC3 (sep='\\n'): the text nodes of each document
    joined in order -- computed inside the row, so no grouping shuffle."""
    return (with_text_nodes(trees.select(id_col, json_col), json_col, "_t")
            .select(id_col, F.array_join("_t", sep).alias("text")))


def _arr(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def top_level_texts(trees: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """DOC2 (as shipped): only text items of a top-level *list*; a top-level
    object yields nothing."""
    arr = _arr(F.try_parse_json(F.col(json_col)))
    items = F.filter(F.coalesce(arr, F.array().cast("array<variant>")),
                     lambda v: F.try_variant_get(v, "$.TYPE", "string") == F.lit("text"))
    return trees.select(id_col, F.array_join(F.transform(
        items, lambda v: F.coalesce(F.try_variant_get(v, "$.VALUE", "string"), F.lit(""))), " ").alias("text"))
