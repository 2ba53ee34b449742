"""Author-name variants (STR1) as column expressions and plain strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surname_first(name: str) -> str | None:
    """'John Doe' -> 'Doe, John' (only for exactly two whitespace parts)."""
    parts = name.split()
    return f"{parts[1]}, {parts[0]}" if len(parts) == 2 else None


def without_dots(name: str) -> str:
    """'J. Doe' -> 'J Doe': dots to spaces, one pass of double-space removal, trim."""
    return name.replace(".", " ").replace("  ", " ").strip()


def surname_first_col(name: Column) -> Column:
    parts = F.split(F.trim(name), r"\s+")
    return F.when(F.size(parts) == 2,
                  F.concat(F.element_at(parts, 2), F.lit(", "), F.element_at(parts, 1)))


def without_dots_col(name: Column) -> Column:
    return F.trim(F.replace(F.replace(name, F.lit("."), F.lit(" ")), F.lit("  "), F.lit(" ")))
