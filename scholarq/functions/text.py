"""Text column expressions shared by sentiment, TF-IDF and tagging.

Patterns avoid look-behind and use \\p{L}/\\p{N} so that Java regex and
RE2 (the oracle) tokenise identically.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
WORD2 = r"[\p{L}\p{N}_]{2,}"
SENT_MARK = "\u0001"


def tokens(text: Column, pattern: str = WORD) -> Column:
    """Lower-cased word tokens in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), 0)


def sentences(text: Column) -> Column:
    """SEN1: split after '.', '!' or '?' followed by whitespace.  The
    boundary is first marked with a control character, then split on it
    (no look-behind needed).  Returns the raw pieces (trim/drop later)."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1" + SENT_MARK)
    return F.split(marked, SENT_MARK)


def explode_rows(df, keep: list[str], array_col, alias: str = "value", pos_alias: str | None = None):
    """Rows of ``array_col`` elements (with position if ``pos_alias``).

    Uses the *outer* generator and drops its padding row: for a plain
    explode the optimizer infers ``size(array) > 0`` and pushes that filter
    below the projections, evaluating the (costly) array expression twice.
    """
    if pos_alias:
        out = df.select(*keep, F.posexplode_outer(array_col).alias(pos_alias, alias))
        return out.filter(F.col(pos_alias).isNotNull())
    out = df.select(*keep, F.explode_outer(array_col).alias(alias))
    return out.filter(F.col(alias).isNotNull())
