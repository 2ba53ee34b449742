"""TOP4: first non-empty tier of alternative queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from scholarq.session import cut_lineage


def first_nonempty(tiers: Sequence[DataFrame | Callable[[], DataFrame]]) -> DataFrame:
    """The first tier that has a row, else the last one.

    Tiers run in order and the search ends at the first hit: a later tier
    (often a substring scan) is neither planned nor run.  Tiers may be given as functions,
    so that even their plans are only built when needed.  A tier runs once: its rows
    are written to the shared checkpoint folder, which tells whether there are any, and read from
    there.  So give unsorted, unpaged tiers, and sort and page the winner.  The last tier needs no test
    and stays lazy."""
    if not tiers:
        raise ValueError("first_nonempty needs at least one tier")
    for tier in tiers[:-1]:
        df = cut_lineage(tier() if callable(tier) else tier)
        if not df.isEmpty():
            return df
    return tiers[-1]() if callable(tiers[-1]) else tiers[-1]
