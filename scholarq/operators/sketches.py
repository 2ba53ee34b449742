"""Distinct categories and authors of any period from stored sketches (AGG3, AGG5).

Each month keeps a HyperLogLog sketch of its categories and one of its authors.  The sketches of a
period's months are merged when it is asked for, so that no record is read again, and those of a batch of new
records are merged into the stored ones.  The relative standard error of a merged sketch is
1.04 / sqrt(2 ** lg_k); ``ERRORS`` of them bound nearly all answers.  Sketches cannot forget: where records are replaced, use
``maintained``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholarq.operators import metadata as M

LG_K = 12
ERRORS = 4


def relative_bound(lg_k: int = LG_K) -> float:
    return ERRORS * 1.04 / math.sqrt(2 ** lg_k)


def mentioned(records: DataFrame) -> DataFrame:
    """(month, section, value) for each category and author of a record; the month of a record without a date is null."""
    month = F.date_format("published", "yyyy-MM").alias("month")
    categories = F.transform(M.category_list(), lambda c: F.struct(F.lit("category").alias("section"), c.alias("value")))
    authors = F.transform(M.author_list(), lambda a: F.struct(F.lit("author").alias("section"), a.alias("value")))
    return (records.select(month, F.explode_outer(F.concat(categories, authors)).alias("m"))
            .filter(F.col("m").isNotNull()).select("month", "m.section", "m.value"))


def monthly_sketches(records: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(month, section, sketch): combined in the tasks, so that a month's shuffle is some sketches."""
    return mentioned(records).groupBy("month", "section").agg(F.hll_sketch_agg("value", lg_k).alias("sketch"))


def merged(*sketches: DataFrame) -> DataFrame:
    """The sketches of all records of the given ones; a record in two of them counts once."""
    both = sketches[0]
    for more in sketches[1:]:
        both = both.unionByName(more)
    return both.groupBy("month", "section").agg(F.hll_union_agg("sketch").alias("sketch"))


def distinct_estimates(sketches: DataFrame, *period: Column) -> DataFrame:
    """(period columns, section, estimate): ``period`` are named expressions over ``month``, none for the whole."""
    return (sketches.groupBy(*period, "section")
            .agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate")))
