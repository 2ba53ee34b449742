"""Surrogate ids (SNK8).

``sequential_ids``: dense 1..n ids in key order, equal to
``start + row_number() OVER (ORDER BY keys)`` but without a global
single-partition window: rows are range-partitioned on the keys, sorted
within partitions and numbered locally; each partition's offset is the
sum of the sizes of the partitions before it (a table with one row per
partition, so its size is bounded by the partition count).  The numbered
rows are checkpointed before the offsets are taken so that a recomputed
task cannot see different partition boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarq.session import cut_lineage


def sequential_ids(df: DataFrame, order_cols: list[str], start: Column | int = 0,
                   id_col: str = "id", num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = start + position (1-based) in ``order_cols`` order.

    ``order_cols`` must be unique per row for the ids to be deterministic.
    ``start`` may be a one-row aggregate column expression's value passed as
    a DataFrame-free literal, or a Column computed from a one-row DataFrame
    joined by the caller.
    """
    keys = [F.col(c) for c in order_cols]
    ranged = (df.repartitionByRange(num_partitions, *keys) if num_partitions
              else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)
    local = (ranged.withColumn("_pid", F.spark_partition_id())
             .withColumn("_mid", F.monotonically_increasing_id()))
    local = cut_lineage(local)
    counts = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    base = start if isinstance(start, Column) else F.lit(start)
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return (local.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (base + F.col("_off") + pos + 1).cast("long"))
            .drop("_pid", "_mid", "_off"))


def ids_after_max(new_keys: DataFrame, existing: DataFrame, id_col: str, order_cols: list[str]) -> DataFrame:
    """New keys numbered after the largest existing id (SQLite INTEGER
    PRIMARY KEY behaviour): max(id) is a one-row aggregate."""
    mx = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_max"))
    numbered = sequential_ids(new_keys, order_cols, 0, id_col)
    return (numbered.crossJoin(F.broadcast(mx))
            .withColumn(id_col, F.col(id_col) + F.col("_max")).drop("_max"))
