"""Stored tables that grow by sorted runs (SNK4, SNK5, SNK10).

A batch is written as a run of its own, sorted by key, so that it costs as many rows as it
has keys, however large the table is.  Reading merges the runs of a key: the last batch's row
replaces the earlier ones, or a column is summed.  ``compact`` folds ``fanout`` runs of one level
into one of the next, cut by key range into files whose number follows the rows, so that a row is
written again once a level and a task sorts no more than about ``rows_per_file`` rows (a row may hold a record's lists).

A run is a folder named by its first batch, last batch and level; it counts once its ``_SUCCESS``
marker exists and no finished run covers it.  So a failed write leaves nothing visible, a
replayed batch is known by its number and changes nothing, and a fold appears at once.  Batch numbers
rise (as those of ``foreachBatch`` do) and one writer works at a time.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarq.operators.merge import _fs
from scholarq.session import removed, shuffles_freed

BATCH = "_batch"


class DeltaRuns:
    """``key`` columns and others by ``schema``; ``add`` names the column that batches add up, None lets
    the last batch's row win.

    Defined cases: null keys are keys like others; of a key's rows in one batch ``order_col``'s largest wins
    (without it the largest row; with ``add`` they are summed); an empty batch is an empty run.
    """

    _RUN = re.compile(r"^r-(\d+)-(\d+)-(\d+)$")

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], add: str | None = None,
                 fanout: int = 8, rows_per_file: int = 250_000):
        if fanout < 2:
            raise ValueError("fanout must be at least 2")
        self.spark, self.root, self.key, self.add = spark, root.rstrip("/"), key, add
        self.schema, self.fanout, self.rows_per_file = schema, fanout, rows_per_file
        self._stored = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])

    # ------------------------------------------------------------------ runs

    def _finished(self) -> list[tuple[int, int, int, str]]:
        """(first batch, last batch, level, folder) of every finished run, in order."""
        fs, p, jvm = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        found = []
        for st in fs.listStatus(p):
            m = self._RUN.match(st.getPath().getName())
            if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                found.append((int(m[1]), int(m[2]), int(m[3]), f"{self.root}/{m[0]}"))
        return sorted(found)

    def runs(self) -> list[tuple[int, int, int, str]]:
        """The runs that readers see: finished and covered by no run of a higher level."""
        done = self._finished()
        return [r for r in done if not any(o[0] <= r[0] and r[1] <= o[1] and o[2] > r[2] for o in done)]

    def has(self, batch: int) -> bool:
        return any(lo <= batch <= hi for lo, hi, _, _ in self._finished())

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*paths)

    def _merged(self, rows: DataFrame) -> DataFrame:
        others = [f.name for f in self.schema.fields if f.name not in self.key]
        if self.add:
            return rows.groupBy(*self.key).agg(F.sum(self.add).cast(self.schema[self.add].dataType).alias(self.add),
                                               F.max(BATCH).alias(BATCH))
        return (rows.groupBy(*self.key).agg(F.max_by(F.struct(*others, BATCH), BATCH).alias("_r"))
                .select(*self.key, "_r.*"))

    # ------------------------------------------------------------------ use

    def append(self, batch: int, rows: DataFrame, order_col: str | None = None) -> bool:
        """Write ``rows`` as the run of ``batch``; False if the batch is there already."""
        runs = self.runs()
        if any(lo <= batch <= hi for lo, hi, _, _ in runs):
            return False
        if runs and batch < runs[-1][1]:
            raise ValueError(f"batch {batch} comes after batch {runs[-1][1]}")
        typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        others = [f.name for f in self.schema.fields if f.name not in self.key]
        order = [F.col(order_col).alias("_order")] if order_col else []
        new = rows.select(*typed, *order).withColumn(BATCH, F.lit(batch).cast("long"))
        if self.add:
            one = self._merged(new)
        else:
            one = (new.groupBy(*self.key)
                   .agg(F.max(F.struct(*(["_order"] if order_col else []), *others, BATCH)).alias("_r"))
                   .select(*self.key, *[F.col("_r")[c].alias(c) for c in [*others, BATCH]]))
        with shuffles_freed(self.spark):
            (one.select(*self._stored.names).sortWithinPartitions(*self.key)
             .write.mode("overwrite").parquet(f"{self.root}/r-{batch}-{batch}-0"))
        return True

    def read(self, before: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The merged table; only of batches under ``before``, only of the keys in ``keys``, if given.

        ``keys`` thins the runs before they are merged, so that what is shuffled has the size of ``keys``."""
        rows = self._rows([path for lo, _, _, path in self.runs() if before is None or lo < before])
        if before is not None:
            rows = rows.filter(F.col(BATCH) < before)
        if keys is not None:
            rows = rows.join(keys.select(*self.key).distinct(), self.key, "left_semi")
        return self._merged(rows).select(*self.schema.names)

    def run(self, batch: int) -> DataFrame:
        """The rows that ``batch`` wrote (until it is folded with others)."""
        return self._rows([path for lo, hi, _, path in self.runs() if lo == hi == batch]).select(*self.schema.names)

    def compact(self) -> int:
        """Fold the newest runs while ``fanout`` neighbours have one level; the number of folds.

        Folded runs stay for running readers until the next call."""
        seen = {path for _, _, _, path in self.runs()}
        removed(self.spark, *[path for _, _, _, path in self._finished() if path not in seen])
        folds = 0
        while True:
            runs = self.runs()
            tail = [r for r in runs[-self.fanout:] if runs and r[2] == runs[-1][2]]
            if len(tail) < self.fanout:
                return folds
            rows = self._rows([path for _, _, _, path in tail])
            files = max(1, -(-rows.count() // self.rows_per_file))  # counted from the footers
            # Rows of a key lie in one range, so they are merged there and not dealt out again.
            with shuffles_freed(self.spark):
                (self._merged(rows.repartitionByRange(files, *self.key)).select(*self._stored.names)
                 .sortWithinPartitions(*self.key)
                 .write.mode("overwrite").parquet(f"{self.root}/r-{tail[0][0]}-{tail[-1][1]}-{tail[0][2] + 1}"))
            folds += 1
