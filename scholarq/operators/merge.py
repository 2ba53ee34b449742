"""Sinks and DML on plain Parquet (SNK1-7, SNK9-10, JN5).

There is no row-level DML on Parquet, so every upsert is "read the current
version, merge with joins, write a new version".  A table is a folder of
numbered version folders; a version is visible once its ``_SUCCESS``
marker exists, so a reader never sees a half-written version and a
version being read is never overwritten.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarq.operators.ids import ids_after_max


# ----------------------------------------------------------------- storage

def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


class VersionedTable:
    """SNK1 + SNK10: create-if-absent and atomic commit of whole versions.

    A version folder has a number past every folder present, finished or
    not, and a name of its own, so neither the remains of a failed write nor
    a second writer blocks a commit.  It counts once its ``_SUCCESS`` marker
    exists.  ``keep`` finished versions stay for running readers; older ones and
    unfinished folders below them are removed after a commit.
    """

    _VER = re.compile(r"^v(\d{8})(?:-[0-9a-f]+)?$")

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, keep: int = 3):
        self.spark, self.root, self.schema, self.keep = spark, root.rstrip("/"), schema, max(1, keep)

    def _folders(self) -> list[tuple[int, str, bool]]:
        """(number, folder name, finished) of every version folder, in order."""
        fs, p, jvm = _fs(self.spark, self.root)
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if m := self._VER.match(name):
                out.append((int(m[1]), name, fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS"))))
        return sorted(out)

    def _current(self) -> tuple[int, str] | None:
        done = [(n, name) for n, name, finished in self._folders() if finished]
        return done[-1] if done else None

    def current_version(self) -> int | None:
        v = self._current()
        return v[0] if v else None

    def read(self) -> DataFrame:
        """Current version; an empty frame of the table schema if none yet."""
        v = self._current()
        if v is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{v[1]}")

    def read_all(self) -> DataFrame:
        """The rows of all versions that are kept."""
        paths = [f"{self.root}/{name}" for _, name, finished in self._folders() if finished]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.read()

    def commit(self, df: DataFrame) -> int:
        """Write ``df`` as the next version; visible only when complete."""
        nxt = max((n for n, _, _ in self._folders()), default=0) + 1
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields]) \
          .write.mode("errorifexists").parquet(f"{self.root}/v{nxt:08d}-{uuid.uuid4().hex[:12]}")
        self._expire()
        return nxt

    def append(self, df: DataFrame) -> int:
        """Commit the current rows plus ``df``."""
        return self.commit(self.read().unionByName(df.select(*self.schema.names)))

    def _expire(self) -> None:
        folders = self._folders()
        done = [n for n, _, finished in folders if finished]
        if len(done) <= self.keep:
            return
        oldest = done[-self.keep]
        fs, _, jvm = _fs(self.spark, self.root)
        for n, name, _ in folders:
            if n < oldest:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


class BucketedTable:
    """SNK10 for large tables: a commit rewrites only the buckets it touches.

    Rows are spread over ``buckets`` by a hash of ``key``.  A version is a small
    manifest (bucket, folder) kept in a ``VersionedTable``; a commit writes the
    touched buckets to a new folder and then the manifest that names it, so
    it is as atomic as the manifest.  Data folders that no kept manifest names
    are removed.  One writer at a time.
    """

    MANIFEST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("folder", T.StringType())])

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: list[str], buckets: int = 64):
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets
        self.manifest = VersionedTable(spark, f"{self.root}/manifest", self.MANIFEST)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _folders(self) -> dict[int, str]:
        return {r["bucket"]: r["folder"] for r in self.manifest.read().collect()}  # at most ``buckets`` rows

    def current_version(self) -> int | None:
        return self.manifest.current_version()

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of the buckets ``only``."""
        paths = [f"{self.root}/{f}" for b, f in self._folders().items() if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def rewrite(self, touched: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> int | None:
        """Replace the rows of the buckets that the keys of ``touched`` fall in by
        ``merge`` of them; other buckets are neither read nor written."""
        only = sorted(r["b"] for r in touched.select(self.bucket().alias("b")).distinct().collect())
        if not only:
            return self.current_version()
        folder = f"data-{uuid.uuid4().hex}"
        rows = merge(self.read(only)).select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        (rows.withColumn("_bucket", self.bucket()).repartition("_bucket")
         .write.partitionBy("_bucket").parquet(f"{self.root}/{folder}"))
        fs, _, jvm = _fs(self.spark, self.root)
        folders = {b: f for b, f in self._folders().items() if b not in only}
        folders |= {b: f"{folder}/_bucket={b}" for b in only
                    if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}/_bucket={b}"))}
        version = self.manifest.commit(self.spark.createDataFrame(sorted(folders.items()), self.MANIFEST).coalesce(1))
        self._expire(folder)
        return version

    def _expire(self, newest: str) -> None:
        used = {r["folder"].split("/")[0] for r in self.manifest.read_all().select("folder").distinct().collect()} | {newest}
        fs, p, _ = _fs(self.spark, self.root)
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("data-") and name not in used:
                fs.delete(st.getPath(), True)


def split_rejects(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """SNK10: rows failing any named check go to ``rejects`` with the names
    of the failed checks; the rest are kept.  (Replaces per-row try/except:
    one bad record never aborts the batch.)"""
    failed = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]),
                      lambda x: x.isNotNull())
    tagged = df.withColumn("_failed", failed)
    good = tagged.filter(F.size("_failed") == 0).drop("_failed")
    rejects = tagged.filter(F.size("_failed") > 0).withColumn("reason", F.array_join("_failed", ",")).drop("_failed")
    return good, rejects


# ----------------------------------------------------------------- upserts

def _present_keys(existing: DataFrame, batch_keys: DataFrame, key: list[str]) -> DataFrame:
    """Keys of the batch that are already stored.  The stored table is the
    streamed side of a semi join against the (usually small) batch keys, so
    AQE can broadcast the batch instead of shuffling the stored table."""
    return existing.select(*key).join(batch_keys, key, "left_semi").distinct()


def _absent(batch: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """Batch rows whose key is not stored: the anti join runs between two
    batch-sized frames."""
    return batch.join(_present_keys(existing, batch.select(*key).distinct(), key), key, "left_anti")


def upsert_by_key(existing: DataFrame, new: DataFrame, key: list[str], id_col: str,
                  update_cols: list[str], order_col: str | None = None) -> DataFrame:
    """SNK2/SNK3: insert new keys with fresh ids, update ``update_cols`` of
    existing keys, keep their ids (ON CONFLICT DO UPDATE ... RETURNING id).

    A key may repeat in the batch only if ``order_col`` says which row is
    the last; that one wins, as if the rows were applied one after another.
    Without it, rows that differ for one key make the upsert fail."""
    if order_col is not None:
        new_d = keep_last(new.select(*key, *update_cols, order_col), key, order_col)
    else:
        new_d = new.select(*key, *update_cols).distinct()
        n = F.count(F.lit(1)).over(Window.partitionBy(*key))
        new_d = new_d.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(
            F.lit("a key repeats in the batch: give order_col"))).otherwise(F.lit(True))).filter("_ok").drop("_n", "_ok")
    o, n = existing.alias("o"), new_d.withColumn("_hit", F.lit(True)).alias("n")
    matched_or_old = o.join(n, key, "left").select(
        *key, F.col(f"o.{id_col}").alias(id_col),
        *[F.when(F.col("n._hit"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in update_cols])
    fresh = ids_after_max(_absent(new_d, existing, key), existing, id_col, key)
    cols = [id_col] + key + update_cols
    return matched_or_old.select(*cols).unionByName(fresh.select(*cols))


def insert_new_keys(existing: DataFrame, new_keys: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """SNK3/SNK7 (insert or ignore): keys not yet present get ids after the
    current maximum; existing rows are untouched."""
    fresh = ids_after_max(_absent(new_keys.select(*key).distinct(), existing, key), existing, id_col, key)
    return existing.select(id_col, *key).unionByName(fresh.select(id_col, *key))


def lookup_ids(rows: DataFrame, dim: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """JN5: attach the surrogate id of a natural key."""
    return rows.join(dim.select(id_col, *key), key, "inner")


def replace_counts(existing: DataFrame, batch_counts: DataFrame, paper_col: str = "paper_id") -> DataFrame:
    """SNK4, idempotent form: the link rows of every paper in the batch are
    replaced by the batch's counts; re-ingesting a paper does not grow them."""
    keep = existing.join(batch_counts.select(paper_col).distinct(), paper_col, "left_anti")
    return keep.unionByName(batch_counts.select(*existing.columns))


def add_counts(existing: DataFrame, batch_counts: DataFrame, key: list[str], cnt: str = "count") -> DataFrame:
    """SNK4, accumulating form (count = count + new)."""
    o, n = existing.alias("o"), batch_counts.alias("n")
    return (o.join(n, key, "full_outer")
            .select(*key, (F.coalesce(F.col(f"o.{cnt}"), F.lit(0)) + F.coalesce(F.col(f"n.{cnt}"), F.lit(0)))
                    .alias(cnt)))


def keep_last(df: DataFrame, key: list[str], order_col: str) -> DataFrame:
    """Last row per key by ``order_col`` (max_by aggregate: partial per task)."""
    others = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.max_by(F.struct(*others), F.col(order_col)).alias("_r"))
            .select(*key, "_r.*"))


def keep_first(df: DataFrame, key: list[str], order_col: str) -> DataFrame:
    others = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.min_by(F.struct(*others), F.col(order_col)).alias("_r"))
            .select(*key, "_r.*"))


def insert_or_replace(existing: DataFrame, batch: DataFrame, key: str, order_col: str,
                      defaults: dict[str, object] | None = None) -> DataFrame:
    """SNK5: the batch's last row per key replaces the stored one; other
    stored rows stay.  ``defaults`` fill NULLs of the written rows."""
    last = keep_last(batch, [key], order_col).drop(order_col)
    for c, v in (defaults or {}).items():
        last = last.withColumn(c, F.coalesce(F.col(c), F.lit(v)))
    cols = existing.columns
    return existing.join(last.select(key), key, "left_anti").unionByName(last.select(*cols))


def insert_if_absent(existing: DataFrame, batch: DataFrame, key: str, order_col: str, id_col: str) -> DataFrame:
    """SNK6: batch rows whose key is not stored yet (first per key) are
    appended with fresh ids."""
    first = keep_first(batch, [key], order_col).drop(order_col)
    fresh = _absent(first, existing, [key])
    fresh = ids_after_max(fresh, existing, id_col, [key])
    return existing.unionByName(fresh.select(*existing.columns))


def write_entity_files(mentions: DataFrame, out_dir: str, paper_col: str = "paper_name",
                       files: int | None = None) -> None:
    """SNK9: one JSON record per paper, ``{"paper_pdf": ..., "entities": [...]}``
    in text order, one record a line, many papers to a file (a folder for each
    paper would be a small-file problem).  ``read_entity_files`` takes the
    paper from the record.  One paper's mention list is bounded by the paper's
    length."""
    docs = (mentions.groupBy(paper_col)
            .agg(F.array_sort(F.collect_list(F.struct("start_char", "end_char", "text", "label")))
                 .alias("_m"))
            .select(F.col(paper_col).alias("paper_pdf"), F.transform("_m", lambda m: F.struct(
                m["text"].alias("text"), m["start_char"].alias("start_char"),
                m["end_char"].alias("end_char"), m["label"].alias("label"))).alias("entities")))
    if files:
        docs = docs.repartition(files, "paper_pdf")
    docs.write.mode("errorifexists").json(out_dir)


def insert_or_ignore_links(existing: DataFrame, names: DataFrame, entities: DataFrame, key: list[str],
                           paper_col: str = "paper_id", id_col: str = "entity_id") -> DataFrame:
    """SNK7 + JN5: link each paper to the stored entities named in ``names``
    (paper and natural key), with count 1; links that are stored already stay
    as they are."""
    found = lookup_ids(names.select(paper_col, *key).distinct(), entities, key, id_col).select(id_col, paper_col).distinct()
    fresh = _absent(found, existing, [id_col, paper_col]).withColumn("count", F.lit(1).cast("long"))
    return existing.select(id_col, paper_col, "count").unionByName(fresh.select(id_col, paper_col, "count"))
