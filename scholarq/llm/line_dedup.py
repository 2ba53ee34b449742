"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space and lower-cased in A-Z. The
store holds runs: Parquet tables of (two 64-bit hashes of the key, documents that
hold it, its holder), each sorted by hash. A new batch is merged
against the runs by an equi-join on the hash. Keys that the runs lack are its own: the batch's largest
document becomes their holder for good. Keys they have are repeats, which only add to
the count. Both go into a new run of level 0. As soon as a level
has ``fanout`` runs they are compacted into one run of the next level, so the
number of runs stays logarithmic in the number of batches. A store can be opened again and fed more batches.

``build_runs`` brings the batches in falling order of doc_id, so the holder of a key, which
is of the batch that brings the key first, is its largest document.

Everything is DataFrame work; no Python runs on executors. A frequent line costs
one row per task (partial aggregation), and the join that marks its copies is an
equi-join whose hot partitions Spark splits. Only hashes, not texts, are kept.

Defined cases: each row is a document (repeated rows count separately and are
treated alike); a null or empty text is one empty line; a null doc_id ranks below
all ids; an empty table gives an empty result; other columns pass through
``drop_repeated_lines`` unchanged.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarq.llm.common import LOWER, SPACE_CHARS, UPPER, let, remove, shared_folder, stored

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3
RUN = "h1 long, h2 long, n_docs long, top_doc long, fresh boolean"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), UPPER, LOWER)


def key_hashes(key: Column) -> Column:
    """128 bits in two columns; at 10^12 lines a 64-bit hash alone would collide."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def long_keys(text: Column, min_chars: int) -> Column:
    """One struct (line number, h1, h2) for each line whose key is long enough."""
    keyed = F.transform(lines(text), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("k")))
    return F.transform(F.filter(keyed, lambda x: F.length(x["k"]) >= min_chars), lambda x: F.struct(
        x["pos"].alias("pos"), key_hashes(x["k"]).alias("h")))


class LineRuns:
    """Levelled sorted runs of line hashes below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder or shared_folder(spark, "line-runs"), fanout
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.batches = 0
        if folder:
            self._reopen()

    def _reopen(self) -> None:
        """Find the runs of an earlier session. A run is named by the batches that it covers, so one whose batches
        are in a run of a higher level (a compaction that did not come to remove it) does not count."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/level-*-batches-*-*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        names = [s.getPath().getParent().getName() for s in found or []]
        runs = sorted((tuple(int(x) for x in n.split("-") if x.isdigit()), n) for n in names)
        for (level, first, last), name in runs:
            if not any(other > level and a <= first and last <= b for (other, a, b), _ in runs):
                self.levels[level].append(f"{self.folder}/{name}")
            self.batches = max(self.batches, last + 1)

    def rows(self) -> DataFrame:
        """All runs as one table; a key may be in several runs until they are compacted."""
        paths = [p for level in self.levels.values() for p in level]
        if not paths:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(*paths)

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> str:
        path = f"{self.folder}/level-{level}-batches-{first}-{last}"
        rows.sortWithinPartitions("h1", "h2").write.mode("overwrite").parquet(path)  # over a run cut short
        return path

    @staticmethod
    def merged(rows: DataFrame) -> DataFrame:
        """One row a key; only its fresh row has a holder."""
        return rows.groupBy("h1", "h2").agg(
            F.sum("n_docs").alias("n_docs"), F.max("top_doc").alias("top_doc"), F.max("fresh").alias("fresh"))

    def ingest(self, keys: DataFrame) -> None:
        """Add one batch of (h1, h2, n_docs, top_doc), one row per key."""
        if any(self.levels.values()):
            known = self.rows().filter("fresh").select("h1", "h2")
            fresh = keys.join(known, ["h1", "h2"], "left_anti").withColumn("fresh", F.lit(True))
            again = (keys.join(known, ["h1", "h2"], "left_semi")
                     .withColumn("top_doc", F.lit(None).cast("long")).withColumn("fresh", F.lit(False)))
            keys = fresh.unionByName(again)
        else:
            keys = keys.withColumn("fresh", F.lit(True))
        self.levels[0].append(self._write(keys, 0, self.batches, self.batches))
        self.batches += 1
        level = 0
        while len(self.levels[level]) >= self.fanout:
            paths = self.levels[level]
            first, last = paths[0].split("-")[-2], paths[-1].split("-")[-1]
            run = self._write(self.merged(self.spark.read.schema(RUN).parquet(*paths)), level + 1, int(first), int(last))
            self.levels[level] = []
            self.levels[level + 1].append(run)
            for path in paths:
                remove(self.spark, path)
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """Keys found in at least ``min_docs`` documents, with their holder."""
        return self.merged(self.rows()).filter(F.col("n_docs") >= min_docs).select("h1", "h2", "top_doc")


def batch_of(id_col: Column, bounds: list[int]) -> Column:
    """0 for the largest ids, then 1, ...; null ids come last."""
    return reduce(lambda c, b: c + F.coalesce(id_col < b, F.lit(True)).cast("int"), bounds, F.lit(0))


def build_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               batches: int = BATCHES, fanout: int = FANOUT) -> LineRuns:
    """Ingest ``docs`` in batches of falling doc_id. Texts are read once: the keys of all
    batches are staged in one table with a folder for each batch."""
    spark = docs.sparkSession
    runs = LineRuns(spark, fanout=fanout)
    shares = [i / batches for i in range(batches - 1, 0, -1)]
    bounds = sorted(set(docs.select(F.percentile_approx(id_col, shares, 1000)).first()[0] or []), reverse=True)
    staged = f"{runs.folder}/staged"
    (docs.select(F.col(id_col).alias("doc"), F.explode_outer(F.array_distinct(F.transform(
        long_keys(F.col(text_col), min_chars), lambda x: x["h"]))).alias("h"))
     .filter("h is not null")
     .groupBy(batch_of(F.col("doc"), bounds).alias("batch"), F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"))
     .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("top_doc"))
     .write.partitionBy("batch").parquet(staged))
    keys = spark.read.schema("h1 long, h2 long, n_docs long, top_doc long, batch int").parquet(staged)
    for batch in range(len(bounds) + 1):
        runs.ingest(keys.filter(F.col("batch") == batch).drop("batch"))
    return runs


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
          min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """The rows of ``docs`` as struct ``row``, with ``kept`` (the text without dropped lines), ``n_lines`` and ``n_dropped``."""
    # The last compaction is written like the others: read as a table of its own, it leaves the join
    # below free to split the partition of a hot line.
    frequent = stored(build_runs(docs, id_col, text_col, min_chars, batches, fanout).frequent(min_docs), "frequent-lines")
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    text = F.col("row")[text_col]
    here = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("x"),
                       F.explode_outer(long_keys(F.col(text_col), min_chars)).alias("k")).filter("k is not null")
    drops = (here.select("id", "x", F.col("k.pos").alias("pos"), F.col("k.h.h1").alias("h1"), F.col("k.h.h2").alias("h2"))
             .join(frequent, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("top_doc")))
             .groupBy("id", "x").agg(F.collect_set("pos").alias("dropped")))
    out = whole.join(drops, F.col("row")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("x")), "left")
    return out.select(
        "row", F.when(F.col("dropped").isNull(), F.coalesce(text, F.lit(""))).otherwise(
            remaining_lines(text, F.col("dropped"))).alias("kept"),
        F.size(lines(text)).cast("long").alias("n_lines"), F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def remaining_lines(text: Column, dropped: Column) -> Column:
    """The lines of ``text`` at positions that are not in ``dropped``, joined again."""
    return let(lines(text), lambda a: F.concat_ws("\n", F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(a) - 1), dropped), lambda i: F.get(a, i))))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the same columns and the kept lines as text."""
    out = dedup(docs, id_col, text_col, **options)
    return out.select(*[(F.col("kept") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select(
        F.col("row")["doc_id"].alias("doc_id"), "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


#: DuckDB's form of ``digests`` over ``documents``.
SQL = """
WITH l AS (
  SELECT r, doc_id, pos, ls[pos] AS line,
         translate(trim(ls[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS pos
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), f AS (
  SELECT k, max(doc_id) AS top FROM (SELECT DISTINCT r, doc_id, k FROM l WHERE length(k) >= 20)
  GROUP BY k HAVING count(*) >= 3
), m AS (
  SELECT l.*, f.k IS NOT NULL AND doc_id IS DISTINCT FROM top AS gone FROM l LEFT JOIN f USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
