"""File sources: entity annotations (SRC3), document trees (SRC4), the
NDJSON metadata snapshot (SRC5), Atom feeds (SRC6), record preview (SRC7)
and stored tables (SRC8).  All with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholarq.schemas import ENTS_RECORD, SNAPSHOT_RECORD

PREVIEW_ROWS = 5
PREVIEW_ABSTRACT_CHARS = 200
#: A compressed file is read by one task.
TREES_A_FILE = 20_000


def parse_entity_records(raw: DataFrame) -> DataFrame:
    """(file_name, value) JSON texts -> (file_name, paper_pdf, entities, malformed).

    The paper is the record's ``paper_pdf``, else the file name without
    ``.json``.  A text that is not JSON, or has no list of entities, is malformed."""
    parsed = F.from_json("value", ENTS_RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rec = raw.select("file_name", "value", parsed.alias("r"))
    bad = F.try_parse_json("value").isNull() | F.col("r._corrupt").isNotNull() | F.col("r.entities").isNull()
    return rec.select(
        "file_name", F.coalesce("r.paper_pdf", F.regexp_replace("file_name", r"\.json$", "")).alias("paper_pdf"),
        F.when(~bad, F.col("r.entities")).alias("entities"), F.coalesce(bad, F.lit(True)).alias("malformed"))


def entity_texts(reader, path: str, per_line: bool) -> DataFrame:
    """Whole files, or lines of files that hold a record a line, with their file name.
    Blank lines are no records; a blank file is a record, and malformed.  Spark's readers pass over
    files without a byte: ``empty_files`` names those."""
    texts = (reader.option("wholetext", not per_line).text(path)
             .select(F.col("_metadata.file_name").alias("file_name"), "value"))
    return texts.filter(F.trim("value") != "") if per_line else texts


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_name): the files of a folder that have no byte, which no reader of Spark returns."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [(s.getPath().getName(),) for s in fs.listStatus(folder) if s.isFile() and s.getLen() == 0]
    return spark.createDataFrame(names, "file_name string")


def rejected_entity_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC3: (file_name, reason) of the files that hold no record: malformed, or empty."""
    raw = parse_entity_records(entity_texts(spark.read, path, per_line=False))
    return (raw.filter("malformed").select("file_name", F.lit("malformed").alias("reason"))
            .unionByName(empty_files(spark, path).withColumn("reason", F.lit("empty"))))


def read_entity_files(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """SRC3: one JSON document per paper (a file each, or a line each) -> one
    row per mention (file_name, paper_pdf, mention_no, text, start_char,
    end_char, label).  A document with an empty list, or malformed, contributes
    no rows."""
    raw = parse_entity_records(entity_texts(spark.read, path, per_line))
    return (raw.select("file_name", "paper_pdf", F.posexplode("entities").alias("mention_no", "m"))
            .select("file_name", "paper_pdf", "mention_no", "m.text", "m.start_char", "m.end_char", "m.label"))


def write_document_trees(trees: DataFrame, out_dir: str, paper_col: str, tree_col: str = "tree") -> None:
    """Trees in the form that ``read_document_trees(per_line=True)`` reads: ``{"paper_pdf": ..., "tree": "<JSON text>"}``,
    one record a line, many papers to a file (a file for each paper would be a small-file problem)."""
    record = F.to_json(F.struct(F.col(paper_col).cast("string").alias("paper_pdf"), F.col(tree_col).alias("tree")))
    (trees.select(record.alias("value")).write.option("compression", "gzip")
     .option("maxRecordsPerFile", TREES_A_FILE).text(out_dir))


def read_document_trees(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """SRC4: (path, file_name, paper_pdf, tree) JSON texts: whole files, or the records of files that hold a
    record a line (``write_document_trees``)."""
    if per_line:
        rec = F.from_json("value", "paper_pdf string, tree string")
        return (spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"), rec.alias("r"))
                .select("path", "file_name", "r.paper_pdf", "r.tree"))
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file_name"),
                    F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "").alias("paper_pdf"),
                    F.col("value").alias("tree")))


def snapshot_from_lines(lines: DataFrame, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parse NDJSON lines: (records, rejects).  Blank lines are skipped,
    malformed ones go to ``rejects`` (value) instead of failing the job."""
    v = F.col(value_col)
    nonblank = lines.filter(F.trim(v) != "")
    ok = F.try_parse_json(v).isNotNull()
    recs = (nonblank.filter(ok).select(F.from_json(v, SNAPSHOT_RECORD).alias("r")).select("r.*")
            .withColumnRenamed("journal-ref", "journal_ref"))
    rejects = nonblank.filter(~ok).select(v.alias("value"))
    return recs, rejects


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(value, line): the lines of a text source, numbered from 1 in the order of file paths.

    Each task reads its splits from front to back, so a line's number in its split is its running id less
    the split's first one; the lines before a split are a running sum over a table with a row for each split.
    """
    placed = lines.select("value", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_at"),
                          F.monotonically_increasing_id().alias("_id"))
    splits = placed.groupBy("_path", "_at").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_path", "_at").rowsBetween(Window.unboundedPreceding, -1))
    offsets = splits.select("_path", "_at", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return (placed.join(F.broadcast(offsets), ["_path", "_at"])  # a row for each split
            .select("value", (F.col("_id") + F.col("_shift")).alias("line")))


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first ``n`` lines of the files of ``path``, in the order of their paths.  Files are taken up
    in growing numbers until they hold enough lines; later ones are not read."""
    files = sorted(spark.read.text(path).inputFiles())
    taken, found = 0, 0
    while found < n and taken < len(files):
        more = files[taken:max(1, 2 * taken)]
        found += spark.read.text(more).count()
        taken += len(more)
    if not taken:
        return spark.read.text(path)
    return numbered_lines(spark.read.text(files[:taken])).filter(F.col("line") <= n).select("value")


def read_snapshot(spark: SparkSession, path: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC5: the metadata snapshot.  ``limit`` counts lines from the top, in the order of
    file paths, bad and blank ones included; 0/None reads everything."""
    return snapshot_from_lines(first_lines(spark, path, limit) if limit else spark.read.text(path))


ATOM_ENTRY = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
    T.StructField("category", T.ArrayType(T.StructType([T.StructField("_term", T.StringType())]))),
    T.StructField("published", T.StringType()),
    T.StructField("updated", T.StringType()),
])


def read_atom_feed(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC6: (records, total).  Records: arxiv_id (text after '/abs/'),
    title, abstract, authors, categories, published, updated, pdf_url.
    total: the feed's totalResults, or the number of entries when absent."""
    from scholarq.operators.search import id_from_url, pdf_url
    e = (spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True)
         .schema(ATOM_ENTRY).load(path))
    recs = e.select(
        id_from_url(F.col("id")).alias("arxiv_id"), "title", F.col("summary").alias("abstract"),
        F.transform(F.coalesce("author", F.array()), lambda a: a["name"]).alias("authors"),
        F.transform(F.coalesce("category", F.array()), lambda c: c["_term"]).alias("categories"),
        F.try_to_timestamp("published").alias("published"), F.try_to_timestamp("updated").alias("updated"))
    recs = recs.withColumn("pdf_url", pdf_url(F.col("arxiv_id")))
    feed = (spark.read.format("xml").option("rowTag", "feed").option("ignoreNamespace", True)
            .schema(T.StructType([T.StructField("totalResults", T.LongType())])).load(path))
    counted = recs.agg(F.count(F.lit(1)).alias("n"))
    total = (feed.agg(F.max("totalResults").alias("t")).crossJoin(counted)
             .select(F.coalesce("t", "n").alias("total_results")))
    return recs, total


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def record_preview(spark: SparkSession, single_record_path: str, ndjson_path: str) -> DataFrame:
    """SRC7: a single-record file when it exists, else the first lines of the
    snapshot; abstract cut to 200 characters + '...', missing fields 'N/A'."""
    if _exists(spark, single_record_path):
        recs = (spark.read.schema(SNAPSHOT_RECORD).option("multiLine", True).json(single_record_path)
                .withColumnRenamed("journal-ref", "journal_ref"))
    else:
        recs, _ = read_snapshot(spark, ndjson_path, PREVIEW_ROWS)
    na = F.lit("N/A")
    abstract = F.when(F.col("abstract").isNull(), na).otherwise(
        F.concat(F.substring("abstract", 1, PREVIEW_ABSTRACT_CHARS), F.lit("...")))
    return recs.limit(PREVIEW_ROWS).select(F.coalesce("id", na).alias("id"), F.coalesce("title", na).alias("title"),
                                           F.coalesce("authors", na).alias("authors"),
                                           F.coalesce("categories", na).alias("categories"),
                                           abstract.alias("abstract"))
