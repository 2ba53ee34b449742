"""SRC1 (manifest), SRC2 (directory listing), PRJ1 (path derivation)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_DIR, DOCS_DIR, JSON_DIR, ENTS_DIR = "Papers", "Docs", "JSON", "Ents"


def derive_paths(manifest: DataFrame) -> DataFrame:
    """PRJ1: from the manifest's bare pdf file name derive the four paths."""
    pdf = F.col("paper_pdf")
    return manifest.select(
        *[c for c in manifest.columns if c not in ("paper_pdf",)],
        F.concat_ws("/", F.lit(SOURCE_DIR), pdf).alias("paper_pdf"),
        F.concat_ws("/", F.lit(DOCS_DIR), F.concat(pdf, F.lit(".docx"))).alias("paper_docx"),
        F.concat_ws("/", F.lit(JSON_DIR), F.concat(pdf, F.lit(".json"))).alias("paper_json"),
        F.concat_ws("/", F.lit(ENTS_DIR), F.concat(pdf, F.lit(".json"))).alias("paper_entities"),
    )


def read_manifest(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """SRC1: header row trimmed, one row per paper.  ``_line`` orders the
    rows (needed for 'last row wins'): by the file's whole path, then place in the file.
    Running ids alone follow the packing of splits into tasks, not files."""
    if fmt == "csv":
        df = spark.read.option("header", True).csv(path)
    else:
        df = spark.read.format(fmt).load(path)
    line = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    return df.select(*[F.col(f"`{c}`").alias(c.strip()) for c in df.columns], line.alias("_line"))


def list_directory(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: the files of a folder as (path, name, length, modificationTime);
    the content column is never read."""
    return (spark.read.format("binaryFile").load(path)
            .select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                    "length", "modificationTime"))


def match_manifest(files: DataFrame, manifest: DataFrame, key: str = "paper_pdf") -> tuple[DataFrame, DataFrame]:
    """JN3/JN4: files matched to manifest rows (last manifest row per key
    wins) and the unmatched files.  ``files`` has a ``name`` column holding
    the bare file name; ``manifest`` has ``_line`` ordering its rows."""
    last = (manifest.groupBy(key)
            .agg(F.max_by(F.struct(*[c for c in manifest.columns]), F.col("_line")).alias("r"))
            .select("r.*").drop("_line"))
    matched = files.join(last, files.name == last[key], "inner")
    unmatched = files.join(last, files.name == last[key], "left_anti")
    return matched, unmatched
