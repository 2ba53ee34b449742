"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and line rules (ASCII only), as a regex class body and as characters.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed.

    A lambda that names an expression evaluates it again for each element; a
    lambda variable does not.
    """
    return F.transform(F.array(value), body)[0]


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors see: below ``spark.checkpoint.dir``.

    Only a local master may do without that setting.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="scholarq-llm-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut,
    and a lost executor costs no recomputation of what came before."""
    path = shared_folder(df.sparkSession, purpose)
    schema = df.schema
    df.write.parquet(path)
    back = df.sparkSession.read.schema(schema).parquet(path)
    back.stored_at = path
    return back


def remove(spark: SparkSession, path: str) -> None:
    """Remove intermediate files that nothing will read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unstored(df: DataFrame) -> None:
    """Remove the files of a table of ``stored``."""
    remove(df.sparkSession, df.stored_at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices, so that a batch of long texts is decoded piece by piece."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a string column as UTF-8 bytes; null gives no bytes."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
