"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to the same number of bits, each row gets
its index on the Hilbert curve through that grid, rows are sorted by the index and
the sorted sequence is cut into runs. Rows near each other in all dimensions share
a shard, so min/max statistics of the written files prune on any of them.

The law is ``rows``: run k holds the positions from ceil(k*N/S) to
ceil((k+1)*N/S) - 1, so counts are at most one apart. Positions come from one range
sort of the keys (no text moves), local row numbers and an offset per partition;
the sorted keys are written to the shared folder first, so numbering cannot change
when a task runs again.

Everything is DataFrame work; no Python runs on executors.

Defined cases: a null in a dimension takes cell 0 of it; a null text has no bytes
(size 16, CRC 0); rows equal in all keys are interchangeable; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarq.llm.common import partitions, stored

SHARDS = 40
BITS = 6
ROW_OVERHEAD = 16


def _rotate(value: int, by: int, dims: int) -> int:
    by %= dims
    return ((value << by) | (value >> (dims - by))) & ((1 << dims) - 1)


@lru_cache
def curve_states(dims: int) -> tuple[list[int], list[int]]:
    """The Hilbert curve as a state machine: digit and next state for state * 2^dims + cell.

    A state is an entry corner and a direction; cells of a state are visited in the order
    of the reflected Gray code, rotated and reflected by that state (Hamilton 2006).
    """
    size = 1 << dims
    entry = [0] + [(g := 2 * ((w - 1) // 2)) ^ (g >> 1) for w in range(1, size)]
    ones = lambda w: (w ^ (w + 1)).bit_count() - 1  # noqa: E731  trailing ones
    turn = [0] + [ones(w - 1) % dims if w % 2 == 0 else ones(w) % dims for w in range(1, size)]
    rank = {w ^ (w >> 1): w for w in range(size)}
    digits, following = [], []
    for state in range(size * dims):
        corner, direction = divmod(state, dims)
        for cell in range(size):
            w = rank[_rotate(cell ^ corner, dims - (direction + 1) % dims, dims)]
            digits.append(w)
            following.append((corner ^ _rotate(entry[w], direction + 1, dims)) * dims + (direction + turn[w] + 1) % dims)
    return digits, following


def hilbert_index(cells: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell given by ``bits``-bit integers; fits 63 bits in all."""
    dims = len(cells)
    if not 2 <= dims <= 4 or dims * bits > 62:
        raise ValueError("2 to 4 dimensions and at most 62 bits in all")
    digits, following = (F.array(*map(F.lit, t)) for t in curve_states(dims))
    point = F.array(*[c.cast("int") for c in cells])

    def at(p, shift):
        parts = [F.getbit(F.get(p, F.lit(d)), shift).cast("int") * (1 << d) for d in range(dims)]
        return reduce(lambda a, b: a + b, parts)

    # One fold over the bits, from the highest; tables and point are bound once per row.
    bound = F.array(F.struct(point.alias("p"), digits.alias("d"), following.alias("f")))
    return F.transform(bound, lambda b: F.aggregate(
        F.transform(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), lambda s: at(b["p"], s)),
        F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index")),
        lambda a, cell: F.struct(
            F.get(b["f"], a["state"] * (1 << dims) + cell).alias("state"),
            (a["index"] * (1 << dims) + F.get(b["d"], a["state"] * (1 << dims) + cell)).cast("long").alias("index")),
        lambda a: a["index"]))[0]


def quantised(docs: DataFrame, columns: list[str], bits: int = BITS) -> list[Column]:
    """A ``bits``-bit cell for each column. Numbers are cut at approximate quantiles of the whole
    table, so that cells hold like numbers of rows; other types take the leading bits of a hash."""
    numeric = [c for c in columns if dict(docs.dtypes)[c] in ("tinyint", "smallint", "int", "bigint", "float", "double")]
    cuts: dict[str, list] = {}
    if numeric:
        shares = [i / (1 << bits) for i in range(1, 1 << bits)]
        row = docs.agg(*[F.percentile_approx(c, shares, 4 << bits).alias(c) for c in numeric]).first()
        cuts = {c: sorted(set(row[c] or [])) for c in numeric}

    def cell(c: str) -> Column:
        if c not in cuts:
            return F.coalesce(F.shiftrightunsigned(F.xxhash64(c), 64 - bits), F.lit(0)).cast("int")
        return _bucket(F.col(c), cuts[c])

    return [cell(c) for c in columns]


def _bucket(value: Column, cuts: list) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, by a balanced tree of comparisons."""
    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value < cuts[mid], tree(low, mid)).otherwise(tree(mid + 1, high))

    return F.when(value.isNull(), F.lit(0)).otherwise(tree(0, len(cuts)))


def ranked(rows: DataFrame, order: list[str], position: str) -> DataFrame:
    """``rows`` with their 0-based position in ``order``, without a single-partition window."""
    spark = rows.sparkSession
    kept = stored(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
                  .withColumn("__at", F.monotonically_increasing_id()), "sorted-keys")
    part = F.shiftright("__at", 33)
    # One row for each partition: the window below sees no more rows than there are partitions.
    counts = kept.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n")).orderBy("__part").collect()
    offsets, total = [], 0
    for row in counts:
        offsets.append((row["__part"], total))
        total += row["__n"]
    offsets = spark.createDataFrame(offsets, "__part long, __offset long")
    out = (kept.withColumn("__part", part).join(F.broadcast(offsets), "__part")
           .withColumn(position, F.col("__offset") + F.col("__at").bitwiseAND((1 << 33) - 1))
           .drop("__part", "__offset", "__at"))
    return out.withColumn("__total", F.lit(total).cast("long"))


def assign(docs: DataFrame, dimensions: list[str], shards: int = SHARDS, id_col: str = "doc_id",
           text_col: str = "text", bits: int = BITS) -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot and the curve index."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
        hilbert_index(quantised(docs, dimensions, bits), bits).alias("curve"))
    placed = ranked(keys, ["curve", "text_hash", "doc_id"], "position")
    shard = F.expr(f"position * {shards} div __total")
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("position") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(docs: DataFrame, path: str, dimensions: list[str], shards: int = SHARDS, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write ``docs`` as one folder for each shard, rows in curve order."""
    keys = ["id", "crc", "size", "copy"]
    # Rows equal in id and text are interchangeable: copies are numbered on both sides.
    same = Window.partitionBy("id", "crc", "size")
    placed = assign(docs, dimensions, shards, id_col, text_col).select(
        F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc"), "size", "shard", "slot")
    placed = placed.withColumn("copy", F.row_number().over(same.orderBy("shard", "slot")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                        F.crc32(text.cast("binary")).alias("crc"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"))
    whole = whole.withColumn("copy", F.row_number().over(same.orderBy(F.lit(0))))
    on = [whole[k].eqNullSafe(placed[k]) for k in keys]
    (whole.join(placed, on).select("row", "shard", "slot")
     .repartition(shards, "shard").sortWithinPartitions("shard", "slot")
     .select(*[F.col("row")[c].alias(c) for c in docs.columns], "shard")
     .write.partitionBy("shard").parquet(path))


def places(docs: DataFrame) -> DataFrame:
    return assign(docs, ["source", "n_chars", "doc_id"])
