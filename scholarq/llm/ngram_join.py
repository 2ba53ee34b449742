"""N-gram Jaccard join: documents whose 5-word shingle sets have a similarity of 0.8 or more.

1. Texts become sets of 64-bit shingle hashes. Documents with equal sets form a class,
   named by a digest of the set; each class goes through the join once per task.
2. PartEnum signatures (``partenum``) of each class are dealt out by signature, packed
   into one byte string for each task and bucket. A bucket's task sorts them and keeps
   the groups of classes that share one.
3. Each group's members are tested against its smallest class. What passes the bound
   of the parity sketches is verified exactly on the texts. Linked classes make components.
4. In groups that still hold several components, members of different components are
   compared by their sketches, in blocks, so that a large group is many tasks. First only a
   forest of the nearest pairs within the bound is verified, which joins most of what belongs
   together; then, in groups that have further pairs, all of them between components that
   are still different. Within a component no pair is formed. So no link between
   different components is missed, and the components are those of all links.

Texts that take part in a verification move once per round; otherwise only hashes do.
The number of rows made is bounded by the signatures and the pairs that pass the bound.

Defined cases: a text with fewer than 5 words is one shingle; null, empty and blank texts
have no shingle and link with nothing; repeated rows are one class; a null doc_id takes part and
never names a component unless all its members have none; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.llm import partenum
from scholarq.llm.common import SPACE_CLASS, partitions, row_slices, stored, utf8
from scholarq.llm.components import components
from scholarq.llm.shingles import shingle_sets

#: Signatures a task holds before it hands them on (12 bytes each).
FLUSH_SIGNATURES = 3_000_000
BUCKETS_PER_PARTITION = 16
#: Members of a group that are compared in one go; larger groups are cut into pairs of blocks.
BLOCK = 2048
#: Members per task and centre in exact verification.
STAR = 256
PACKED = np.dtype([("s", "<u4"), ("c", "<u8")])


def class_name(elements: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    return int.from_bytes(hashlib.blake2b(elements.tobytes(), digest_size=8).digest(), "little", signed=True)


def digest(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each document: id, hash of the text, set size, class, sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in row_slices(batches):
            sets = shingle_sets(utf8(part.column(2)))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array(map(len, sets), pa.int64()),
                pa.array([class_name(x) if len(x) else None for x in sets], pa.int64()),
                pa.array([partenum.parity_sketch(x) if len(x) else None for x in sets], pa.binary()),
            ], ["doc_id", "t", "n", "c", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")
                       ).mapInArrow(run, "doc_id long, t long, n long, c long, sketch binary")


def shared_signatures(docs: DataFrame, text_col: str) -> DataFrame:
    """(g, c, centre): group, member class and smallest class of each group of two or more."""
    n_parts = partitions(docs.sparkSession)
    buckets = n_parts * BUCKETS_PER_PARTITION

    def packed(found: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        s = np.concatenate(found) if found else np.zeros(0, dtype=np.uint64)
        rows = np.empty(len(s), dtype=PACKED)
        rows["s"] = s & np.uint64(0xFFFFFFFF)
        rows["c"] = np.repeat(np.array(names, dtype=np.int64).astype(np.uint64), [len(x) for x in found])
        bucket = ((s >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cut = np.flatnonzero(np.diff(bucket)) + 1
        parts = np.split(rows, cut) if len(rows) else []
        return pa.RecordBatch.from_arrays([
            pa.array(bucket[np.concatenate([[0], cut])] if len(rows) else [], pa.int32()),
            pa.array([p.tobytes() for p in parts], pa.binary())], ["bucket", "rows"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        found, names, held = [], [], 0
        for part in row_slices(batches):
            for x in shingle_sets(utf8(part.column(0))):
                if len(x) >= partenum.FEWEST and (name := class_name(x)) not in met:
                    met.add(name)
                    found.append(partenum.signatures(x))
                    names.append(name)
                    held += len(found[-1])
            if held >= FLUSH_SIGNATURES:
                yield packed(found, names)
                found, names, held = [], [], 0
        yield packed(found, names)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_bucket: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_bucket.setdefault(b, []).append(rows)
        while by_bucket:
            b, parts = by_bucket.popitem()
            rows = np.frombuffer(b"".join(parts), dtype=PACKED)
            s, c = rows["s"].copy(), rows["c"].astype(np.int64)
            order = np.lexsort((c, s))
            s, c = s[order], c[order]
            new = np.ones(len(s), dtype=bool)
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
            s, c = s[new], c[new]
            starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            sizes = np.diff(np.append(starts, len(s)))
            keep = np.repeat(sizes > 1, sizes)
            if keep.any():
                centre = np.repeat(c[starts], sizes)[keep]
                g = (np.int64(b) << np.int64(32)) | s[keep].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c[keep]), pa.array(centre)], ["g", "c", "centre"])

    return (docs.select(F.col(text_col).alias("text")).mapInArrow(sign, "bucket int, rows binary")
            .repartition(n_parts, "bucket").mapInArrow(group, "g long, c long, centre long"))


def within_bound(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow the similarity."""
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("c").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"k{side}")), side)
    num, den = partenum.NUM, partenum.DEN
    pairs = pairs.filter(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb, ka, kb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                words = min(len(ka[i]), len(kb[i])) // 8
                apart = np.bitwise_count(partenum.folded(ka[i], words) ^ partenum.folded(kb[i], words)).sum()
                keep.append(bool(apart <= partenum.most_apart(na[i], nb[i])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(run, "a long, b long")


def similar(docs: DataFrame, text_col: str, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are similar, by their texts. Members of a star around ``a`` are
    dealt out in parts of about ``STAR``, with a copy of the centre each."""
    stars = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    parts = F.ceil(F.col("members") / STAR).cast("int")
    wanted = (pairs.join(stars, "a").select(F.col("b").alias("c"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), parts).alias("part"))
              .unionByName(stars.select(F.col("a").alias("c"), F.col("a").alias("centre"),
                                        F.explode(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1)).alias("part"))))
    wanted = stored(wanted, "wanted")
    needed = wanted.select("c").distinct().join(classes.select("c", "t"), "c")

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        squeeze = zstandard.ZstdCompressor(level=1)
        for part in row_slices(batches):
            rows = [(t, squeeze.compress(x)) for t, x in zip(part.column(0).to_pylist(), utf8(part.column(1)), strict=True)
                    if not (t in met or met.add(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["t", "z"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        at, middle = None, np.zeros(0, dtype=np.uint64)
        for part in row_slices(batches):
            centre, star, c, z = (x.to_pylist() for x in part.columns)
            sets = shingle_sets([unpack.decompress(x) for x in z])
            linked = []
            for i, x in enumerate(sets):
                if c[i] == centre[i]:
                    at, middle = (centre[i], star[i]), x
                elif at == (centre[i], star[i]):
                    both = len(np.intersect1d(middle, x, assume_unique=True))
                    if both * partenum.DEN >= partenum.NUM * (len(x) + len(middle) - both):
                        linked.append((centre[i], c[i]))
                else:
                    raise RuntimeError("a member came before its centre")
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked], pa.int64()) for i in (0, 1)], ["a", "b"])

    texts = docs.select(F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text")).mapInArrow(shrink, "t long, z binary")
    found = texts.join(needed, "t").select("c", "z").join(wanted, "c")
    ordered = (found.repartition(partitions(docs.sparkSession), "centre", "part")
               .sortWithinPartitions("centre", "part", F.col("c") != F.col("centre"))
               .select("centre", "part", "c", "z"))
    return ordered.mapInArrow(verify, "a long, b long").distinct()


def across(shared: DataFrame, labels: DataFrame, classes: DataFrame, forest: bool) -> DataFrame:
    """(a, b, g): pairs of classes that share a signature, are in different components and within the bound.

    With ``forest`` a group gives only pairs that would join components not joined by nearer
    pairs of it, so fewer pairs than members; ``g`` is then set where the group has further pairs.
    """
    rows = (shared.select("g", "c").join(labels, shared["c"] == labels["node"], "left")
            .select("g", "c", F.coalesce("component", "c").alias("component")))
    rows = stored(rows, "labelled")
    open_ = rows.groupBy("g").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("members")
                                  ).filter("x != y").select("g", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(open_, "g").join(classes.select("c", "n", "sketch"), "c")
    # A group of several blocks is compared block against block; each member goes to all pairs with its block.
    own = F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "c", "component", "n", "sketch")

    def near(rows_: list[tuple]) -> Iterator[tuple[int, int, int]]:
        """(distance of the sketches, row, row) of the pairs within the bound."""
        i, j = rows_[0][1], rows_[0][2]
        words = min(len(r[7]) for r in rows_) // 8
        k = np.stack([partenum.folded(r[7], words) for r in rows_])
        n, own, component = (np.array([r[x] for r in rows_]) for x in (6, 3, 5))
        for x in range(len(rows_) - 1):
            # Sorted by size: partners of x end where sizes exceed what a similar set may have.
            end = int(np.searchsorted(n, n[x] * partenum.DEN // partenum.NUM, side="right"))
            if x + 1 >= end:
                continue
            part = slice(x + 1, end)
            apart = np.bitwise_count(k[part] ^ k[x]).sum(1)
            ok = (apart <= partenum.most_apart(n[part], n[x])) & (component[part] != component[x])
            if i != j:
                ok &= own[part] != own[x]
            for y in np.flatnonzero(ok).tolist():
                yield int(apart[y]), x, x + 1 + y

    def compare(rows_: list[tuple]) -> list[tuple[int, int, int | None]]:
        rows_.sort(key=lambda r: (r[6], r[4]))
        pairs = list(near(rows_))
        kept, further = pairs, None
        if forest:
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            kept = []
            for pair in sorted(pairs):
                x, y = (root(rows_[at][5]) for at in pair[1:])
                if x != y:
                    parent[x] = y
                    kept.append(pair)
            further = rows_[0][0] if len(kept) < len(pairs) else None
        return [(*sorted((rows_[x][4], rows_[y][4])), further) for _, x, y in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([p[x] for p in found], pa.int64()) for x in range(3)], ["a", "b", "g"])

        at, held = None, []
        found: set[tuple] = set()
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != at:
                    if len(held) > 1:
                        found.update(compare(held))
                    at, held = row[:3], []
                held.append(row)
            if len(found) >= 100_000:
                yield out(found)
                found = set()
        if len(held) > 1:
            found.update(compare(held))
        yield out(found)

    return (rows.repartition(partitions(shared.sparkSession), "g", "i", "j").sortWithinPartitions("g", "i", "j")
            .mapInArrow(run, "a long, b long, g long").distinct())


def labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The digest of each document with its component and the smallest id in it; both are null without a shingle."""
    rows = stored(digest(docs, id_col, text_col), "digests")
    classes = stored(rows.filter("c is not null").groupBy("c").agg(
        F.min("doc_id").alias("doc_id"), F.min("t").alias("t"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "classes")
    shared = stored(shared_signatures(docs, text_col), "shared")

    tried = stored(shared.filter("c != centre").select(F.col("centre").alias("a"), F.col("c").alias("b")).distinct(), "stars")
    links = stored(similar(docs, text_col, classes, stored(within_bound(tried, classes), "near")), "links")
    labels = components(links)
    for forest in (True, False):
        pairs = stored(across(shared, labels, classes, forest), "across")
        fresh = stored(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "fresh")
        if not fresh.isEmpty():
            tried = tried.unionByName(fresh)
            links = links.unionByName(stored(similar(docs, text_col, classes, fresh), "links"))
            labels = components(links)
        shared = shared.join(pairs.select("g").filter("g is not null").distinct(), "g", "left_semi")

    named = classes.select("c", "doc_id").join(labels, classes["c"] == labels["node"], "left").select(
        "c", "doc_id", F.coalesce("component", "c").alias("component"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stored(named.join(smallest, "component").select("c", "component", "component_id"), "components")
    return rows.join(named, "c", "left")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of each document."""
    return labelled(docs, id_col, text_col).select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component only, and all documents without a shingle.

    The row is one with the smallest id; documents without an id stay only where no member of
    their component has one, and then the smallest class stays."""
    # The first by id, class and text; each is known by id and text, as ids may be null or repeated.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "c", "t"))
    keep = (labelled(docs, id_col, text_col).filter("c is not null").groupBy("component").agg(first.alias("first"))
            .select(F.col("first.doc_id").alias("__keep"), F.col("first.t").alias("__text")))
    blank = ~F.coalesce(F.col(text_col), F.lit("")).rlike(f"[^{SPACE_CLASS}]")
    kept = docs.filter(~blank).join(
        keep, F.col(id_col).cast("long").eqNullSafe(F.col("__keep")) & (F.xxhash64(text_col) == F.col("__text")), "left_semi")
    return kept.dropDuplicates([id_col, text_col]).unionByName(docs.filter(blank))


#: DuckDB's form of ``join`` over ``documents``: the links by shared shingles, then reachability.
SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS gs FROM s GROUP BY doc_id
), class AS (
  SELECT min(doc_id) AS c, any_value(n) AS n, gs FROM n GROUP BY gs
), member AS (
  SELECT n.doc_id, class.c FROM n JOIN class USING (gs)
), cs AS (
  SELECT c, n, unnest(gs) AS g FROM class
), pair AS (
  SELECT a.c AS a, b.c AS b FROM cs a JOIN cs b ON a.g = b.g AND a.c < b.c
  WHERE 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
  GROUP BY a.c, b.c HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))
), edge AS (
  SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair
), reach AS (
  SELECT c AS a, c AS b FROM class
  UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN member USING (doc_id)
LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = member.c
"""
