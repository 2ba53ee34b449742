"""Ranked lexical search of a set of items over all documents, by a dual-tree search.

A document is a vector of saturated term counts, an item a vector of term weights, and a score is
their inner product. Both sides are put into binary trees whose nodes hold the largest value of
each coordinate below them, so the product of two nodes bounds every score between them.

1. Each document is read once: its number of terms and its counts of the items' terms are written.
   Corpus figures (documents, terms, documents with a term) are sums over that table.
2. Every task puts its documents, a bounded number at a time, into a tree and walks it together with the tree
   of the items. A pair of nodes whose bound is below the weakest k-th score of the node's items is passed over with
   all that is below it: none of its documents can be among the results. Pairs of leaves are
   searched from the highest bound down, item by item, with exact integer scores.
3. A sample of documents is searched first: its k-th scores are lower bounds of the final ones, so
   that all tasks prune from their first tree on. The sample decides the amount of work, never a result.
4. Each task keeps k rows an item; they are merged in two steps.

Items are the stated query set: they are read in blocks of bounded size, each run against all documents.

Defined cases: null and empty texts have no term; an item without terms has no result; repeated items
and documents are ranked each; a null doc_id comes before others of its score; with empty tables the result
is empty; long texts are read in pieces; other columns than id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholarq.llm.common import row_slices, stored, utf8

TOP_K = 50
#: Bound of a block of items, in bytes of text.
BLOCK_BYTES = 8 << 20
#: Items are put into trees of about so many distinct terms at most (one item may have more).
TREE_TERMS = 4096
#: Bounds of a tree of documents: rows, and rows times terms.
TREE_ROWS, TREE_CELLS = 2048, 1 << 23
DOC_LEAF, ITEM_LEAF = 16, 4
#: Leaves whose documents are scored at once.
LEAVES_AT_ONCE = 4
#: Documents of the sample that gives the first bounds, about.
SAMPLE_ROWS = 4096
#: Tasks whose rows are merged in the first step, as a number of groups.
MERGE_GROUPS = 64
PIECE_BYTES = 1 << 20
NO_ID = -(1 << 63)
COUNTS = "doc_id long, n long, terms binary"
RESULT = "item_id long, rank int, doc_id long, score long"
#: Terms are ASCII letters and digits and all beyond ASCII; other signs separate them.
SEPARATED = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of ``text`` with repeats, in lists."""
    text = text.lower().translate(SEPARATED)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class Items:
    """A bounded block of items: their ids, and the numbers of their terms."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.terms = []
        for _, text in rows:
            found = {t for some in terms((text or "").encode()) for t in some}
            self.terms.append(np.array(sorted(self.vocabulary.setdefault(t, len(self.vocabulary)) for t in found), dtype=np.int64))


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    held, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"] or "")
        if size >= BLOCK_BYTES:
            yield Items(held)
            held, size = [], 0
    if held:
        yield Items(held)


def counted(docs: DataFrame, items: Items, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms): all terms of a document with repeats, and (number, count) of each term that some item has."""
    shared = docs.sparkSession.sparkContext.broadcast(items.vocabulary)  # words of at most BLOCK_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in row_slices(batches):
            sizes, blobs = [], []
            for text in utf8(batch.column(1)):
                n, found = 0, Counter()
                for some in terms(text):
                    n += len(some)
                    found.update(map(number, some))
                found.pop(None, None)
                pairs = np.array(sorted(found.items()), dtype=np.uint32).reshape(-1, 2)
                sizes.append(n)
                blobs.append(pairs.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                                             ["doc_id", "n", "terms"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, COUNTS)


def pairs_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all blobs of a column."""
    blobs = column.to_pylist()
    pairs = np.frombuffer(b"".join(blobs), dtype=np.uint32).reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(blobs)), [len(b) // 8 for b in blobs]), pairs[:, 0], pairs[:, 1]


class Corpus:
    """Figures of all documents: how many have a term, all terms with repeats, and the weight of each term."""

    def __init__(self, found: DataFrame, n_terms: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(n_terms, dtype=np.int64)
            for batch in row_slices(batches):
                total += np.bincount(pairs_of(batch.column(0))[1], minlength=n_terms)
            own = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(total[own])], ["term", "df"])

        sums = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
        self.documents, self.terms = sums["n"], sums["l"]
        df = np.zeros(n_terms, dtype=np.int64)
        for r in found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r["term"]] = r["df"]  # one row for each term of the block
        self.weights = np.array([math.floor(1000 * math.log((2 * self.documents + 2) / (2 * x + 1))) for x in df.tolist()], dtype=np.int64)

    def saturated(self, n: list[int], row: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """The coordinates of documents of ``n`` terms: count ``tf`` of a term in document ``row``."""
        m = np.array([50 + 50 * x * self.documents // self.terms for x in n], dtype=np.int64)
        return 1_000_000_000 * tf // (1000 * tf + 20 * m[row])


class Tree:
    """A binary tree over the rows of a matrix. Rows are reordered so that each node holds neighbours; a
    node is the largest value of each column among its rows."""

    def __init__(self, rows: np.ndarray, leaf: int):
        n = len(rows)
        self.depth = max(0, math.ceil(math.log2(n / leaf))) if n else 0
        # nodes are halved across their longest extent, seen in a few random projections
        seen = rows @ np.random.default_rng(3).standard_normal((rows.shape[1], 16)).astype(rows.dtype)
        self.order = np.arange(n)
        for level in range(self.depth):
            bounds = self._bounds(level)
            for low, high in zip(bounds, bounds[1:]):
                own = self.order[low:high]
                x = seen[own]
                far = x[((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                other = x[((x - far) ** 2).sum(axis=1).argmax()]
                self.order[low:high] = own[np.argsort(x @ (far - other), kind="stable")]
        self.rows = rows[self.order]
        self.leaves = self._bounds(self.depth)
        self.nodes = [np.maximum.reduceat(self.rows, self.leaves[:-1], axis=0)]
        for _ in range(self.depth):
            self.nodes.insert(0, np.maximum(self.nodes[0][0::2], self.nodes[0][1::2]))

    def _bounds(self, level: int) -> list[int]:
        return [i * len(self.order) >> level for i in range((1 << level) + 1)]


class ItemTree:
    """Items of one tree, their columns, and what is known of their results."""

    def __init__(self, numbers: list[int], items: Items, weights: np.ndarray, floors: np.ndarray, k: int):
        self.columns = np.unique(np.concatenate([items.terms[i] for i in numbers]))
        matrix = np.zeros((len(numbers), len(self.columns)))
        for row, i in enumerate(numbers):
            at = np.searchsorted(self.columns, items.terms[i])
            matrix[row, at] = weights[items.terms[i]]
        self.tree = Tree(matrix, ITEM_LEAF)
        self.numbers = np.array(numbers)[self.tree.order]
        self.own = [(np.flatnonzero(x), x[np.flatnonzero(x)].astype(np.int64)) for x in self.tree.rows]
        self.used = [[np.flatnonzero(x) for x in level] for level in self.tree.nodes]
        self.k = k
        #: For each item the least score that can still be among its results.
        self.least = np.maximum(floors[self.numbers], 1)
        self.found = [np.zeros((0, 2), dtype=np.int64) for _ in numbers]  # (score, doc_id)

    def search(self, ids: np.ndarray, docs: Tree) -> int:
        """Take up the results among ``docs``, whose ids are in the tree's order; gives the number of scores computed."""
        tree, scored = self.tree, 0
        pairs = {0: np.zeros(1, dtype=np.int64)}  # item node: document nodes
        at_item = at_doc = 0
        while True:
            weakest = np.minimum.reduceat(self.least, tree._bounds(at_item)[:-1])
            for node in list(pairs):
                used = self.used[at_item][node]
                # (1 + 1e-9): the bound is a sum of doubles, the scores are exact
                bound = docs.nodes[at_doc][pairs[node]][:, used] @ tree.nodes[at_item][node][used] * (1 + 1e-9)
                pairs[node] = pairs[node][bound >= weakest[node]]
            if at_item == tree.depth and at_doc == docs.depth:
                break
            if at_doc < docs.depth:
                pairs = {i: np.concatenate([2 * d, 2 * d + 1]) for i, d in pairs.items()}
                at_doc += 1
            if at_item < tree.depth:
                pairs = {j: d for i, d in pairs.items() for j in (2 * i, 2 * i + 1)}
                at_item += 1
        for node, leaves in pairs.items():
            if len(leaves):
                for item in range(tree.leaves[node], tree.leaves[node + 1]):
                    scored += self._leaves(item, leaves, ids, docs)
        return scored

    def _leaves(self, item: int, leaves: np.ndarray, ids: np.ndarray, docs: Tree) -> int:
        columns, weights = self.own[item]
        bound = docs.nodes[-1][leaves][:, columns].astype(np.int64) @ weights
        order = np.argsort(-bound, kind="stable")
        scored = 0
        for at in range(0, len(order), LEAVES_AT_ONCE):
            some = order[at:at + LEAVES_AT_ONCE]
            some = some[bound[some] >= self.least[item]]
            if not len(some):
                break
            rows = np.concatenate([np.arange(docs.leaves[x], docs.leaves[x + 1]) for x in leaves[some].tolist()])
            scores = docs.rows[rows[:, None], columns].astype(np.int64) @ weights
            scored += len(rows)
            good = scores >= self.least[item]
            if good.any():
                held = np.concatenate([self.found[item], np.column_stack([scores[good], ids[rows[good]]])])
                self.found[item] = held = held[np.lexsort((held[:, 1], -held[:, 0]))[:self.k]]
                if len(held) == self.k:
                    self.least[item] = max(self.least[item], held[-1, 0])
        return scored


class Search:
    """All items of a block, in trees of a bounded number of terms."""

    def __init__(self, items: Items, corpus: Corpus, floors: np.ndarray, k: int):
        self.corpus, self.trees = corpus, []
        held: list[int] = []
        known: set[int] = set()
        for i, own in enumerate(items.terms):
            if held and len(known | set(own.tolist())) > TREE_TERMS:
                self.trees.append(ItemTree(held, items, corpus.weights, floors, k))
                held, known = [], set()
            if len(own):
                held.append(i)
                known |= set(own.tolist())
        if held:
            self.trees.append(ItemTree(held, items, corpus.weights, floors, k))

    def add(self, batch: pa.RecordBatch) -> int:
        """Search the documents of a batch of ``counted``; gives the number of scores computed."""
        ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        row, term, tf = pairs_of(batch.column(2))
        value = self.corpus.saturated(batch.column(1).to_pylist(), row, tf)
        scored = 0
        for items in self.trees:
            place = np.searchsorted(items.columns, term)
            mine = np.flatnonzero(items.columns[np.minimum(place, len(items.columns) - 1)] == term)
            with_terms, at = np.unique(row[mine], return_inverse=True)
            step = max(1, min(TREE_ROWS, TREE_CELLS // len(items.columns)))
            for low in range(0, len(with_terms), step):
                here = (at >= low) & (at < low + step)
                matrix = np.zeros((min(step, len(with_terms) - low), len(items.columns)), dtype=np.float32)
                matrix[at[here] - low, place[mine[here]]] = value[mine[here]]  # below 2^24: exact
                docs = Tree(matrix, DOC_LEAF)
                scored += items.search(ids[with_terms[low:low + step]][docs.order], docs)
        return scored

    def results(self) -> np.ndarray:
        """(item number, score, doc_id)"""
        parts = [np.column_stack([np.full(len(x), i), x]) for t in self.trees for i, x in zip(t.numbers, t.found, strict=True)]
        return np.concatenate(parts) if parts else np.zeros((0, 3), dtype=np.int64)


def local_results(found: DataFrame, items: Items, corpus: Corpus, floors: np.ndarray, k: int) -> DataFrame:
    """(item, score, doc_id, task): the k best of each task, as far as they reach the floors."""
    shared = found.sparkSession.sparkContext.broadcast((items.terms, corpus, floors))  # a block of items

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Items([])
        block.terms, figures, least = shared.value
        search = Search(block, figures, least, k)
        for batch in row_slices(batches, TREE_ROWS):
            search.add(batch)
        out = search.results()
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 2], mask=out[:, 2] == NO_ID)], ["item", "score", "doc_id"])

    return found.mapInArrow(run, "item long, score long, doc_id long").withColumn("task", F.spark_partition_id())


def ranked(local: DataFrame, k: int, *groups: str) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def merged(local: DataFrame, k: int) -> DataFrame:
    """The k best of each item, with ranks; tasks are merged in groups first."""
    grouped = local.withColumn("merge_group", F.col("task") % MERGE_GROUPS)
    return ranked(ranked(grouped, k, "item", "merge_group").drop("rank"), k, "item")


def search(docs: DataFrame, items: DataFrame, k: int = TOP_K, id_col: str = "doc_id", text_col: str = "text",
           item_id_col: str = "item_id", item_text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """For each item the k documents of highest score above 0, with ranks from 1."""
    spark = docs.sparkSession
    parts = []
    for block in item_blocks(items, item_id_col, item_text_col):
        found = stored(counted(docs, block, id_col, text_col), "term-counts")
        corpus = Corpus(found, len(block.vocabulary))
        with_terms = found.filter(F.length("terms") > 0)
        floors = np.zeros(len(block.ids), dtype=np.int64)
        if corpus.documents > sample_rows:
            share = sample_rows / corpus.documents
            sample = with_terms.filter(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
            for r in merged(local_results(sample, block, corpus, floors, k), k).filter(F.col("rank") == k).collect():  # a row an item
                floors[r["item"]] = r["score"]
        names = spark.createDataFrame(list(enumerate(block.ids)), "item long, item_id long")
        best = merged(local_results(with_terms, block, corpus, floors, k), k)
        parts.append(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT)


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS words
  FROM documents),
items AS (
  SELECT row_number() OVER () AS item, item_id,
         list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS words
  FROM benchmark),
asked AS (SELECT item, item_id, unnest(words) AS term FROM items),
total AS (SELECT count(*) FILTER (len(words) > 0) AS n, sum(len(words))::BIGINT AS l FROM docs),
counts AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(words) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, total GROUP BY term),
sizes AS (SELECT row, doc_id, 100 - 50 + (50 * len(words) * n) // l AS m FROM docs, total),
scores AS (
  SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM asked JOIN counts USING (term) JOIN weights USING (term) JOIN sizes USING (row)
  GROUP BY item, item_id, row, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM scores WHERE score > 0)
WHERE rank <= {TOP_K}
"""
