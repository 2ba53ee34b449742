"""Inverted indexes for record and name searches (FLT5, FLT8).

Posting lists: for each term the sorted numbers of the rows that hold it, cut into ranges of row numbers. A list
is one row for each range (or a few, see ``listed``), so the list of a term that a third of all rows hold is many bounded rows. Lists lie in
folders by a hash of the term (``bucket=``), sorted by term: a search reads the folders of its own terms.

``SubstringIndex`` finds the strings that contain a term: 3-grams of each string (padded at the end, so that a gram starts
at each character), lists intersected range by range from the shortest, then an exact check of the few strings left.
A term of one or two characters is a range of grams. Strings are not scanned.

``TextIndex`` finds records by keyword, author or title. A word of a query matches a record if some white-space token of
the searched fields contains it, so the dictionary of tokens is a ``SubstringIndex``, and the lists of the tokens found for one word
are united; the words' lists are intersected range by range from the shortest. Results equal those of
``operators.search.search``, which scans the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholarq.functions.text import explode_rows
from scholarq.operators.search import SEARCH_TYPES, author_match, author_relevance, keyword_match, pdf_url, title_match

#: Row numbers of one range: the most numbers in a row of a list.
RANGE_ROWS = 1 << 14
#: Tokens whose lists a task makes at once, and rows that are added at once.
LIST_TOKENS, LIST_STEP = 1 << 20, 64
#: Ranges (on average) whose rows lie in the same file of a bucket, and row ranges in one folder of the indexed rows.
RANGES_A_FILE, RANGES_A_FOLDER = 256, 4
BUCKETS = 64
GRAM = 3
#: Not a character of any text; ends a string so that its last characters start grams, too.
PAD = "\uffff"
#: Tokens of a query up to which their lists are picked by literals, so that folders are pruned when the query is planned.
MOST_LITERALS = 1000


def write_rows(df: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Number the rows (``no``: unique, neighbouring in a task) and store them, once, in folders of neighbouring numbers."""
    folder = F.floor(F.col("no") / (range_rows * RANGES_A_FOLDER)).cast("long")
    (df.withColumn("no", F.monotonically_increasing_id()).withColumn("folder", folder).sortWithinPartitions("folder", "no")
     .write.partitionBy("folder").parquet(path))
    return df.sparkSession.read.parquet(path)


def listed(rows: DataFrame, prefixes: dict[str, str], range_rows: int = RANGE_ROWS) -> DataFrame:
    """(term, range, n, numbers) of rows in the order of their ``no``: ``prefixes`` names columns of tokens and what stands before these
    in a term.  The rows of a range lie together, so its lists are made where they are read; a range of more than
    ``LIST_TOKENS`` tokens has several rows for a term, of different numbers.  Empty tokens are left out."""
    def lists(first: int, nos: list[np.ndarray], held: list[list[pa.Array]]) -> pa.RecordBatch:
        owner, terms, keys, known = np.concatenate(nos) - first, [], [], 0
        for prefix, arrays in zip(prefixes.values(), zip(*held, strict=True), strict=True):
            tokens = pa.chunked_array([x.flatten() for x in arrays]).combine_chunks().dictionary_encode()
            sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in arrays])
            keys.append((tokens.indices.to_numpy().astype(np.int64) + known) * range_rows + np.repeat(owner, sizes))
            terms.append(pc.if_else(pc.equal(tokens.dictionary, ""), None, pc.binary_join_element_wise(pa.scalar(prefix), tokens.dictionary, "")))
            known += len(tokens.dictionary)
        pairs = np.sort(np.concatenate(keys))  # by term, then by number
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        codes = pairs // range_rows
        ends = np.append(np.flatnonzero(np.diff(codes)) + 1, len(codes)) if len(codes) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        out = pa.RecordBatch.from_arrays(
            [pa.concat_arrays(terms), pa.array(np.full(known, first // range_rows)), pa.array(np.diff(offsets.to_numpy())),
             pa.ListArray.from_arrays(offsets, pa.array(pairs % range_rows + first))], ["term", "range", "n", "numbers"])
        return out.filter(pc.is_valid(out.column(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, nos, held = None, 0, [], []
        for batch in batches:
            no = batch.column(0).to_numpy()
            ranges = no // range_rows
            cuts = np.union1d(np.flatnonzero(np.diff(ranges)) + 1, np.arange(0, len(no), LIST_STEP))
            for start, end in zip(cuts, np.append(cuts[1:], len(no)), strict=True):
                if held and (ranges[start] != at or size >= LIST_TOKENS):
                    yield lists(int(at) * range_rows, nos, held)
                    size, nos, held = 0, [], []
                at = ranges[start]
                nos.append(no[start:end])
                held.append([batch.column(i).slice(start, end - start) for i in range(1, batch.num_columns)])
                size += sum(len(x.flatten()) for x in held[-1])
        if held:
            yield lists(int(at) * range_rows, nos, held)

    return rows.select("no", *prefixes).mapInArrow(run, "term string, range long, n int, numbers array<long>")


def write_lists(rows: DataFrame, prefixes: dict[str, str], bucket: Column, path: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Store the lists of ``rows``: (bucket, term, range, n, numbers)."""
    files = max(1, -(-rows.count() // (range_rows * RANGES_A_FILE)))  # of a bucket
    lists = listed(rows, prefixes, range_rows).withColumn("bucket", bucket)
    (lists.repartition("bucket", F.pmod(F.hash("range"), F.lit(files))).sortWithinPartitions("bucket", "term", "range")
     .write.partitionBy("bucket").parquet(path))
    return rows.sparkSession.read.parquet(path)


def intersected(lists: DataFrame, groups: int) -> DataFrame:
    """Rows that stand in a list of each of ``groups`` groups: (range, group, numbers) -> (folder, no).

    Ranges that some group lacks are dropped; in the others the lists are intersected from the shortest on.
    """
    by_group = lists.groupBy("range", "group").agg(F.array_distinct(F.flatten(F.collect_list("numbers"))).alias("numbers"))
    whole = (by_group.groupBy("range")
             .agg(F.sort_array(F.collect_list(F.struct(F.size("numbers").alias("n"), F.col("group"), F.col("numbers")))).alias("held"))
             .filter(F.size("held") == groups))
    common = F.aggregate(F.slice("held", 2, max(1, groups - 1)), F.col("held")[0]["numbers"],
                         lambda a, x: F.array_intersect(a, x["numbers"]))
    folder = F.floor(F.col("range") / RANGES_A_FOLDER).cast("long").alias("folder")
    return explode_rows(whole.select(folder, common.alias("found")), ["folder"], F.col("found"), "no")


class SubstringIndex:
    """Strings by the substrings they contain (without regard to case)."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = spark.read.parquet(f"{path}/rows")
        self.lists = spark.read.parquet(f"{path}/grams")

    @classmethod
    def build(cls, strings: DataFrame, text_col: str, path: str, range_rows: int = RANGE_ROWS) -> SubstringIndex:
        """Index the rows of ``strings`` by one of their columns; the other columns are kept beside it."""
        rows = write_rows(strings.withColumn("lowered", F.lower(text_col)), f"{path}/rows", range_rows)
        padded = F.concat("lowered", F.lit(PAD * (GRAM - 1)))
        grams = F.transform(F.sequence(F.lit(1), F.length("lowered")), lambda i: F.substring(padded, i, F.lit(GRAM)))
        write_lists(rows.filter(F.length("lowered") > 0).select("no", grams.alias("grams")), {"grams": ""},
                    cls._bucket(F.col("term")), f"{path}/grams", range_rows)
        return cls(strings.sparkSession, path)

    @staticmethod
    def _bucket(gram: Column) -> Column:
        """By the first character, so that grams with a common prefix share a folder."""
        return F.pmod(F.ascii(gram), F.lit(BUCKETS))

    def grams_of(self, term: str) -> DataFrame:
        """The lists that a search for ``term`` reads."""
        if len(term) < GRAM:
            return self.lists.filter((F.col("bucket") == ord(term[0]) % BUCKETS) & F.col("term").startswith(term)).withColumn("group", F.lit(term))
        grams = sorted({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)})
        return (self.lists.filter(F.col("bucket").isin(sorted({ord(g[0]) % BUCKETS for g in grams})) & F.col("term").isin(grams))
                .withColumn("group", F.col("term")))

    def containing(self, term: str) -> DataFrame:
        """The indexed rows whose string contains ``term``; an empty term is in all strings."""
        term = term.lower()
        if not term:
            return self.rows.filter(F.col("lowered").isNotNull()).drop("lowered", "folder", "no")
        n = len({term[i:i + GRAM] for i in range(len(term) - GRAM + 1)}) or 1
        hits = intersected(self.grams_of(term).select("range", "group", "numbers"), n)
        return fetched(self.rows, hits).filter(F.instr("lowered", term) > 0).drop("lowered", "no")


def fetched(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """The stored rows that ``hits`` (folder, no) names; folders without a hit are pruned when the join runs."""
    return rows.join(hits, ["folder", "no"], "left_semi").drop("folder")


class TextIndex:
    """Records by keyword, author and title."""

    def __init__(self, spark: SparkSession, path: str):
        self.records = spark.read.parquet(f"{path}/records")
        self.terms = SubstringIndex(spark, f"{path}/terms")
        self.lists = spark.read.parquet(f"{path}/lists")

    @classmethod
    def build(cls, records: DataFrame, path: str, range_rows: int = RANGE_ROWS) -> TextIndex:
        """Index ``records`` (arxiv_id, title, abstract, authors, categories, ...)."""
        stored = write_rows(records, f"{path}/records", range_rows)
        texts = {"title": F.col("title"), "abstract": F.col("abstract"), "author": F.array_join("authors", " "), "category": F.col("categories")}
        tokens = stored.select("no", *[F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+").alias(f) for f, c in texts.items()])
        lists = write_lists(tokens, {f: f"{f}:" for f in texts}, cls._bucket(F.col("term")), f"{path}/lists", range_rows)
        known = (lists.groupBy("term").agg(F.sum("n").alias("n_records"))
                 .select(F.substring_index("term", ":", 1).alias("field"), "term", "n_records",
                         F.expr("substring(term, instr(term, ':') + 1)").alias("token")))
        SubstringIndex.build(known, "token", f"{path}/terms", range_rows)
        return cls(records.sparkSession, path)

    @staticmethod
    def _bucket(term: Column) -> Column:
        return F.pmod(F.crc32(term.cast("binary")), F.lit(BUCKETS)).cast("int")

    def matched_terms(self, words: list[str], search_type: str) -> DataFrame:
        """(term, group): the indexed terms that contain each word, in the fields of the search."""
        parts = [self.terms.containing(w).withColumn("group", F.lit(i)) for i, w in enumerate(words)]
        found = reduce(DataFrame.unionByName, parts)
        if search_type != "keyword":
            found = found.filter(F.col("field") == search_type)
        return found.select("term", "group", self._bucket(F.col("term")).alias("bucket"))

    def lists_of(self, words: list[str], search_type: str) -> DataFrame:
        """The lists that a search reads, with the word that they answer."""
        terms = self.matched_terms(words, search_type)
        few = terms.limit(MOST_LITERALS + 1).collect()
        if len(few) > MOST_LITERALS:  # the same lists by a join
            return self.lists.join(terms.drop("bucket"), "term").select("range", "group", "numbers")
        own = self.lists.filter(F.col("bucket").isin(sorted({r["bucket"] for r in few})) & F.col("term").isin(sorted({r["term"] for r in few})))
        named = self.lists.sparkSession.createDataFrame([(r["term"], r["group"]) for r in few], "term string, group int")
        return own.join(F.broadcast(named), "term").select("range", "group", "numbers")  # at most MOST_LITERALS rows

    def search(self, q: str, search_type: str = "keyword") -> DataFrame:
        """As ``operators.search.search``: the matching records with relevance and pdf link, not yet paged."""
        if search_type not in SEARCH_TYPES:
            raise ValueError(f"search_type must be one of {SEARCH_TYPES}")
        words = sorted(set(q.lower().split()))
        if words:
            hits = intersected(self.lists_of(words, search_type), len(words))
            found = fetched(self.records, hits).drop("no")
        else:  # nothing to look up
            found = self.records.drop("folder", "no")
        # an author or title phrase holds more than its words; a keyword match is nothing but them
        exact = {"author": author_match, "title": title_match, "keyword": keyword_match}[search_type](q)
        found = found if search_type == "keyword" and words else found.filter(exact)
        rel = author_relevance(q) if search_type == "author" else F.lit(1.0)
        return found.withColumn("relevance_score", rel).withColumn("pdf_url", pdf_url(F.col("arxiv_id")))
