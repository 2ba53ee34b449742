"""TF-IDF in long form (CL1-4) and key terms per cluster (CL7, AGG14).

Terms: lower-cased word tokens of >= 2 characters, stop words removed,
then 1- and 2-grams of the remaining tokens.  Vocabulary: the
``max_features`` terms with the highest corpus frequency (ties by term).
Weight: tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised per document
(smoothed idf; MLlib's IDF omits the "+1", so it is not used here).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholarq.functions.stopwords import ENGLISH_STOP_WORDS
from scholarq.functions.text import WORD2, explode_rows, tokens
from scholarq.session import cut_lineage, removed, written

MAX_FEATURES = 1000
TOP_TERMS = 5
#: Tokens that a task counts at once, as a run, and documents that are added to a run at once.
RUN_TOKENS, RUN_STEP = 1 << 18, 16
#: Terms that are broadcast to count them exactly; more are joined by a shuffle.
FEW_TERMS = 100_000


def assemble_text(title: Column, abstract: Column) -> Column:
    """CL1: title + ' ' + abstract (missing parts as empty strings)."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit("")))


def kept_tokens(text: Column, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """The tokens of a text without stop words, in order."""
    stop = sorted(set(stop_words))  # ``isin`` looks up a hash set, ``array_contains`` scans
    return F.filter(tokens(text, WORD2), lambda t: ~t.isin(*stop))


def terms_of(kept: Column) -> Column:
    """CL2: unigrams + bigrams of kept tokens."""
    bigrams = F.filter(F.zip_with(kept, F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))),
                                  lambda a, b: F.concat(a, F.lit(" "), b)),
                       lambda x: x.isNotNull())
    return F.concat(kept, bigrams)


def with_terms(df: DataFrame, text_col: str, stop_words=ENGLISH_STOP_WORDS, out_col: str = "terms") -> DataFrame:
    """CL2: add ``out_col`` = unigrams + bigrams (after stop-word removal)."""
    kept = df.withColumn("_kept", kept_tokens(F.col(text_col), stop_words))
    return kept.withColumn(out_col, terms_of(F.col("_kept"))).drop("_kept")


def by_document(docs: DataFrame, id_col: str) -> DataFrame:
    """Hash-partition the corpus by document id, once: for operators whose
    exploded rows are summed or ordered per document, this moves the text
    instead of the (larger) rows, and later steps need no exchange."""
    return docs.repartition(F.col(id_col))


def term_rows(terms: DataFrame, id_col: str, terms_col: str = "terms") -> DataFrame:
    """(id, term), one row per occurrence, from a per-document term array."""
    return explode_rows(terms, [id_col], F.col(terms_col), "term")


def top_terms(rows: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """(term, cf) of the ``max_features`` most frequent terms.  Occurrences are
    counted per task first, so a frequent term crosses the shuffle once per
    task, and no (document, term) pair does.  The result, bounded by
    ``max_features``, is checkpointed: what follows reads it more than once."""
    counts = rows.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))
    return cut_lineage(counts.orderBy(F.desc("cf"), F.asc("term")).limit(max_features))


def counted_in_runs(kept: DataFrame, k: int, kept_col: str = "kept") -> DataFrame:
    """(run, term, n, top): exact counts of the terms of each run -- the documents of a task, or of a part of them
    with at least ``RUN_TOKENS`` tokens.  ``top`` marks k terms of a run that none of its others exceeds."""
    def counted(name: int, lists: list[pa.Array]) -> pa.RecordBatch:
        tokens = pa.chunked_array([x.flatten() for x in lists]).combine_chunks().dictionary_encode()
        words, codes = tokens.dictionary, tokens.indices.to_numpy().astype(np.int64)
        sizes = np.concatenate([np.diff(x.offsets.to_numpy()) for x in lists])
        follows = np.ones(len(codes), dtype=bool)  # the token before it is of the same document
        follows[np.cumsum(sizes)[sizes > 0] - sizes[sizes > 0]] = False
        pairs, n_pairs = np.unique(codes[:-1][follows[1:]] * len(words) + codes[1:][follows[1:]], return_counts=True)
        joined = pc.binary_join_element_wise(words.take(pa.array(pairs // len(words))), words.take(pa.array(pairs % len(words))), " ")
        n = np.concatenate([np.bincount(codes, minlength=len(words)), n_pairs])
        top = np.zeros(len(n), dtype=bool)
        top[np.argpartition(-n, k - 1)[:k] if len(n) > k else slice(None)] = True
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), name)), pa.concat_arrays([words, joined]), pa.array(n), pa.array(top)], ["run", "term", "n", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, RUN_STEP):
                held.append(batch.column(0).slice(at, RUN_STEP))
                size += len(held[-1].flatten())
                if size >= RUN_TOKENS:
                    yield counted(uuid.uuid4().int >> 65, held)
                    held, size = [], 0
        if size:
            yield counted(uuid.uuid4().int >> 65, held)

    return kept.select(kept_col).mapInArrow(run, "run long, term string, n long, top boolean")


def top_terms_by_threshold(kept: DataFrame, max_features: int = MAX_FEATURES, kept_col: str = "kept") -> DataFrame:
    """CL3, exactly as ``top_terms`` of all terms, without shuffling the terms of the corpus (a three-phase threshold search).

    1. Every run gives its own top list; the sums of those partial counts bound the last place from below.
    2. With m runs, a term of at least that count has a count of at least bound / m in some run: the rows
       at or above that are summed.  What a term can have besides is below bound / m in each run where it is missing, so most
       terms cannot reach the last place any more.
    3. The few others are counted exactly.

    Returns (term, cf), checkpointed; at most ``max_features`` rows.
    """
    spark = kept.sparkSession
    runs, path = written(counted_in_runs(kept, max_features, kept_col), "term-runs")
    sums = lambda rows: rows.groupBy("term").agg(F.sum("n").alias("cf"), F.count(F.lit(1)).alias("seen"))

    def last_place(partial: DataFrame) -> int:
        """The ``max_features``-th largest partial count: no term below it is in the result."""
        held = partial.orderBy(F.desc("cf")).limit(max_features).agg(F.min("cf").alias("low"), F.count(F.lit(1)).alias("n")).first()
        return held["low"] if held["n"] == max_features else 1

    m = runs.filter("top").select("run").distinct().count()
    least = max(1, -(-last_place(sums(runs.filter("top"))) // max(m, 1)))
    partial = cut_lineage(sums(runs.filter((F.col("n") >= least) | F.col("top"))))
    able = cut_lineage(partial.filter(F.col("cf") + (F.lit(m) - F.col("seen")) * (least - 1) >= last_place(partial)).select("term"))
    counts = runs.join(F.broadcast(able) if able.count() <= FEW_TERMS else able, "term").groupBy("term").agg(F.sum("n").alias("cf"))
    top = cut_lineage(counts.orderBy(F.desc("cf"), F.asc("term")).limit(max_features))
    removed(spark, path)
    return top


def vocabulary_counts(rows: DataFrame, top: DataFrame, id_col: str) -> DataFrame:
    """(id, term, tf) over the vocabulary: other terms leave before the count,
    so at most ``max_features`` rows per document are shuffled."""
    return (rows.join(F.broadcast(top.select("term")), "term")
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def vocabulary(top: DataFrame, dtc: DataFrame, n_docs: DataFrame) -> DataFrame:
    """CL3: (term, df, cf, idf); ``n_docs`` is a one-row frame with column
    ``n``.  At most ``max_features`` rows."""
    df = dtc.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (top.join(df, "term").crossJoin(F.broadcast(n_docs))
            .withColumn("idf", F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
            .select("term", "df", "cf", "idf"))


def weights_from_counts(dtc: DataFrame, vocab: DataFrame, id_col: str) -> DataFrame:
    """(id, term, weight): tf * idf over the vocabulary, L2-normalised per
    document.  The vocabulary is capped at max_features rows, so its
    broadcast is bounded."""
    w = dtc.join(F.broadcast(vocab.select("term", "idf")), "term").withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))


def tfidf(docs: DataFrame, id_col: str, text_col: str, stop_words=ENGLISH_STOP_WORDS,
          max_features: int = MAX_FEATURES) -> tuple[DataFrame, DataFrame]:
    """CL4: (weights (id, term, weight), vocabulary).  Texts are tokenised once; the tokens are written
    and read for the vocabulary and for the counts."""
    n_docs = docs.agg(F.count(F.lit(1)).alias("n"))
    kept, _ = written(docs.select(id_col, kept_tokens(F.col(text_col), stop_words).alias("kept")), "tokens")
    top = top_terms_by_threshold(kept.filter("kept IS NOT NULL"), max_features)
    dtc = vocabulary_counts(term_rows(kept.select(id_col, terms_of(F.col("kept")).alias("terms")), id_col), top, id_col)
    vocab = vocabulary(top, dtc, n_docs)
    return weights_from_counts(dtc, vocab, id_col), vocab


def cluster_terms(weights: DataFrame, labels: DataFrame, id_col: str, cluster_col: str = "cluster",
                  top_n: int = TOP_TERMS) -> DataFrame:
    """CL7 + AGG14: per cluster, the ``top_n`` terms of the centroid (mean
    weight over all the cluster's documents, zeros included); clusters
    without documents do not appear.  Output (cluster, rank, term, weight)."""
    sizes = labels.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_n"))
    sums = (weights.join(labels.select(id_col, cluster_col), id_col)
            .groupBy(cluster_col, "term").agg(F.sum("weight").alias("_s")))
    cent = sums.join(sizes, cluster_col).withColumn("weight", F.col("_s") / F.col("_n"))
    w = Window.partitionBy(cluster_col).orderBy(F.desc("weight"), F.asc("term"))
    return (cent.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_n)
            .select(cluster_col, F.col("rank").cast("long").alias("rank"), "term", "weight"))
