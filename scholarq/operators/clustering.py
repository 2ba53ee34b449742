"""KMeans + PCA clustering of papers (CL5, CL6, CL8, AGG13).

The TF-IDF vectors are built JVM-side: a CountVectorizerModel over the
vocabulary (collected once; its size is capped by ``max_features``)
gives term counts, a Summarizer over them the document frequencies, an ElementwiseProduct
applies the smoothed idf and a Normalizer the L2 norm -- the same weights as ``tfidf.tfidf``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholarq.functions.stopwords import ENGLISH_STOP_WORDS
from scholarq.operators.ids import sequential_ids
from scholarq.operators.tfidf import (MAX_FEATURES, TOP_TERMS, assemble_text, kept_tokens, terms_of,
                                      top_terms_by_threshold)
from scholarq.session import cut_lineage, removed, written

DEFAULT_K = 5
SEED = 42


def tfidf_vectors(counts: DataFrame, n: int, df: list[float]) -> DataFrame:
    """``features``: sparse L2-normalised TF-IDF vectors from vectors of counts (``_tf``) of n documents, with the
    number of documents of each term."""
    idf = [math.log((1 + n) / (1 + x)) + 1 for x in df]
    ep = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf")
    nz = Normalizer(p=2.0, inputCol="_tfidf", outputCol="features")
    return nz.transform(ep.transform(counts)).drop("_tf", "_tfidf")


def centroid_terms(labelled: DataFrame, terms: list[str], top_n: int) -> DataFrame:
    """CL7 + AGG14: the terms of largest mean weight of each cluster: (cluster, rank, term, weight)."""
    means = labelled.groupBy("cluster").agg(Summarizer.mean(F.col("features")).alias("m")).collect()  # a vector a cluster
    rows = []
    for r in means:
        best = sorted((-w, terms[i]) for i, w in enumerate(r["m"].toArray().tolist()) if w > 0)[:top_n]
        rows += [(r["cluster"], i, t, -w) for i, (w, t) in enumerate(best, 1)]
    return labelled.sparkSession.createDataFrame(rows, "cluster int, rank long, term string, weight double")


@dataclass
class Clustering:
    """A fitted clustering.  The frames are cut from their lineage, so they can
    be read many times without fitting again."""

    members: DataFrame             # (cluster, id, title, x, y)
    terms: DataFrame               # (cluster, rank, term, weight)
    vectors: DataFrame             # (id, features)
    centres: list[list[float]]     # k x features
    components: list[list[float]]  # 2 x features


def fit_clusters(papers: DataFrame, id_col: str = "paper_id", title_col: str = "title",
                 abstract_col: str = "abstract", k: int = DEFAULT_K, stop_words=ENGLISH_STOP_WORDS,
                 max_features: int = MAX_FEATURES, seed: int = SEED, top_n: int = TOP_TERMS) -> Clustering:
    """CL8: k is capped at the number of papers; an empty vocabulary gives
    empty results.

    The corpus is tokenised once: its tokens are written with the titles, the vocabulary and the vectors of counts
    derive from them, and all else -- document frequencies, weights, centres, key terms, coordinates -- from the
    vectors, without a join or a shuffle of documents."""
    spark = papers.sparkSession
    text = assemble_text(F.col(title_col), F.col(abstract_col))
    kept, tokens = written(papers.select(F.col(id_col), F.col(title_col).alias("title"), kept_tokens(text, stop_words).alias("kept")), "tokens")
    terms = [r["term"] for r in top_terms_by_threshold(kept, max_features).sort("term").collect()]  # at most max_features
    if not terms:
        id_type = dict(papers.dtypes)[id_col]
        return Clustering(
            spark.createDataFrame([], f"cluster int, {id_col} {id_type}, title string, x double, y double"),
            spark.createDataFrame([], "cluster int, rank long, term string, weight double"),
            papers.select(id_col).limit(0), [], [])
    cv = CountVectorizerModel.from_vocabulary(terms, inputCol="_terms", outputCol="_tf")
    counts = cut_lineage(cv.transform(kept.withColumn("_terms", terms_of(F.col("kept")))).select(id_col, "title", "_tf"))
    removed(spark, tokens)
    met = counts.agg(Summarizer.metrics("count", "numNonZeros").summary(F.col("_tf")).alias("s")).first()["s"]
    n = met["count"]
    vec = cut_lineage(tfidf_vectors(counts, n, met["numNonZeros"].toArray().tolist()))
    km = KMeans(k=max(1, min(k, n)), seed=seed, featuresCol="features", predictionCol="cluster").fit(vec)
    labelled = km.transform(vec)
    components = principal_components(vec, n, len(terms), min(2, len(terms)))
    return Clustering(cut_lineage(placed(labelled, id_col, components)), centroid_terms(labelled, terms, top_n), vec.select(id_col, "features"),
                      [c.tolist() for c in km.clusterCenters()], components.tolist())


def principal_components(vec: DataFrame, n: int, features: int, k: int) -> np.ndarray:
    """CL6: k x features.  The products of each vector's own numbers are summed in a tree and centred afterwards
    (``computeCovariance`` centres every vector, which makes it dense, if the first one it meets is dense); the covariance has
    max_features squared numbers, whose largest eigenvectors are taken directly (a full decomposition on one JVM thread takes far longer)."""
    covariance = np.eye(features)
    if n > 1:
        rows = MLUtils.convertVectorColumnsFromML(vec.select("features"), "features")
        mean = vec.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
        covariance = (RowMatrix(rows, n, features).computeGramianMatrix().toArray() - n * np.outer(mean, mean)) / (n - 1)
    values, vectors = np.linalg.eigh(covariance)
    return vectors[:, np.argsort(-values, kind="stable")[:k]].T


def dots(features: pa.StructArray, axes: np.ndarray) -> np.ndarray:
    """The products of vectors, as Arrow holds them, with the rows of ``axes``: only what is not zero is read."""
    values, indices = features.field("values"), features.field("indices")
    sizes = np.diff(values.offsets.to_numpy())
    row, v = np.repeat(np.arange(len(sizes)), sizes), values.flatten().to_numpy()
    if indices.null_count:  # some vectors are dense
        at = np.concatenate([np.arange(n) if i is None else np.array(i, dtype=np.int64)
                             for i, n in zip(indices.to_pylist(), sizes, strict=True)] or [np.zeros(0, dtype=np.int64)])
    else:
        at = indices.flatten().to_numpy()
    return np.stack([np.bincount(row, weights=v * a[at], minlength=len(sizes)) for a in axes], axis=1)


def squared_distances(vectors: DataFrame, id_col: str, centres: list[list[float]]) -> DataFrame:
    """(id, dist): the squared distances of each vector from the centres."""
    c = np.array(centres)
    squares = (c * c).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).field("values")
            sizes, v = np.diff(values.offsets.to_numpy()), values.flatten().to_numpy()
            own = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=v * v, minlength=len(sizes))
            dist = np.maximum(own[:, None] - 2 * dots(batch.column(1), c) + squares, 0.0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * len(c), pa.int32()), pa.array(dist.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "dist"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, "features").mapInArrow(run, f"id {kind}, dist array<double>").withColumnRenamed("id", id_col)


def placed(labelled: DataFrame, id_col: str, components: np.ndarray) -> DataFrame:
    """(cluster, id, title, x, y): coordinates along the components, 0 in the mean."""
    axes = np.vstack([components, np.zeros((2 - len(components), components.shape[1]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = dots(batch.column(3), axes)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(at[:, 0]), pa.array(at[:, 1])], ["cluster", "id", "title", "x", "y"])

    kind = labelled.schema[id_col].dataType.simpleString()
    points = labelled.select("cluster", F.col(id_col).alias("id"), "title", "features").mapInArrow(
        run, f"cluster int, id {kind}, title string, x double, y double")
    mean = points.agg(F.avg("x").alias("_x"), F.avg("y").alias("_y"))  # one row
    return points.crossJoin(F.broadcast(mean)).select(
        "cluster", F.col("id").alias(id_col), "title", (F.col("x") - F.col("_x")).alias("x"), (F.col("y") - F.col("_y")).alias("y"))


def cluster_papers(papers: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """CL8: (members (cluster, id, title, x, y), terms (cluster, rank, term, weight))."""
    fit = fit_clusters(papers, *args, **options)
    return fit.members, fit.terms


def ranked_members(members: DataFrame, id_col: str = "paper_id") -> DataFrame:
    """AGG13 as flat rows (cluster, rank, id, title, x, y), ranked by id in
    each cluster.  Ranks come from one range sort, so a cluster of any size
    is spread over many tasks."""
    numbered = sequential_ids(members, ["cluster", id_col], 0, "_at")
    first = numbered.groupBy("cluster").agg(F.min("_at").alias("_first"))  # one row for each cluster
    return numbered.join(first, "cluster").select("cluster", (F.col("_at") - F.col("_first") + 1).alias("rank"),
                                                  id_col, "title", "x", "y")


def cluster_sizes(members: DataFrame) -> DataFrame:
    """Members per cluster (partial aggregation; any scale)."""
    return members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_papers"))


def union_for_clustering(local: DataFrame, texts: DataFrame, remote: DataFrame) -> DataFrame:
    """SET3: local papers (paper_id, paper_name) with their document text and
    remote records (arxiv_id, title, abstract) as one (paper_id, title, abstract)."""
    own = (local.join(texts.select("paper_id", "text"), "paper_id", "left")
           .select(F.col("paper_id").cast("string").alias("paper_id"), F.col("paper_name").alias("title"),
                   F.coalesce("text", F.lit("")).alias("abstract")))
    return own.unionByName(remote.select(F.col("arxiv_id").alias("paper_id"), "title",
                                         F.coalesce("abstract", F.lit("")).alias("abstract")))
