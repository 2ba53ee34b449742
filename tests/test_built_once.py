"""Inputs that a query needs several times are built once; vectors are not made dense."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from scholarq.operators import boundaries as B
from scholarq.operators import clustering as C
from scholarq.operators import merge as G
from scholarq.operators import metadata as M
from scholarq.operators import search as S
from scholarq.operators import tfidf as T
from scholarq.operators.delta import DeltaRuns
from scholarq.operators.maintained import MaintainedStatistics
from scholarq.plans import q_delta, q_merge, q_search, q_sources
from scholarq.plans.views import v_arxiv
from scholarq.session import written
from scholarq.sources import files as R

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _watched(monkeypatch, owner, name, arg):
    """The plans of a frame that a function gets, call by call."""
    seen, real = [], getattr(owner, name)

    def call(*args, **options):
        seen.append(_plan(args[arg]))
        return real(*args, **options)
    monkeypatch.setattr(owner, name, call)
    return seen


def test_batches_read_joined_mentions(spark, monkeypatch):
    seen = _watched(monkeypatch, DeltaRuns, "append", 2)
    q_delta.delta_runs_add(spark, SF)
    assert len(seen) == 6 and not any("Join" in p for p in seen)


def test_pages_read_built_records(spark, monkeypatch):
    seen = _watched(monkeypatch, S, "author_search_with_fallback", 0)
    q_search.author_fallback_pages(spark, SF)
    assert len(seen) == 3 and not any("Join" in p for p in seen)


@pytest.mark.parametrize("name", ["author_fallback", "author_fallback_ranked", "author_surname_first"])
def test_fallback_tiers_read_built_records(spark, monkeypatch, name):
    seen = _watched(monkeypatch, S, "author_search_with_fallback", 0)
    getattr(q_search, name)(spark, SF)
    assert len(seen) == 1 and "Join" not in seen[0]


def test_lines_are_dealt_out_before_they_are_listed(spark):
    plan = v_arxiv(spark, SF)._jdf.queryExecution().sparkPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in _plan(v_arxiv(spark, SF)) or "Exchange hashpartitioning(l_orderkey" in plan


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}


def test_written_frames_leave_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = _shuffle_files(spark), spark.conf.get(name, None)
    df, _ = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "freed")
    for _ in range(50):  # executors remove them by themselves
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left and spark.conf.get(name, None) == was
    assert df.agg(F.sum("count")).first()[0] == 1000


def test_sections_read_parsed_lines(spark, monkeypatch):
    seen = _watched(monkeypatch, M, "analyse", 0)
    q_sources.metadata_sections(spark, SF)
    assert len(seen) == 1 and "from_json" not in seen[0]


def test_sections_leave_no_snapshot(spark, monkeypatch):
    made, real = [], q_sources._snapshot
    monkeypatch.setattr(q_sources, "_snapshot", lambda *a: made.append(real(*a)) or made[-1])
    assert q_sources.metadata_sections(spark, SF).filter("section = 'basic_stats'").count() == 4
    assert len(made) == 1 and not R._exists(spark, made[0])


def test_preview_builds_the_shown_records_only(spark, monkeypatch):
    asked, real = [], q_sources.v_arxiv
    monkeypatch.setattr(q_sources, "v_arxiv", lambda spark, d, only=None: asked.append(only) or real(spark, d, only=only))
    assert q_sources.record_preview(spark, SF).first().asDict() == {"n_rows": 5, "known": True, "short": True}
    assert asked[0] is None and len(asked) == 2 and len(asked[1]) == 5


def test_links_read_written_names(spark, monkeypatch):
    seen = _watched(monkeypatch, G, "insert_or_ignore_links", 1)
    q_merge.insert_or_ignore_links(spark, SF)
    assert len(seen) == 1 and "Join" not in seen[0]


def test_first_words_are_counted_once(spark):
    docs = spark.createDataFrame([(i, "One. The two. The three, Dr. Lee. The end") for i in range(30)], "id long, text string")
    counts = B.word_counts(docs, "text")
    assert "Window" not in _plan(B.starters(counts, docs, "id", "text", B.abbreviations(counts)))


def test_last_word_is_read_from_the_end(spark):
    texts = ["He met e.g. a..b. xÉTÉ.\n\nZ. ! 3.1. .. ", "no mark", "ΟΔΟΣ. b"]
    rows = B.pieces(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").orderBy("id", "pos").collect()
    assert [r["last"] for r in rows] == ["e.g", "b", "xété", "z", "", "3.1", "", "", "οδος", ""]


def test_products_of_sparse_and_dense_vectors(spark):
    rows = [(1, Vectors.sparse(4, [1, 3], [0.5, 2.0])), (2, Vectors.dense([1.0, 0.0, -1.0, 3.0])), (3, Vectors.sparse(4, [], []))]
    whole = np.array([v.toArray() for _, v in rows])
    centres = [[1.0, 2.0, 3.0, 4.0], [0.0, 0.5, 0.0, 2.0], [0.0] * 4]
    df = spark.createDataFrame(rows, ["paper_id", "features"]).coalesce(1)
    found = {r.paper_id: r.dist for r in C.squared_distances(df, "paper_id", centres).collect()}
    expected = ((whole[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
    assert np.allclose([found[i] for i in (1, 2, 3)], expected)
    empty = pa.array([], pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))]))
    assert C.dots(empty, np.ones((2, 4))).shape == (0, 2)


def test_covariance_is_summed_over_sparse_products(spark, monkeypatch):
    def dense(self):
        raise AssertionError("every vector is made dense")
    monkeypatch.setattr(C.RowMatrix, "computeCovariance", dense)
    rng = np.random.default_rng(1)
    whole = np.vstack([rng.random((1, 6)), rng.random((40, 6)) * (rng.random((40, 6)) < 0.4) * [5, 3, 1, 1, 1, 1]])
    rows = [(Vectors.dense(whole[0].tolist()),)] + [(Vectors.sparse(6, [(i, float(x)) for i, x in enumerate(r) if x]),) for r in whole[1:]]
    vec = spark.createDataFrame(rows, ["features"]).coalesce(1)  # the first vector is dense
    values, vectors = np.linalg.eigh(np.cov(whole.T))
    expected = vectors[:, np.argsort(-values)[:2]].T
    assert np.allclose(np.abs((C.principal_components(vec, len(whole), 6, 2) * expected).sum(axis=1)), 1.0)


def test_exact_counts_are_the_same_joined_or_broadcast(spark, monkeypatch):
    kept = spark.createDataFrame([([f"w{i % 7}", f"w{i % 3}", f"x{i}"],) for i in range(60)], "kept array<string>")
    found = T.top_terms_by_threshold(kept, 5).orderBy("term").collect()
    monkeypatch.setattr(T, "FEW_TERMS", 0)
    assert len(found) == 5 and T.top_terms_by_threshold(kept, 5).orderBy("term").collect() == found


def test_snapshots_are_compressed_in_files_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(q_sources, "RECORDS_A_FILE", 100)
    path = q_sources._snapshot(spark, SF)
    lines = spark.read.text(path)
    sizes = [r["count"] for r in lines.groupBy("_metadata.file_name").count().collect()]
    assert all(f.endswith(".gz") for f in lines.inputFiles()) and max(sizes) <= 100
    assert sum(sizes) == lines.distinct().count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_statistics_read_built_records(spark, monkeypatch):
    seen = _watched(monkeypatch, MaintainedStatistics, "apply", 2)
    q_delta.maintained_statistics(spark, SF)
    assert len(seen) == 3 and not any("Join" in p for p in seen)


@pytest.mark.parametrize("add", [None, "n"])
def test_folds_deal_rows_out_once(spark, tmpdir_path, monkeypatch, add):
    store = DeltaRuns(spark, tmpdir_path, spark.createDataFrame([], "k string, n long").schema, ["k"], add=add, fanout=2, rows_per_file=4)
    store.append(1, spark.createDataFrame([("a", 1), (None, 2), ("b", 3), ("c", 4)], "k string, n long"))
    store.append(2, spark.createDataFrame([("a", 10), (None, 20), ("d", 40)], "k string, n long"))
    plans, real = [], DeltaRuns._merged

    def merged(self, rows):
        out = real(self, rows)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(DeltaRuns, "_merged", merged)
    assert store.compact() == 1 and plans[0].count("Exchange") == 1 and "rangepartitioning" in plans[0]
    want = {"a": 10, None: 20, "b": 3, "c": 4, "d": 40} if add is None else {"a": 11, None: 22, "b": 3, "c": 4, "d": 40}
    assert {r["k"]: r["n"] for r in store.read().collect()} == want and len(spark.read.parquet(store.runs()[0][3]).inputFiles()) == 2
