"""Delta runs and maintained statistics."""

import random

import pytest
from pyspark.sql import functions as F

from scholarq.operators import metadata as M
from scholarq.operators.delta import BATCH, DeltaRuns
from scholarq.operators.maintained import MaintainedStatistics

KV = "k string, v long"


def schema(spark, ddl):
    return spark.createDataFrame([], ddl).schema


def frame(spark, rows, ddl=KV):
    return spark.createDataFrame(rows, ddl)


def test_a_batch_writes_its_own_rows_only(spark, tmpdir_path):
    store = DeltaRuns(spark, f"{tmpdir_path}/t", schema(spark, KV), ["k"])
    store.append(1, spark.range(50_000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v")))
    before = {r[3]: spark.read.parquet(r[3]).inputFiles() for r in store.runs()}
    store.append(2, spark.range(49_500, 50_500).select(F.col("id").cast("string").alias("k"), (-F.col("id")).alias("v")))
    assert store.run(2).count() == 1000
    assert {p: spark.read.parquet(p).inputFiles() for p in before} == before
    got = store.read()
    assert got.count() == 50_500 and got.filter("v < 0").count() == 1000


def test_a_fold_is_sorted_in_bounded_parts(spark, tmpdir_path):
    store = DeltaRuns(spark, f"{tmpdir_path}/t", schema(spark, KV), ["k"], fanout=2)
    for batch, (a, b) in enumerate([(0, 300_000), (200_000, 600_000)], 1):
        store.append(batch, spark.range(a, b).select(F.col("id").cast("string").alias("k"), F.lit(batch).alias("v")))
    assert store.compact() == 1
    rows = spark.read.parquet(store.runs()[0][3])
    files = [r["count"] for r in rows.groupBy(F.input_file_name()).count().collect()]
    assert sum(files) == 600_000 and max(files) < 400_000
    assert store.read().groupBy("v").count().orderBy("v").collect() == [(1, 200_000), (2, 400_000)]


@pytest.mark.parametrize("add", [None, "v"])
def test_runs_equal_a_dictionary_with_folds_and_replays(spark, tmpdir_path, add):
    rnd = random.Random(3)
    store = DeltaRuns(spark, f"{tmpdir_path}/t", schema(spark, KV), ["k"], add=add, fanout=2, rows_per_file=5)
    want, folds = {}, 0
    for batch in range(1, 8):
        rows = {rnd.choice([None, "", "a", "b", "c", "d", "e", "f"]): rnd.randrange(-9, 9) for _ in range(5)}
        if batch == 4:
            rows = {}
        for k, v in rows.items():
            want[k] = want.get(k, 0) + v if add else v
        data = frame(spark, list(rows.items()))
        assert store.append(batch, data) is True
        assert store.append(batch, data) is False
        folds += store.compact()
        assert store.append(batch, data) is False  # also after it was folded
        assert {r["k"]: r["v"] for r in store.read().collect()} == want
    assert folds > 3
    levels = [level for _, _, level, _ in store.runs()]
    assert levels == sorted(set(levels), reverse=True)  # less than ``fanout`` runs of each level
    reopened = DeltaRuns(spark, f"{tmpdir_path}/t", schema(spark, KV), ["k"], add=add, fanout=2)
    assert {r["k"]: r["v"] for r in reopened.read().collect()} == want
    with pytest.raises(ValueError):
        # batches rise: an unknown number under the last one cannot be put in order
        DeltaRuns(spark, f"{tmpdir_path}/t", schema(spark, KV), ["k"], fanout=2).append(0, frame(spark, [("a", 1)]))


def test_rows_of_one_batch_and_extra_columns(spark, tmpdir_path):
    store = DeltaRuns(spark, f"{tmpdir_path}/t", schema(spark, KV), ["k"])
    rows = spark.createDataFrame([("a", 1, 5, "x"), ("a", 9, 2, "y"), ("b", 3, None, None)], "k string, v long, seq long, _batch string")
    store.append(1, rows, order_col="seq")
    assert {r["k"]: r["v"] for r in store.read().collect()} == {"a": 1, "b": 3}
    assert BATCH not in store.read().columns
    total = DeltaRuns(spark, f"{tmpdir_path}/s", schema(spark, KV), ["k"], add="v")
    total.append(1, rows)
    assert {r["k"]: r["v"] for r in total.read().collect()} == {"a": 10, "b": 3}


def test_an_unfinished_run_is_not_seen_and_is_written_again(spark, tmpdir_path):
    import os
    store = DeltaRuns(spark, f"{tmpdir_path}/t", schema(spark, KV), ["k"])
    assert store.read().count() == 0
    store.append(1, frame(spark, [("a", 1)]))
    frame(spark, [("z", 9)]).withColumn(BATCH, F.lit(2).cast("long")).write.parquet(f"{tmpdir_path}/t/r-2-2-0")
    os.rename(f"{tmpdir_path}/t/r-2-2-0/_SUCCESS", f"{tmpdir_path}/t/r-2-2-0/_unfinished")
    assert {r["k"] for r in store.read().collect()} == {"a"}
    assert store.append(2, frame(spark, [("b", 2)])) is True
    assert {r["k"]: r["v"] for r in store.read().collect()} == {"a": 1, "b": 2}


def test_a_key_lookup_is_pushed_into_the_runs(spark, tmpdir_path):
    store = DeltaRuns(spark, f"{tmpdir_path}/t", schema(spark, KV), ["k"])
    store.append(1, frame(spark, [("a", 1), ("b", 2)]))
    plan = store.read().filter("k = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan
    assert [tuple(r) for r in store.read(keys=frame(spark, [("b",), ("x",)], "k string")).collect()] == [("b", 2)]


RECORD = ("arxiv_id string, categories string, authors_parsed array<array<string>>, update_date string, "
          "versions array<struct<version:string>>, doi string, license string, journal_ref string, seq long")


def _record(rnd, key, seq):
    words = lambda n: [rnd.choice("pqrs") for _ in range(rnd.randrange(n))]
    return (key, rnd.choice([None, "", " ".join(words(4))]),
            rnd.choice([None, [[w, "x"] for w in words(4)] + [["alone"], ["q", None]]]),
            rnd.choice([None, "", "2001-02-03", "2002-13-01", "2003-4-5"]), rnd.choice([None, [("v1",)] * rnd.randrange(3)]),
            rnd.choice([None, "", "10.1"]), rnd.choice([None, "", "CC"]), rnd.choice([None, "", "J"]), seq)


def test_maintained_statistics_equal_a_fresh_computation(spark, tmpdir_path):
    rnd = random.Random(8)
    kept = MaintainedStatistics(spark, f"{tmpdir_path}/m", fanout=2)
    now = {}
    for batch in range(1, 6):
        rows = [] if batch == 3 else [_record(rnd, f"p{rnd.randrange(12)}", seq) for seq in range(8)]
        rows_and_keyless = rows + [_record(rnd, None, 99)]
        for r in rows:
            now[r[0]] = r
        for _ in range(2):  # each batch comes twice
            kept.apply(batch, spark.createDataFrame(rows_and_keyless, RECORD), order_col="seq")
    want = M.analyse(spark.createDataFrame(list(now.values()), RECORD))
    got = kept.analyse()
    assert set(got) == set(want)
    for name, df in want.items():
        assert [tuple(r) for r in got[name].collect()] == [tuple(r) for r in df.collect()], name


def test_a_batch_that_failed_halfway_is_completed(spark, tmpdir_path):
    rnd = random.Random(5)
    first, second = ([_record(rnd, f"p{i}", 0) for i in range(a, b)] for a, b in [(0, 6), (3, 9)])
    kept = MaintainedStatistics(spark, f"{tmpdir_path}/m")
    kept.apply(1, spark.createDataFrame(first, RECORD))
    from scholarq.operators.maintained import contributions
    kept.state.append(2, contributions(spark.createDataFrame(second, RECORD), "arxiv_id"))  # and then the driver dies
    kept.apply(2, spark.createDataFrame(second, RECORD))
    now = {r[0]: r for r in [*first, *second]}
    want = M.analyse(spark.createDataFrame(list(now.values()), RECORD))
    got = kept.analyse()
    for name, df in want.items():
        assert [tuple(r) for r in got[name].collect()] == [tuple(r) for r in df.collect()], name
