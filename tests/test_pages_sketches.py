"""Deep pages against the sorted list; sketches against exact counts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scholarq.operators import deep_pages as D
from scholarq.operators import search as S
from scholarq.operators import sketches as K

DDL = "arxiv_id string, published timestamp, relevance_score double, title string"


def _found(rnd, n, dates):
    start = datetime(2001, 1, 1)
    return [(f"p{i:05}", None if rnd.random() < 0.1 else start + timedelta(minutes=rnd.randrange(dates)),
             rnd.choice([1.0, 0.8, 0.4]), f"title {i}") for i in range(n)]


@pytest.mark.parametrize("by_relevance", [False, True])
@pytest.mark.parametrize("dates", [1, 40, 10**6])  # all on one date; ties; nearly unique
def test_every_page_equals_the_offset_page(spark, monkeypatch, by_relevance, dates):
    monkeypatch.setattr(D, "COARSE", 4)
    monkeypatch.setattr(D, "FINE", 3)
    rows = _found(random.Random(dates), 130, dates)
    df = spark.createDataFrame(rows, DDL).repartition(5)
    index = D.PageIndex(df, by_relevance)
    assert index.total == sum(index.counts) == 130 and max(index.counts) < 90
    for start, n in [(0, 10), (37, 25), (60, 1), (125, 10), (129, 1), (0, 500)]:
        want = [r["arxiv_id"] for r in S.page(df, start, n, by_relevance).collect()]
        assert [r["arxiv_id"] for r in index.page(start, n).collect()] == want
    assert index.page(130, 10).collect() == []
    assert [r["arxiv_id"] for r in index.last_page(25).collect()] == [
        r["arxiv_id"] for r in S.page(df, 125, 25, by_relevance).collect()]


def test_a_page_sorts_its_range_only(spark, tmpdir_path):
    path = f"{tmpdir_path}/found"
    spark.createDataFrame(_found(random.Random(4), 400, 10**6), DDL).write.parquet(path)
    page = D.PageIndex(spark.read.parquet(path)).page(200, 10)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "offset" not in plan.lower() and "published" in plan.split("PushedFilters")[1]
    assert page.count() == 10


def test_repeated_rows_ties_and_odd_values(spark):
    when = datetime(2001, 1, 1)
    rows = [("a", when, 1.0, "x")] * 7 + [(None, when, 1.0, "y"), ('q"\\\n', None, 1.0, "z"), ("é", when, 1.0, None)]
    df = spark.createDataFrame(rows, DDL)
    index = D.PageIndex(df)
    got = [r["arxiv_id"] for start in range(0, 12, 3) for r in index.page(start, 3).collect()]
    assert got == [None] + ["a"] * 7 + ["é", 'q"\\\n']
    with pytest.raises(ValueError):
        index.page(-1)
    with pytest.raises(ValueError):
        index.page(0, 0)


def test_nothing_found(spark):
    index = D.PageIndex(spark.createDataFrame([], DDL))
    assert index.total == 0 and index.page().collect() == [] and index.last_page().collect() == []


RECORDS = "published timestamp, categories string, authors_parsed array<array<string>>"


def test_sketches_keep_their_bound_over_any_period(spark):
    n = 60_000
    records = spark.range(n).select(
        F.expr("timestamp'2001-01-01' + make_interval(0, cast(id % 12 as int))").alias("published"),
        F.concat_ws(" ", F.concat(F.lit("c"), F.col("id") % 700), F.lit("common")).alias("categories"),
        F.array(F.array(F.concat(F.lit("n"), F.col("id") % 25_000), F.lit("x")), F.array(F.lit("alone"))).alias("authors_parsed"))
    sketches = K.monthly_sketches(records)
    assert sketches.count() == 24
    half = F.when(F.col("month") < "2001-07", "first").otherwise("second").alias("half")
    exact = {(r["half"], r["section"]): r["n"] for r in
             K.mentioned(records).groupBy(half, "section").agg(F.count_distinct("value").alias("n")).collect()}
    for r in K.distinct_estimates(sketches, half).collect():
        want = exact[r["half"], r["section"]]
        assert abs(r["estimate"] - want) <= K.relative_bound() * want
    whole = {r["section"]: r["estimate"] for r in K.distinct_estimates(sketches).collect()}
    assert abs(whole["author"] - 25_000) <= K.relative_bound() * 25_000 and whole["author"] != 25_000
    assert abs(whole["category"] - 701) <= K.relative_bound() * 701


def test_merged_batches_equal_one_and_records_twice_count_once(spark):
    when = datetime(2001, 1, 5)
    a = [(when, "x y", [["p", "q"]]), (None, "z", None)]
    b = [(when, "y w", None), (when, None, []), (None, " ", [["p", "q"], [None, "q"]])]
    frame = lambda rows: spark.createDataFrame(rows, RECORDS)
    merged = K.merged(K.monthly_sketches(frame(a)), K.monthly_sketches(frame(b)), K.monthly_sketches(frame(a)))
    got = {(r["month"], r["section"]): r["estimate"] for r in K.distinct_estimates(merged, F.col("month")).collect()}
    assert got == {("2001-01", "category"): 3, ("2001-01", "author"): 1, (None, "category"): 1, (None, "author"): 2}
    assert K.monthly_sketches(frame([])).count() == 0
