import os

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scholarq.operators import merge as G
from scholarq.operators.ids import sequential_ids
from scholarq.schemas import PAPERS


def test_sequential_ids_match_row_number(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).cast("string").alias("k"))
    got = sequential_ids(df, ["k"], 100, "sid")
    ref = df.withColumn("rid", F.row_number().over(Window.orderBy("k")) + 100)
    assert got.join(ref, "k").filter(F.col("sid") != F.col("rid")).count() == 0
    assert got.count() == 5000


def test_upsert_keeps_ids_and_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", "p1"), (2, "b", "p2")], "id long, name string, path string")
    new = spark.createDataFrame([("b", "p2b"), ("c", "p3")], "name string, path string")
    once = G.upsert_by_key(old, new, ["name"], "id", ["path"])
    rows = {r.name: (r.id, r.path) for r in once.collect()}
    assert rows == {"a": (1, "p1"), "b": (2, "p2b"), "c": (3, "p3")}
    for parts in (1, 4):  # of repeated keys the last row wins, however they are partitioned
        many = spark.createDataFrame([("b", f"p{i}", i) for i in range(8)], "name string, path string, seq int").repartition(parts)
        last = {r.name: r.path for r in G.upsert_by_key(old, many, ["name"], "id", ["path"], order_col="seq").collect()}
        assert last == {"a": "p1", "b": "p7"}
    clash = spark.createDataFrame([("b", "x"), ("b", "y")], "name string, path string")
    with pytest.raises(Exception, match="order_col"):
        G.upsert_by_key(old, clash, ["name"], "id", ["path"]).collect()
    twice = G.upsert_by_key(once, new, ["name"], "id", ["path"])
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_replace_counts_idempotent_add_counts_grows(spark):
    old = spark.createDataFrame([(1, 10, 2), (2, 10, 1)], "entity_id long, paper_id long, count long")
    batch = spark.createDataFrame([(1, 10, 3)], "entity_id long, paper_id long, count long")
    r1 = G.replace_counts(old, batch)
    r2 = G.replace_counts(r1, batch)
    key = lambda df: sorted((r.entity_id, r.paper_id, r["count"]) for r in df.collect())
    assert key(r1) == key(r2) == [(1, 10, 3)]   # paper 10 re-ingested: its rows replaced
    added = G.add_counts(old, batch, ["entity_id", "paper_id"])
    assert {(r.entity_id, r["count"]) for r in added.collect()} == {(1, 5), (2, 1)}


def test_insert_or_replace_last_wins_and_default(spark):
    stored = spark.createDataFrame([("x", "old", 0.5), ("y", "keep", 0.5)], "arxiv_id string, title string, "
                                   "relevance_score double")
    batch = spark.createDataFrame([("x", "v1", None, 0), ("x", "v2", None, 1), ("z", "new", 0.9, 0)],
                                  "arxiv_id string, title string, relevance_score double, seq int")
    out = {r.arxiv_id: (r.title, r.relevance_score) for r in
           G.insert_or_replace(stored, batch, "arxiv_id", "seq", {"relevance_score": 1.0}).collect()}
    assert out == {"x": ("v2", 1.0), "y": ("keep", 0.5), "z": ("new", 0.9)}


def test_versioned_table_and_rejects(spark, tmpdir_path):
    t = G.VersionedTable(spark, os.path.join(tmpdir_path, "papers"), PAPERS)
    assert t.read().count() == 0 and t.current_version() is None
    rows = [(1, "a", "P/a", "D/a", "J/a", "E/a"), (2, "b", "P/b", "D/b", "J/b", "E/b")]
    df = spark.createDataFrame(rows, PAPERS)
    good, rejects = G.split_rejects(df, {"pdf_ok": F.col("paper_pdf").startswith("P/"),
                                         "not_b": F.col("paper_name") != "b"})
    assert [r.reason for r in rejects.collect()] == ["not_b"]
    assert t.commit(good) == 1
    assert t.commit(df) == 2
    assert t.read().count() == 2 and t.current_version() == 2
    with pytest.raises(Exception):  # a write that fails half way leaves a folder without the marker
        t.commit(df.withColumn("paper_id", F.when(F.col("paper_id") == 2, F.raise_error(F.lit("boom"))).otherwise(1)))
    assert t.current_version() == 2 and t.read().count() == 2
    assert t.commit(good) > 2 and t.read().count() == 1
    t.append(df)
    assert t.read().count() == 3
    for _ in range(4):
        t.commit(df)
    assert len([x for x in os.listdir(os.path.join(tmpdir_path, "papers")) if x.startswith("v")]) == 3  # older ones are gone


def test_entity_files_round_trip(spark, tmpdir_path):
    from scholarq.sources.files import read_entity_files
    m = spark.createDataFrame([("a.pdf", "Ann", 9, 12, "PERSON"), ("a.pdf", "Acme", 0, 4, "ORG"),
                               ("b.pdf", "Bob", 3, 6, "PERSON")],
                              "paper_name string, text string, start_char int, end_char int, label string")
    out = os.path.join(tmpdir_path, "ents")
    G.write_entity_files(m, out)
    back = read_entity_files(spark, out, per_line=True).select("paper_pdf", "text", "start_char", "label").collect()
    assert sorted(map(tuple, back)) == [("a.pdf", "Acme", 0, "ORG"), ("a.pdf", "Ann", 9, "PERSON"), ("b.pdf", "Bob", 3, "PERSON")]


def test_only_touched_buckets_are_rewritten(spark, tmpdir_path):
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
    t = G.BucketedTable(spark, os.path.join(tmpdir_path, "b"), schema, ["id"], buckets=8)
    assert t.read().count() == 0
    first = spark.range(100).select("id", F.lit("old").alias("v"))
    t.rewrite(first, lambda old: first)
    before = t._folders()
    new = spark.createDataFrame([(5, "new"), (200, "new")], schema)
    t.rewrite(new, lambda old: old.join(new.select("id"), "id", "left_anti").unionByName(new))
    after = t._folders()
    rows = {r.id: r.v for r in t.read().collect()}
    assert len(rows) == 101 and rows[5] == rows[200] == "new" and rows[6] == "old"
    assert 1 <= sum(after[b] != before[b] for b in before) <= 2
    with pytest.raises(Exception):
        t.rewrite(new, lambda old: old.withColumn("v", F.raise_error(F.lit("boom"))))
    assert {r.id: r.v for r in t.read().collect()} == rows
    gone = spark.createDataFrame([(5, "x")], schema)
    for _ in range(5):  # a bucket's rows may all go; unused folders do, too
        t.rewrite(gone, lambda old: old.filter("false"))
    assert t.read().filter("id = 5").count() == 0
    used = {f.split("/")[0] for f in t._folders().values()}
    assert used <= {x for x in os.listdir(os.path.join(tmpdir_path, "b")) if x.startswith("data-")}
