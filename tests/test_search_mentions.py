import pytest
from pyspark.sql import functions as F

from scholarq.functions.names import surname_first, without_dots
from scholarq.operators import search as S
from scholarq.operators.local_search import local_search, shape_local_results
from scholarq.operators.mentions import Clause, build_mention_index, mention_search
from scholarq.operators.tiers import first_nonempty


@pytest.fixture()
def index(spark):
    papers = spark.createDataFrame(
        [(1, "p1"), (2, "p2"), (3, "p3")], "paper_id long, paper_name string").select(
        "paper_id", "paper_name", *[F.concat(F.lit(d + "/"), "paper_name").alias(c) for d, c in
                                    [("Papers", "paper_pdf"), ("Docs", "paper_docx"), ("JSON", "paper_json"),
                                     ("Ents", "paper_entities")]])
    raw = spark.createDataFrame(
        [(1, "Ann Lee", "PERSON"), (1, "Ann Lee", "PERSON"), (1, "Acme", "ORG"),
         (2, "Lee", "PERSON"), (2, "Acme Labs", "ORG"), (3, "Bob", "PERSON")],
        "paper_id long, entity_name string, entity_type string")
    entities, phe = build_mention_index(raw)
    return papers, entities, phe


def test_counts_and_unique_ids(index):
    _, e, phe = index
    assert phe.agg(F.sum("count")).first()[0] == 6          # sum of counts = input mentions
    assert e.count() == e.select("entity_id").distinct().count()


def test_and_is_per_paper_not_per_row(index):
    p, e, phe = index
    cl = [Clause("person", "Ann Lee"), Clause("organisation", "Acme")]
    paper = mention_search(p, phe, e, cl, ["and"], mode="paper")
    assert sorted(r.entity_name for r in paper.collect()) == ["Acme", "Ann Lee"]
    assert mention_search(p, phe, e, cl, ["and"], mode="row").count() == 0   # as shipped: never matches


def test_limit_one_and_validation(index):
    p, e, phe = index
    assert mention_search(p, phe, e, [Clause("person", "Lee")], limit="one").count() == 1
    with pytest.raises(ValueError):
        mention_search(p, phe, e, [Clause("place", "x")])
    with pytest.raises(ValueError):
        mention_search(p, phe, e, [Clause("person", "x")], limit="some")


def test_person_fallback_and_relevance(spark, index):
    p, e, phe = index
    rows = local_search(p, phe, e, "person", "Tom Lee")       # no exact match: parts 'Tom', 'Lee'
    assert sorted(r.paper_id for r in rows.collect()) == [2]
    texts = spark.createDataFrame([(1, "by ann lee"), (3, "nothing")], "paper_id long, text string")
    both = mention_search(p, phe, e, [Clause("person", "Ann Lee"), Clause("person", "Bob")], ["or"], mode="row")
    out = {r.paper_id: r.relevance_score for r in shape_local_results(both, "person", "Ann Lee", texts).collect()}
    assert out == {1: 1.0, 3: 0.4}
    bob = mention_search(p, phe, e, [Clause("person", "Bob")])
    assert shape_local_results(bob, "person", "Zed", texts).first().relevance_score == 0.4
    assert shape_local_results(bob, "person", "nothing", texts).first().relevance_score == 0.6
    lee = mention_search(p, phe, e, [Clause("person", "Lee")])
    assert shape_local_results(lee, "person", "Lee X", None).first().relevance_score == 0.8
    assert shape_local_results(bob, "person", "Zed", None).first().relevance_score == 0.3


def test_org_substring_tier(index):
    p, e, phe = index
    rows = local_search(p, phe, e, "organisation", "labs").collect()   # no space: straight to LIKE tier
    assert [(r.paper_id, r.entity_name) for r in rows] == [(2, None)]
    shaped = shape_local_results(local_search(p, phe, e, "organisation", "labs"), "organisation", "labs").first()
    assert shaped.entity_name == "labs" and shaped.entity_type == "organisation"


def test_first_nonempty(spark):
    a = spark.range(0).withColumn("t", F.lit("a"))
    b = spark.range(2).withColumn("t", F.lit("b"))
    c = spark.range(3).withColumn("t", F.lit("c"))
    assert {r.t for r in first_nonempty([a, b, c]).collect()} == {"b"}

    def never():
        raise AssertionError("a tier after the first hit was built")

    assert first_nonempty([lambda: a, lambda: b, never]).count() == 2


def test_name_variants():
    assert surname_first("John Doe") == "Doe, John"
    assert surname_first("A B C") is None
    assert without_dots("J. Doe") == "J Doe"


@pytest.fixture()
def records(spark):
    return spark.createDataFrame(
        [("a1", "Quantum computing now", "good", ["John Doe", "Ann Roe"], "quant-ph cs.AI", "2021-01-01"),
         ("a2", "Classical", "quantum computing is bad", ["Johnny Doe"], "cs.LG", "2021-03-01"),
         ("a3", "Other", None, ["Zed"], "math.CO", "2020-01-01"),
         ("a4", "Poetry", None, ["Poe, Jane"], "cs.CL", "2019-01-01")],
        "arxiv_id string, title string, abstract string, authors array<string>, categories string, "
        "published string").withColumn("published", F.to_timestamp("published"))


def test_keyword_author_title_and_paging(records):
    assert [r.arxiv_id for r in S.search_page(records, "quantum computing", "keyword").collect()] == ["a2", "a1"]
    assert [r.arxiv_id for r in S.search_page(records, "quantum computing", "keyword", 1, 1).collect()] == ["a1"]
    au = {r.arxiv_id: r.relevance_score for r in S.search(records, "John Doe", "author").collect()}
    assert au == {"a1": 1.0}
    au2 = {r.arxiv_id: r.relevance_score for r in S.search(records, "doe", "author").collect()}
    assert au2 == {"a1": 0.8, "a2": 0.8}
    assert [r.arxiv_id for r in S.search(records, "classical", "title").collect()] == ["a2"]
    assert S.category_filter(records, "cs.AI").first().arxiv_id == "a1"


def test_author_fallback(records):
    rows = S.author_search_with_fallback(records, "Jane Poe").collect()   # surname-first tier
    assert [r.arxiv_id for r in rows] == ["a4"]
    rows = S.author_search_with_fallback(records, "Doe John").collect()   # keyword tier, newest first
    assert [r.arxiv_id for r in rows] == ["a2", "a1"]
    rows = S.author_search_with_fallback(records, "Ann. Roe").collect()   # dots-removed tier
    assert [r.arxiv_id for r in rows] == ["a1"]


def test_decode_and_merge(spark, records):
    df = spark.createDataFrame([('["a","b"]',), ("[oops",), (None,)], "j string")
    assert [r.n for r in df.select(F.size(S.decode_list(F.col("j"))).alias("n")).collect()] == [2, 0, 0]
    a = records.filter("arxiv_id <> 'a3'").withColumn("src", F.lit("first"))
    b = records.withColumn("src", F.lit("second"))
    merged = {r.arxiv_id: r.src for r in S.first_wins_union(a, b).collect()}
    assert merged == {"a1": "first", "a2": "first", "a3": "second", "a4": "first"}
    c = records.filter("arxiv_id = 'a1'").withColumn("src", F.lit("first"))
    merged = {r.arxiv_id: r.src for r in S.first_wins_union(c, b).collect()}
    assert merged == {"a1": "first", "a2": "second", "a3": "second", "a4": "second"}


def test_first_nonempty_eager_and_id_collisions(spark, index):
    from scholarq.operators.mentions import check_unique_ids
    a = spark.range(0)
    b = spark.range(3)
    assert first_nonempty([a, b]).count() == 3
    assert first_nonempty([a, a]).count() == 0
    _, e, _ = index
    assert check_unique_ids(e).count() == 0
    clash = e.unionByName(e.limit(1).withColumn("entity_name", F.lit("other")))
    assert check_unique_ids(clash).count() == 1


def test_tagger_is_greedy_and_exact(spark):
    from scholarq.operators.gazetteer import tag_entities
    names = spark.createDataFrame([("alpha beta", "ORG"), ("beta gamma", "ORG"), ("gamma delta", "ORG"), ("in The", "GPE"),
                                   ("one two three four five six", "EVENT"), ("one two", "LAW"), ("six", "CARDINAL"),
                                   ("alpha beta", "LAW")], "name string, label string")
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "in. The end, in  The end"), (3, "one two three\nfour five six"),
                                  (4, None), (5, ""), (6, "one two, six")], "id long, text string")
    tags = sorted(map(tuple, tag_entities(docs, "id", "text", names).collect()))
    assert tags == [
        (1, "alpha beta", 0, 10, "LAW"), (1, "gamma delta", 11, 22, "ORG"),  # the second overlaps nothing that was kept
        (2, "in  The", 13, 20, "GPE"), (3, "one two three\nfour five six", 0, 27, "EVENT"),
        (6, "one two", 0, 7, "LAW"), (6, "six", 9, 12, "CARDINAL")]
    texts = {r.id: r.text for r in docs.collect()}
    assert all(texts[i][s:e] == t for i, t, s, e, _ in tags)


def test_point_lookup_reaches_the_scan(spark):
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = S.point_lookup(orders, "o_orderkey", 42)._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,42)" in plan


def test_cache_gives_whole_records_and_those_to_store(spark):
    schema = "arxiv_id string, title string, doi string"
    cache = spark.createDataFrame([("1", "stored", None), ("2", None, None), (None, "x", None)], schema)
    source = spark.createDataFrame([("1", "remote", "10.1/x"), ("2", "remote", "10.1/y"), ("3", None, "10.1/z"), ("3", None, "10.1/z")], schema)
    got = sorted((tuple(r) for r in S.cache_first(cache, source.distinct()).collect()), key=repr)
    assert got == sorted([("1", "stored", None), ("2", None, None), ("3", None, "10.1/z"), (None, "x", None)], key=repr)
    assert [tuple(r) for r in S.to_store(cache, source).collect()] == [("3", None, "10.1/z")]


def test_a_page_past_the_end_is_empty(spark):
    rows = [(f"a{i}", "t", "", ["Ann Roe"] if i < 3 else ["Ann B.", "C Roe"], "", f"2020-01-0{i + 1}") for i in range(6)]
    records = spark.createDataFrame(rows, "arxiv_id string, title string, abstract string, authors array<string>, categories string, published string")
    assert [r.arxiv_id for r in S.author_search_with_fallback(records, "Ann Roe").collect()] == ["a2", "a1", "a0"]
    assert S.author_search_with_fallback(records, "Ann Roe", start=3).collect() == []


def test_unified_search_skips_known_titles_and_names_records_to_store(spark, index):
    from scholarq.operators.unified import unified_search
    p, e, phe = index
    rows = [("a1", "p1", "", ["Ann Lee"], "", "2020-01-01"), ("a2", "Other", "", ["Ann Lee"], "", "2020-01-02"),
            ("a3", "Third", "quantum", ["Bob"], "", "2020-01-03")]
    records = spark.createDataFrame(rows, "arxiv_id string, title string, abstract string, authors array<string>, categories string, published string")
    cache = records.filter("arxiv_id = 'a2'").select("arxiv_id", "title")
    found, store = unified_search(p, phe, e, records, cache, "person", "Ann Lee")
    assert sorted((r.source, r.key, r.title) for r in found.collect()) == [("arxiv", "a2", "Other"), ("local", "1", "p1")]
    assert [tuple(r) for r in store.collect()] == [("a1", "p1")]
    found, _ = unified_search(p, phe, e, records, cache, "organisation", "Nobody", query="quantum")
    assert [(r.source, r.key) for r in found.collect()] == [("arxiv", "a3")]
