import random

import pytest
from pyspark.sql import functions as F

from scholarq.operators import search as S
from scholarq.operators.mentions import like_papers_by_index, mention_like_papers
from scholarq.operators.text_index import SubstringIndex, TextIndex

WORDS = ["alpha", "Alphabet", "bet", "x", "Ünder", "naïve", "a.b", "o'neil", "graph", "graphs", "the", "zz"]


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(3)

    def text(n):
        return rng.choice([" ", "  ", "\t"]).join(rng.choices(WORDS, k=n))

    rows = [(f"ax{i:04d}", text(rng.randrange(1, 5)) + " the", text(rng.randrange(0, 9)) if i % 7 else None,
             [text(rng.choice([1, 2])) for _ in range(rng.randrange(4))] if i % 11 else None, rng.choice(["cs.AI math", "cs.LG", None]), i)
            for i in range(300)]
    return spark.createDataFrame(rows, "arxiv_id string, title string, abstract string, authors array<string>, categories string, published int")


@pytest.fixture(scope="module")
def index(spark, records, tmp_path_factory):
    return TextIndex.build(records, str(tmp_path_factory.mktemp("index")), range_rows=32)


@pytest.mark.parametrize("kind, q", [("keyword", q) for q in ("ALPHA bet", "lph", "graph the", "ünder", "cs. math", "none", " ")]
                         + [(k, q) for k in ("author", "title") for q in ("x", "graphs  the", " the", "t the ", "")])
def test_indexed_searches_equal_scans(records, index, kind, q):
    cols = ["arxiv_id", "title", "abstract", "relevance_score", "pdf_url"]
    got, want = index.search(q, kind).select(*cols), S.search(records, q, kind).select(*cols)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_many_terms_are_joined_to_the_same_result(records, index, monkeypatch):
    from scholarq.operators import text_index
    monkeypatch.setattr(text_index, "MOST_LITERALS", 1)
    assert sorted(r.arxiv_id for r in index.search("a e").collect()) == sorted(r.arxiv_id for r in S.search(records, "a e").collect())


def test_records_are_computed_once_and_a_piece_of_a_range_has_its_own_lists(spark, records, tmpdir_path, monkeypatch):
    from scholarq.operators import text_index
    monkeypatch.setattr(text_index, "LIST_TOKENS", 200)  # captured by the tasks: several pieces of a range
    computed = spark.sparkContext.accumulator(0)

    def counted(title):
        computed.add(1)
        return title
    index = TextIndex.build(records.withColumn("title", F.udf(counted, useArrow=False)("title")), f"{tmpdir_path}/index", range_rows=128)
    assert computed.value == 300
    the = index.lists.filter("term = 'title:the'")
    assert the.count() > 4 and the.select(F.explode("numbers").alias("no")).distinct().count() == the.agg(F.sum("n")).first()[0] == 300
    for q in ("lph", "graph the", "ünder", "cs. math"):
        assert sorted(r.arxiv_id for r in index.search(q).collect()) == sorted(r.arxiv_id for r in S.search(records, q).collect()), q


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_search_reads_its_own_buckets_and_a_hot_list_is_in_ranges(index):
    lists = plan(index.lists_of(["naïve"], "keyword"))
    assert "PartitionFilters: [" in lists and "bucket" in lists.split("PartitionFilters: [")[1].split("]")[0]
    read = index.lists_of(["naïve"], "keyword").select(F.input_file_name().alias("f")).distinct().count()
    assert 0 < read < 0.3 * len(index.lists.inputFiles())
    assert "dynamicpruning" in plan(index.search("naïve"))
    hot = index.lists.filter("term = 'title:the'")
    assert hot.count() > 8 and hot.agg(F.max("n"), F.sum("n")).first() == (32, 300)
    with pytest.raises(ValueError):
        index.search("x", "body")


def test_names_by_substring(spark, tmpdir_path):
    rng = random.Random(1)
    names = ["A", "ab", "ABC", "Acme Labs", "acme labs of the far north", "100%_sure", "", "Ü x", None, "x" * 30, "a\\b"]
    names += ["".join(rng.choices("abC ", k=rng.randrange(1, 25))) for _ in range(200)]
    entities = spark.createDataFrame([(i, n, "ORG" if i % 5 else "PERSON") for i, n in enumerate(names)], "entity_id long, entity_name string, entity_type string")
    phe = spark.createDataFrame([(i, i // 2, 1) for i in range(len(names))], "entity_id long, paper_id long, count long")
    papers = spark.createDataFrame([(i, f"p{i}", "", "", "", "") for i in range(len(names))],
                                   "paper_id long, paper_name string, paper_pdf string, paper_docx string, paper_json string, paper_entities string")
    index = SubstringIndex.build(entities, "entity_name", f"{tmpdir_path}/names", range_rows=16)
    asked = ["B", "ab", "ACME", "labs of the far nor", "%_", "ü", "xxxxxxxxxxxxxxxxxxxxxx", "\\", ""]
    asked += [n[i:i + k] for n in names[11:17] for i, k in [(rng.randrange(len(n)), rng.randrange(1, 21))]]
    for term in asked:
        got = sorted(r.paper_id for r in like_papers_by_index(papers, phe, index, term).collect())
        assert got == sorted(r.paper_id for r in mention_like_papers(papers, phe, entities, term).collect()), term
    scans = plan(index.containing("acme"))
    assert "dynamicpruning" in scans and "bucket" in scans.split("PartitionFilters: [")[1]
