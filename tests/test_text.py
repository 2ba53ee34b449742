import json

import pytest
from pyspark.sql import functions as F

from scholarq.operators import doctree as D
from scholarq.operators import sentiment as SE
from scholarq.operators import tfidf as T
from scholarq.operators.clustering import cluster_papers

LEX = SE.Lexicon({"good": 2.0, "bad": -2.0, "great": 3.0}, ("not",), ("very",))


def _deep(depth, text):
    node = {"TYPE": "text", "VALUE": text}
    for i in range(depth):
        node = {"TYPE": "paragraph", "VALUE": [node]}
    return node


def test_tree_walk_order_and_skips(spark):
    tree = {"TYPE": "document", "VALUE": [
        {"TYPE": "body", "VALUE": [
            {"TYPE": "paragraph", "VALUE": [{"TYPE": "text", "VALUE": "one"}]},
            {"TYPE": "page-mark", "VALUE": "skip me"},
            {"TYPE": "table", "VALUE": [{"TYPE": "table-row", "VALUE": [{"TYPE": "table-cell", "VALUE": [
                {"TYPE": "paragraph", "VALUE": [{"TYPE": "text", "VALUE": "two"}]}]}]}]},
            {"TYPE": "paragraph", "VALUE": [{"TYPE": "text", "VALUE": "three"}],
             "style": {"TYPE": "text", "VALUE": "four"}},
            "loose string",
        ]}]}
    order = '{"z": {"TYPE": "text", "VALUE": "first"}, "a": [{"VALUE": "second", "TYPE": "text"}]}'
    deep = '{"TYPE":"group","VALUE":[' * 30000 + '{"TYPE":"text","VALUE":"bottom \\"x\\""}' + "]}" * 30000
    df = spark.createDataFrame([(1, json.dumps(tree)), (2, json.dumps(_deep(30, "deep"))), (3, "not json"),
                                (4, json.dumps(_deep(200, "deeper"))), (5, order), (6, deep), (7, None), (8, ""),
                                (9, '{"TYPE": "text", "VALUE": null}'), (10, '{"TYPE": "text", "VALUE": 5}')],
                               "id long, tree string")
    out = {r.id: r.texts for r in D.with_text_nodes(df, "tree").collect()}
    assert out == {1: ["one", "two", "three", "four"], 2: ["deep"], 3: [], 4: ["deeper"], 5: ["first", "second"],
                   6: ['bottom "x"'], 7: [], 8: [], 9: [], 10: ["5"]}
    ft = {r.id: r.text for r in D.full_text(df, "id", "tree").collect()}
    assert ft[1] == "one two three four"
    assert D.extract_texts(df, "id", "tree").filter("id = 1").orderBy("pos").collect()[1].text == "two"


def test_top_level_list_only(spark):
    df = spark.createDataFrame([(1, json.dumps([{"TYPE": "text", "VALUE": "a"}, {"TYPE": "x"}])),
                                (2, json.dumps({"TYPE": "text", "VALUE": "b"}))], "id long, tree string")
    assert {r.id: r.text for r in D.top_level_texts(df, "id", "tree").collect()} == {1: "a", 2: ""}


def _score(spark, text):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    return SE.document_sentiment(df, "id", "text", LEX).first()


def test_sentiment_rules(spark):
    good = _score(spark, "good")
    assert good.polarity == round(2.0 / (4.0 + 15.0) ** 0.5, 4) and good.label == "Positive"
    assert _score(spark, "not good").polarity < 0                        # negation flips
    assert _score(spark, "very good").polarity > good.polarity           # booster
    empty = _score(spark, "")
    assert (empty.polarity, empty.subjectivity, empty.label) == (0.0, 0.0, "Neutral")
    assert _score(spark, "good thing").subjectivity == pytest.approx((round(3 / 4, 3) + 0) / 2)


def test_label_boundaries(spark):
    df = spark.createDataFrame([(p,) for p in (0.31, 0.77, -0.31, -0.9, 0.0, 0.29, -0.04, 0.3, -0.3)], "p double")
    labels = [r.l for r in df.select(SE.label(F.col("p")).alias("l")).collect()]
    assert labels == ["Positive", "Positive", "Negative", "Negative", "Neutral", "Neutral", "Neutral",
                      "Neutral", "Neutral"]


def test_sentences_and_attach(spark):
    df = spark.createDataFrame([(1, "Good day. Bad night!  Great?"), (2, None)], "id long, text string")
    s = SE.sentence_sentiment(df, "id", "text", LEX).orderBy("sent_idx").collect()
    assert [r.sentence for r in s] == ["Good day.", "Bad night!", "Great?"]
    assert [r.polarity > 0 for r in s] == [True, False, True]
    att = {r.id: (r.sentiment_label, r.sentiment_score)
           for r in SE.attach_sentiment(df, "text", LEX, key_cols=["id"]).collect()}
    assert att[2] == ("N/A", None)


def test_tfidf_formula_and_norm(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana cherry"), (3, "the of")],
                                 "id long, text string")
    w, v = T.tfidf(docs, "id", "text")
    vocab = {r.term: (r.df, r.cf) for r in v.collect()}
    assert vocab["apple"] == (1, 2) and vocab["banana"] == (2, 2) and "apple banana" in vocab
    assert "the" not in vocab                                       # stop word
    norms = w.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-9 for r in norms)
    import math
    idf = lambda df: math.log((1 + 3) / (1 + df)) + 1
    d2 = {r.term: r.weight for r in w.filter("id = 2").collect()}
    raw = {"banana": idf(2), "cherry": idf(1), "banana cherry": idf(1)}
    n = math.sqrt(sum(x * x for x in raw.values()))
    assert d2 == pytest.approx({k: x / n for k, x in raw.items()})


def test_clustering_partitions_input(spark):
    rows = [(i, f"t{i}", ("apple banana fruit " if i % 2 else "engine motor wheel ") * 3) for i in range(12)]
    papers = spark.createDataFrame(rows, "paper_id long, title string, abstract string")
    members, terms = cluster_papers(papers, k=2)
    m = members.collect()
    assert sorted(r.paper_id for r in m) == list(range(12))
    by = {}
    for r in m:
        by.setdefault(r.cluster, set()).add(r.paper_id % 2)
    assert all(len(v) == 1 for v in by.values())                    # the two topics separate
    assert abs(sum(r.x for r in m)) < 1e-6                           # centred coordinates
    assert terms.groupBy("cluster").count().filter("count > 5").count() == 0
    few, _ = cluster_papers(papers.limit(2), k=5)                     # k capped at n
    assert few.count() == 2
    empty, t2 = cluster_papers(spark.createDataFrame([(1, "the", "of")], "paper_id long, title string, "
                                                     "abstract string"), k=2)
    assert empty.count() == 0 and t2.count() == 0


def test_emphasis_rules(spark):
    lex = SE.Lexicon({"good": 1.9, "bad": -2.5}, ("not",), ("very",), ("slightly",))

    def polarity(text):
        df = spark.createDataFrame([(1, text)], "id long, text string")
        return SE.document_sentiment(df, "id", "text", lex).first().polarity

    plain = polarity("a good day")
    assert polarity("a GOOD day") > plain and polarity("A GOOD DAY") == plain  # capitals stand out among small letters
    assert polarity("a good day!") > plain and polarity("a bad day!") < polarity("a bad day")
    assert polarity("a good day!!!!") == polarity("a good day!!!!!!")
    assert polarity("slightly good") < polarity("good") < polarity("very nicely good") < polarity("very good")
    assert polarity("very a b c good") == polarity("x a b c good")  # four tokens back is too far


def test_lexicon_as_a_table(spark):
    from scholarq.plans.fixtures import TEST_LEXICON as T
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    table = spark.createDataFrame([*T.valences.items(), *((f"zz{i}", 0.5) for i in range(600))], "token string, valence double")
    as_table = SE.Lexicon(table, T.negators, T.boosters, T.dampeners)
    for fn in (SE.document_sentiment, SE.sentence_sentiment):
        one, two = (sorted(map(tuple, fn(docs, "doc_id", "text", x).collect()), key=repr) for x in (T, as_table))
        assert one == two


def test_tree_walk_survives_any_text(spark):
    import json as J
    import random

    from scholarq.operators import doctree as D
    deep = 30_000
    rows = [(1, '{"TYPE":"text","VALUE":"a\\ud800b\\udc00"}'), (2, "[" * 200_000 + "}" * 200_000), (3, "[" * 3 + "}" * 3),
            (4, "[" * deep + '{"TYPE":"text","VALUE":"x"}' + "]" * deep), (5, "[" * deep + '"x"' + "]" * deep + "]"), (6, None), (7, "😀".encode("utf-16", "surrogatepass").decode("utf-16"))]
    got = {r[0]: r[1] for r in D.full_text(spark.createDataFrame(rows, "id long, tree string"), "id", "tree").collect()}
    assert got == {1: "a�b�", 2: "", 3: "", 4: "x", 5: "", 6: "", 7: ""}

    # the parser without recursion accepts and gives what the standard one does
    rng = random.Random(4)
    seeds = ['{"a": [1, -2.5e3, true, null, "x\\n\\u00e9"], "b": {"c": [], "d": {}}, "a": NaN}', ' [ [ ] , {} , "" , 0 ] ', '"\\ud83d\\ude00"', "-Infinity"]
    texts = list(seeds)
    for _ in range(6000):
        t = rng.choice(seeds)
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + rng.choice(["", "", *'{}[],:"\\ 01.-eEtn\t\x01', "\xa0"]) + t[at + rng.randrange(2):]
        texts.append(t)

    def outcome(parse, t):
        try:
            return repr(parse(t))
        except ValueError:
            return "refused"

    accepted = 0
    for t in texts:
        want = outcome(J.loads, t)
        assert outcome(D._parse, t) == want, t
        accepted += want != "refused"
    assert accepted > 100


@pytest.mark.parametrize("k", [1, 7, 60, 5000])
def test_threshold_vocabulary_is_that_of_counting_all_terms(spark, monkeypatch, k):
    import random
    rng = random.Random(k)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, [words[min(299, int(rng.expovariate(0.03)))] for _ in range(rng.choice([0, 1, 2, 30, 90]))]) for i in range(400)] + [(400, None)]
    kept = spark.createDataFrame(rows, "id long, kept array<string>").repartition(6)
    monkeypatch.setattr(T, "RUN_TOKENS", 700)  # captured by the tasks: several runs in each
    full = T.top_terms(T.term_rows(kept.select("id", T.terms_of(F.col("kept")).alias("terms")), "id"), k)
    got = T.top_terms_by_threshold(kept.filter("kept IS NOT NULL"), k)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect()))
    assert T.top_terms_by_threshold(kept.limit(0), k).collect() == []


def test_runs_are_bounded_in_tokens(spark, monkeypatch):
    """A run ends soon after ``RUN_TOKENS`` tokens, however many documents an Arrow batch holds."""
    kept = spark.createDataFrame([(["a", "b", "c", "d", "e"] * 10,)] * 300, "kept array<string>").coalesce(1)
    monkeypatch.setattr(T, "RUN_TOKENS", 1000)
    runs = T.counted_in_runs(kept, 3).filter("term NOT LIKE '% %'").groupBy("run").agg(F.sum("n").alias("n")).collect()
    assert sum(r.n for r in runs) == 15_000 and max(r.n for r in runs) <= 2000


def test_tree_walk_gets_few_texts_at_a_time(spark):
    """An Arrow batch would hold 10,000 trees."""
    df = spark.createDataFrame([(1, '{"TYPE":"text","VALUE":"a"}'), (2, None)], "id long, tree string")
    out = D.extract_texts(df, "id", "tree")
    assert "ArrowEvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r.id, r.text) for r in out.collect()] == [(1, "a")]


def test_texts_are_scored_in_their_rows(spark):
    """A lexicon in memory explodes no tokens; a table of the same valences gives the same scores."""
    T = SE.Lexicon({"good": 1.9, "bad": -2.5, "fin": 0.5}, ("not",), ("very",), ("slightly",))
    table = SE.Lexicon(spark.createDataFrame(sorted(T.valences.items()), "token string, valence double"),
                       T.negators, T.boosters, T.dampeners)
    texts = ["GOOD very good", "not very slightly good!! bad", "", None, "x y z", "very VERY BAD fin", "not a b c good", "GOOD BAD", "FIN!"] * 40
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    for fn in (SE.document_sentiment, SE.sentence_sentiment):
        ours = fn(df, "id", "text", T)
        assert "Generate posexplode" not in SE.document_sentiment(df, "id", "text", T)._jdf.queryExecution().toString()
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, fn(df, "id", "text", table).collect()))
