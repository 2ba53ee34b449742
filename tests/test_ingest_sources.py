import os

from scholarq.operators import sentiment as SE
from scholarq.sources.manifest import derive_paths, list_directory, match_manifest, read_manifest


def test_listing_manifest_last_row_wins(spark, tmpdir_path):
    papers = os.path.join(tmpdir_path, "Papers")
    os.makedirs(papers)
    for n in ("a.pdf", "b.pdf", "stray.pdf"):
        with open(os.path.join(papers, n), "wb") as f:
            f.write(b"%PDF")
    man = os.path.join(tmpdir_path, "index.csv")
    with open(man, "w") as f:
        f.write(" paper_name , paper_pdf \nFirst A,a.pdf\nPaper B,b.pdf\nFinal A,a.pdf\n")
    m = read_manifest(spark, man)
    assert m.columns[:2] == ["paper_name", "paper_pdf"]            # header trimmed
    matched, unmatched = match_manifest(list_directory(spark, papers), m)
    got = {r.name: r.paper_name for r in matched.collect()}
    assert got == {"a.pdf": "Final A", "b.pdf": "Paper B"}           # last manifest row wins
    assert [r.name for r in unmatched.collect()] == ["stray.pdf"]
    p = derive_paths(matched.select("paper_name", "paper_pdf")).filter("paper_name = 'Paper B'").first()
    assert (p.paper_pdf, p.paper_docx, p.paper_json, p.paper_entities) == (
        "Papers/b.pdf", "Docs/b.pdf.docx", "JSON/b.pdf.json", "Ents/b.pdf.json")


def test_paper_sentiment_lookup(spark):
    lex = SE.Lexicon({"good": 2.0, "bad": -2.0})
    texts = spark.createDataFrame([(1, "Good. Bad bad."), (2, "fine")], "paper_id long, text string")
    overall, sentences = SE.paper_sentiment(texts, 1, lex)
    assert overall.count() == 1 and sentences.count() == 2
    assert overall.first().polarity < 0
    none, none_s = SE.paper_sentiment(texts, 99, lex)
    assert none.count() == 0 and none_s.count() == 0
