import json
import os

from pyspark.sql import functions as F

from scholarq.operators import metadata as M
from scholarq.sources import files as S

SNAPSHOT_LINES = [
    json.dumps({"id": "1", "title": "A", "abstract": "x" * 250, "categories": "cs.AI  math.CO",
                "authors_parsed": [["Doe", "John", ""], ["Roe", "Ann"], ["Doe", "John"]],
                "versions": [{"version": "v1", "created": "c"}, {"version": "v2", "created": "c"}],
                "update_date": "2020-01-05", "doi": "10.1/x", "license": "CC", "journal-ref": "J"}),
    "",                                   # blank line
    "{not json",                          # malformed
    json.dumps({"id": "2", "categories": "cs.AI", "authors_parsed": [["Solo"]],
                "update_date": "2020-13-05", "doi": ""}),          # bad date, empty doi, no versions
    json.dumps({"id": "3", "categories": None, "authors_parsed": None, "versions": None,
                "update_date": "2021-1-5", "license": None}),      # JSON nulls, unpadded date
    json.dumps({"id": "4", "update_date": "", "versions": [{"version": "v1", "created": "c"}]}),  # blank date
    json.dumps({"id": "5"}),              # missing keys
]


def _snapshot(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "snap.json")
    with open(p, "w") as f:
        f.write("\n".join(SNAPSHOT_LINES) + "\n")
    return p


def test_snapshot_skips_blank_and_malformed(spark, tmpdir_path):
    recs, rejects = S.read_snapshot(spark, _snapshot(spark, tmpdir_path))
    assert sorted(r.id for r in recs.collect()) == ["1", "2", "3", "4", "5"]
    assert [r.value for r in rejects.collect()] == ["{not json"]


def test_snapshot_line_limit_counts_bad_lines(spark, tmpdir_path):
    recs, _ = S.read_snapshot(spark, _snapshot(spark, tmpdir_path), limit=4)
    assert sorted(r.id for r in recs.collect()) == ["1", "2"]


def test_metadata_sections(spark, tmpdir_path):
    recs, _ = S.read_snapshot(spark, _snapshot(spark, tmpdir_path))
    out = M.analyse(recs, "all")
    cats = {r.category: r.n for r in out["category_distribution"].collect()}
    assert cats == {"cs.AI": 2, "math.CO": 1}
    assert out["total_categories"].first().total_categories == 2
    authors = {r.author: r.n for r in out["top_authors"].collect()}
    assert authors == {"Doe, John": 2, "Roe, Ann": 1}      # repeat counts twice; 1-part entry skipped
    years = {r.year: r.n for r in out["yearly_distribution"].collect()}
    assert years == {2020: 1, 2021: 1}                      # bad and blank dates skipped
    versions = {r.n_versions: r.n for r in out["version_distribution"].collect()}
    assert versions == {2: 1, 0: 3, 1: 1}
    strict = {r.n_versions: r.n for r in M.version_distribution(recs, strict_skip=True).collect()}
    assert strict == {2: 1, 0: 2, 1: 1}                     # record 2 (bad date) skipped
    b = out["basic_stats"].first()
    assert (b.total_papers, b.papers_with_doi, b.papers_with_license, b.papers_with_journal_ref) == (5, 1, 1, 1)


def test_sections_selector(spark, tmpdir_path):
    recs, _ = S.read_snapshot(spark, _snapshot(spark, tmpdir_path))
    assert set(M.analyse(recs, "time")) == {"yearly_distribution", "version_distribution"}
    share = {r.category: r.pct for r in M.share_of_total(M.category_counts(recs)).collect()}
    assert share == {"cs.AI": 66.67, "math.CO": 33.33}


def test_record_preview_falls_back_to_snapshot(spark, tmpdir_path):
    snap = _snapshot(spark, tmpdir_path)
    rows = S.record_preview(spark, os.path.join(tmpdir_path, "missing.json"), snap).collect()
    first = [r for r in rows if r.id == "1"][0]
    assert first.abstract == "x" * 200 + "..."
    assert [r for r in rows if r.id == "2"][0].abstract == "N/A"


def test_entity_files(spark, tmpdir_path):
    d = os.path.join(tmpdir_path, "Ents")
    os.makedirs(d)
    with open(os.path.join(d, "a.pdf.json"), "w") as f:
        json.dump({"entities": [{"text": "BlockNet", "start_char": 0, "end_char": 8, "label": "ORG"},
                                {"text": "Ann", "start_char": 9, "end_char": 12, "label": "PERSON"}]}, f)
    with open(os.path.join(d, "b.pdf.json"), "w") as f:
        json.dump({"entities": []}, f)
    rows = S.read_entity_files(spark, d).orderBy("mention_no").collect()
    assert [(r.paper_pdf, r.text, r.label) for r in rows] == [("a.pdf", "BlockNet", "ORG"), ("a.pdf", "Ann", "PERSON")]


ATOM = """<?xml version="1.0" encoding="UTF-8"?>
<feed xmlns="http://www.w3.org/2005/Atom" xmlns:opensearch="http://a9.com/-/spec/opensearch/1.1/">
<opensearch:totalResults>42</opensearch:totalResults>
<entry><id>http://arxiv.org/abs/2101.00001v1</id><title>Quantum things</title><summary>Good work.</summary>
<author><name>John Doe</name></author><author><name>Ann Roe</name></author>
<category term="quant-ph"/><category term="cs.AI"/>
<published>2021-01-01T00:00:00Z</published><updated>2021-01-02T00:00:00Z</updated></entry>
<entry><id>http://arxiv.org/abs/2101.00002v2</id><title>Other</title><summary>Bad.</summary>
<author><name>Jane Poe</name></author><category term="cs.LG"/>
<published>2021-02-01T00:00:00Z</published><updated>2021-02-01T00:00:00Z</updated></entry>
</feed>"""


def test_atom_feed(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "feed.xml")
    with open(p, "w") as f:
        f.write(ATOM)
    recs, total = S.read_atom_feed(spark, p)
    rows = {r.arxiv_id: r for r in recs.collect()}
    assert set(rows) == {"2101.00001v1", "2101.00002v2"}
    r = rows["2101.00001v1"]
    assert r.authors == ["John Doe", "Ann Roe"] and r.categories == ["quant-ph", "cs.AI"]
    assert r.pdf_url == "https://arxiv.org/pdf/2101.00001v1.pdf"
    assert total.first().total_results == 42


def test_atom_feed_total_falls_back_to_count(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "feed2.xml")
    with open(p, "w") as f:
        f.write(ATOM.replace("<opensearch:totalResults>42</opensearch:totalResults>", ""))
    _, total = S.read_atom_feed(spark, p)
    assert total.first().total_results == 2


def test_hot_folder_is_written_by_many_tasks(spark, monkeypatch):
    import glob

    from scholarq.plans import q_sources
    paths = []
    monkeypatch.setattr(q_sources, "table", lambda spark, d, name: spark.range(300).repartition(6).select(
        F.when(F.col("id") < 290, "hot").otherwise("cold").alias("source"), F.col("id").alias("doc_id")))
    scratch = q_sources.scratch_path
    monkeypatch.setattr(q_sources, "scratch_path", lambda *a: paths.append(scratch(*a)) or paths[-1])
    got = q_sources.directory_listing(spark, "unused")
    assert sorted(map(tuple, got.collect())) == [("source=cold", 1), ("source=hot", 1)]
    assert len(glob.glob(paths[0].removeprefix("file:") + "/source=hot/part-*")) == 6


def test_first_lines_are_those_of_the_first_files(spark, tmpdir_path):
    lines = []
    for i, n in enumerate((3, 0, 40, 1, 7, 200, 5)):
        own = [json.dumps({"id": f"{i}-{k}"}) if k % 3 else ("" if k % 2 else "{bad") for k in range(n)]
        with open(os.path.join(tmpdir_path, f"part-{i}.json"), "w") as f:
            f.write("".join(x + "\n" for x in own))
        lines += own
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")  # files of one and of several splits
    try:
        numbered = S.numbered_lines(spark.read.text(tmpdir_path)).collect()
        assert [r.value for r in sorted(numbered, key=lambda r: r.line)] == lines
        assert [r.line for r in sorted(numbered, key=lambda r: r.line)] == list(range(1, len(lines) + 1))
        for n in (1, 3, 4, 44, 100, len(lines), 10_000):
            recs, rejects = S.read_snapshot(spark, tmpdir_path, n)
            assert sorted(r.id for r in recs.collect()) == sorted(json.loads(x)["id"] for x in lines[:n] if x.startswith('{"'))
            assert rejects.count() == sum(x == "{bad" for x in lines[:n])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {os.path.basename(f) for f in S.first_lines(spark, tmpdir_path, 2).inputFiles()} == {"part-0.json"}


def test_empty_and_cut_entity_files_are_malformed(spark, tmpdir_path):
    for name, text in (("a.json", '{"entities": []}'), ("b.json", ""), ("c.json", '{"entities": ['), ("d.json", " \n")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    got = S.rejected_entity_files(spark, tmpdir_path).collect()
    assert sorted(map(tuple, got)) == [("b.json", "empty"), ("c.json", "malformed"), ("d.json", "malformed")]


def test_the_later_path_wins_in_a_manifest(spark, tmpdir_path):
    from scholarq.sources.manifest import match_manifest, read_manifest
    for folder, title in (("a", "draft"), ("b", "final")):
        os.makedirs(f"{tmpdir_path}/{folder}")
        with open(f"{tmpdir_path}/{folder}/{'z' if folder == 'a' else 'm'}.csv", "w") as f:
            f.write(f" paper_pdf ,title\nx.pdf,{title}\n")
    manifest = read_manifest(spark, f"{tmpdir_path}/*")
    matched, _ = match_manifest(spark.createDataFrame([("x.pdf",)], "name string"), manifest)
    assert [r.title for r in matched.collect()] == ["final"]


def test_tree_files_hold_many_documents(spark, tmpdir_path):
    trees = [(i, json.dumps({"TYPE": "text", "VALUE": f"line {i}\n\u00e9"})) for i in range(500)] + [(500, None)]
    path = os.path.join(tmpdir_path, "trees")
    S.write_document_trees(spark.createDataFrame(trees, "paper_id long, tree string").coalesce(2), path, "paper_id")
    read = {int(r.paper_pdf): r.tree for r in S.read_document_trees(spark, path, per_line=True).collect()}
    assert read == dict(trees)


def test_tree_scan_writes_few_files(spark, tmpdir_path, monkeypatch):
    from scholarq.plans import q_sources as Q
    docs = [(i, None if i == 7 else f"a {i}\nb\nc") for i in range(300)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(f"{tmpdir_path}/documents.parquet")
    monkeypatch.setattr(Q, "scratch_path", lambda spark, purpose: f"{tmpdir_path}/{purpose}")
    found = {r.paper_id: r.text for r in Q.tree_scan(spark, tmpdir_path).collect()}
    assert found == {i: t or "" for i, t in docs}
    assert sum(f.startswith("part-") for _, _, files in os.walk(f"{tmpdir_path}/trees") for f in files) < 50
