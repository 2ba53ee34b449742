import json
import os

from scholarq.streaming.ingest import entities_table, links_table, merge_mentions, rejects_table, start_entity_ingest


def _write(d, name, ents):
    with open(os.path.join(d, name), "w") as f:
        json.dump({"entities": [{"text": t, "start_char": 0, "end_char": len(t), "label": lab} for t, lab in ents]}, f)


def test_incremental_ingest_is_idempotent(spark, tmpdir_path):
    ents = os.path.join(tmpdir_path, "Ents")
    os.makedirs(ents)
    papers = spark.createDataFrame([(1, "Ents/a.pdf.json"), (2, "Ents/b.pdf.json")],
                                   "paper_id long, paper_entities string")
    root, cp = os.path.join(tmpdir_path, "tables"), os.path.join(tmpdir_path, "cp")
    _write(ents, "a.pdf.json", [("Acme", "ORG"), ("Acme", "ORG"), ("Ann", "PERSON")])
    _write(ents, "x.pdf.json", [("Zed", "PERSON")])            # no paper: goes to rejected_files
    start_entity_ingest(spark, ents, papers, root, cp).awaitTermination()
    phe, ent = links_table(spark, root), entities_table(spark, root)
    assert sorted(r["count"] for r in phe.read().collect()) == [1, 2]
    assert ent.read().count() == 2
    v = phe.current_version()
    start_entity_ingest(spark, ents, papers, root, cp).awaitTermination()   # nothing new
    assert phe.current_version() == v
    _write(ents, "b.pdf.json", [("Acme", "ORG")])
    start_entity_ingest(spark, ents, papers, root, cp).awaitTermination()
    rows = sorted((r.paper_id, r["count"]) for r in phe.read().collect())
    assert rows == [(1, 1), (1, 2), (2, 1)]
    assert ent.read().count() == 2                              # Acme not duplicated
    with open(os.path.join(ents, "c.json"), "w") as f:           # a new name, so the source sees it
        f.write('{"entities": [{"text": "Acme", "sta')
    with open(os.path.join(ents, "sub-a.pdf.json"), "w") as f:
        f.write("[]")
    start_entity_ingest(spark, ents, papers, root, cp).awaitTermination()
    assert sorted((r.paper_id, r["count"]) for r in phe.read().collect()) == rows
    assert sorted(map(tuple, rejects_table(spark, root).read().collect())) == [
        ("c.json", "malformed"), ("sub-a.pdf.json", "malformed"), ("x.pdf.json", "no such paper")]


def test_truncated_file_keeps_links_and_empty_list_clears_them(spark, tmpdir_path):
    papers = spark.createDataFrame([(1, "Ents/a.pdf.json")], "paper_id long, paper_entities string")
    e, p, r = (t(spark, tmpdir_path) for t in (entities_table, links_table, rejects_table))
    from scholarq.sources.files import parse_entity_records
    left = []
    for text in ('{"entities": [{"text": "Acme", "label": "ORG"}]}', '{"entities": [{"text": "Ac', '{"entities": null}', '{"entities": []}'):
        raw = spark.createDataFrame([("a.pdf.json", text)], "file_name string, value string")
        merge_mentions(parse_entity_records(raw), papers, e, p, r)
        left.append(p.read().count())
    assert left == [1, 1, 1, 0]
    assert r.read().count() == 1  # one file, one reason
