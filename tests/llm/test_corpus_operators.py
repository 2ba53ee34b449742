"""Operators on the whole corpus and the pipeline, against brute force and DuckDB."""

import collections
import random

import duckdb
import numpy as np
import pytest

from scholarq.llm import components, decontamination, ngram_join, partenum, shingles

SF = "/root/testdata/sf0.001"


def words_of(text):
    import re
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(table))


def shingle_set(text):
    w = words_of(text)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(table):
    sets = [shingle_set(t) for _, t in table]
    parent = list(range(len(table)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i in range(len(table)):
        groups[root(i)].append(table[i][0])
    smallest = {r: min((x for x in g if x is not None), default=None) for r, g in groups.items()}
    return sorted(((table[i][0], len(sets[i]), smallest[root(i)] if sets[i] else table[i][0]) for i in range(len(table))), key=repr)


def test_shingles_are_those_of_the_text():
    texts = ["", " ", "a", "A", " a b  c", "a\tb c d e", "é a", "x " * 3000, "a b c d e f a b c d e f"]
    assert [len(s) for s in shingles.shingle_sets([t.encode() for t in texts])] == [len(shingle_set(t)) for t in texts]
    one, two, three = shingles.shingle_sets([b"a", b"A ", b"b"])
    assert one == two != three


@pytest.mark.parametrize("size", [4, 5, 7, 9, 13, 16, 20, 21, 24, 33, 50, 64, 65, 70, 100, 180, 333, 1500])
def test_similar_sets_share_a_signature(size):
    rng = np.random.default_rng(size)
    for _ in range(40):
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        gone, new = int(rng.integers(0, size // 5 + 1)), int(rng.integers(0, size // 4 + 1))
        for g, n in ((gone, new), (size // 5, 0), (0, size // 4), (size // 9, size // 9)):
            b = np.unique(np.concatenate([rng.permutation(a)[g:], rng.integers(0, 2**63, n, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
                continue
            assert len(np.intersect1d(partenum.signatures(a), partenum.signatures(b)))
            x, y = partenum.parity_sketch(a), partenum.parity_sketch(b)
            k = min(len(x), len(y)) // 8
            apart = np.bitwise_count(partenum.folded(x, k) ^ partenum.folded(y, k)).sum()
            assert apart <= len(a) + len(b) - 2 * both <= partenum.most_apart(len(a), len(b))


def planted(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    table, i = [], 0
    passage = rng.choices(vocabulary, k=60)
    for size in (6, 12, 30, 60, 150, 400):
        for _ in range(6):
            text = rng.choices(vocabulary, k=size)
            for _ in range(4):  # near copies with more and more edits, copies of copies
                table.append((i, " ".join(text)))
                i += 1
                text = list(text)
                for _ in range(rng.randint(0, max(1, size // 40))):
                    text[rng.randrange(len(text))] = rng.choice(vocabulary)
    for _ in range(12):  # a passage that clean documents share
        table.append((i, " ".join(rng.choices(vocabulary, k=40) + passage)))
        i += 1
    table += [(i, None), (i + 1, ""), (i + 2, "  \n"), (i + 3, "one"), (i + 4, "ONE "), (i + 5, "one two"), (i + 6, table[3][1]),
              (i + 6, table[3][1]), (None, table[3][1]), (None, "nobody else says this text at all"), (i + 7, "long " * 20000)]
    return table


def test_join_equals_brute_force(spark):
    table = planted()
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in table], "doc_id long, text string, c string, n long").repartition(5)
    got = sorted((tuple(r) for r in ngram_join.join(docs).collect()), key=repr)
    assert got == brute_components(table)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {c for d, _, c in got if d is not None}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want


def test_one_row_of_each_component(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choices([f"v{i}" for i in range(500)], k=60))
    one, two, three, four = text(), text(), text(), text()
    docs = spark.createDataFrame([
        (3, one, 0), (5, one + " more", 1), (5, two, 2), (5, two, 3),  # 5 names one component and is a copy in another
        (None, three, 4), (None, three + " more", 5), (None, three, 6),  # a component without ids
        (None, four, 7), (9, four + " more", 8), (9, four, 9),
        (None, None, 10), (None, " \n", 11), (9, "", 12), (9, "", 13),
    ], "doc_id long, text string, n int").repartition(4)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    of = {0: "one", 1: "one", 2: "two", 3: "two", 4: "three", 5: "three", 6: "three", 7: "four", 8: "four", 9: "four"}
    rows = [(of.get(r["n"], r["n"]), r["doc_id"]) for r in kept.collect()]
    assert sorted(rows, key=repr) == sorted([("one", 3), ("two", 5), ("three", None), ("four", 9),
                                             (10, None), (11, None), (12, 9), (13, 9)], key=repr)


def test_large_groups_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    monkeypatch.setattr(ngram_join, "STAR", 2)
    table = planted(9)
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.join(docs).collect()), key=repr)
    assert got == brute_components(table)


def test_join_of_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_long_paths(spark):
    order = list(range(60))
    random.Random(0).shuffle(order)
    links = list(zip(order, order[1:])) + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(order, 0), 100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_distance(item, words):
    above = [0] * (len(words) + 1)
    for i, x in enumerate(item):
        row = [i + 1]
        for j, y in enumerate(words):
            row.append(min(above[j + 1] + 1, row[j] + 1, above[j] + (x != y)))
        above = row
    return min(above)


def test_exact_distance_equals_the_table():
    rng = random.Random(1)
    for _ in range(400):
        item = [rng.randint(0, 4) for _ in range(rng.randint(1, 90))]
        words = [rng.randint(0, 4) for _ in range(rng.randint(0, 120))]
        assert decontamination.distance_within(item, words)[0] == brute_distance(item, words)


def benchmark_rows():
    return duckdb.connect().execute("SELECT item_id, text FROM read_parquet('/root/testdata/sf0.1/benchmark.parquet')").fetchall()


@pytest.mark.parametrize("rate,least", [(0.0, 1.0), (0.1, 0.98), (0.2, 0.9)])
def test_recall_of_edited_items(rate, least):
    items, rng = benchmark_rows(), random.Random(3)
    block = decontamination.Block(items)
    texts = []
    for _, text in items:
        words = text.split()
        for _ in range(int(rate * len(words) * 0.95)):
            p, kind = rng.randrange(len(words)), rng.random()
            if kind < 0.4:
                words[p] = f"zz{rng.randint(0, 99)}"
            elif kind < 0.7:
                words.insert(p, f"yy{rng.randint(0, 99)}")
            else:
                del words[p]
        other = rng.choice(items)[1].split()[:5]
        texts.append(" ".join(other + words + other).upper().encode())
    found = {h[:2] for h in block.hits(texts)}
    assert sum((i, items[i][0]) in found for i in range(len(items))) >= least * len(items)


def edited(words, count, where, rng):
    """``words`` with ``count`` edits at the front, at the back, in one block in the middle, or anywhere."""
    words = list(words)
    low = {"front": 0, "back": len(words) - count, "block": (len(words) - count) // 2, "spread": 0}[where]
    places = rng.sample(range(len(words)), count) if where == "spread" else range(low, low + count)
    for p in sorted(places, reverse=True):
        kind = rng.randrange(3)
        if kind == 0:
            words[p] = f"zz{rng.randint(0, 99)}"
        elif kind == 1:
            words.insert(p, f"yy{rng.randint(0, 99)}")
        else:
            del words[p]
    return words


@pytest.mark.parametrize("where", ["front", "back", "block"])
def test_edits_may_cluster_anywhere(where):
    rng = random.Random(where)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, rng.choices(vocabulary, k=size)) for i, size in enumerate([15, 16, 20, 32, 40, 59, 100, 200, 400] * 5)]
    block = decontamination.Block([(i, " ".join(words)) for i, words in items])
    other = rng.choices(vocabulary, k=50)
    texts = [" ".join(other + edited(words, int(0.2 * len(words)), where, rng) + other).encode() for _, words in items]
    assert {(i, i) for i, _ in items} <= {h[:2] for h in block.hits(texts)}


@pytest.mark.parametrize("size", [1, 4, 5, 9, 10, 14, 15, 25, 40, 59, 100, 200, 400])
def test_all_items_at_the_full_limit_are_found(size):
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(i, rng.choices(vocabulary, k=size)) for i in range(60)]
    block = decontamination.Block([(i, " ".join(words)) for i, words in items])
    other = rng.choices(vocabulary, k=30)
    texts = [" ".join(other + edited(words, int(0.2 * size), "spread", rng) + other).encode() for _, words in items]
    assert {(i, i) for i, _ in items} <= {h[:2] for h in block.hits(texts)}


def test_hits_equal_brute_force_where_words_repeat():
    rng = random.Random(8)
    for most in (2, 5, 30):
        items = [[f"w{rng.randrange(most)}" for _ in range(rng.randint(1, 40))] for _ in range(40)]
        texts = [[f"w{rng.randrange(most)}" for _ in range(rng.randint(0, 60))] for _ in range(20)]
        texts += [edited(x, int(0.2 * len(x)), rng.choice(["front", "back", "block", "spread"]), rng) for x in items]
        block = decontamination.Block([(i, " ".join(x)) for i, x in enumerate(items)])
        got = {h[:2]: h[2] for h in block.hits([" ".join(x).encode() for x in texts])}
        distances = {(t, i): brute_distance(x, words) for t, words in enumerate(texts) for i, x in enumerate(items)}
        assert got == {at: d for at, d in distances.items() if d <= int(0.2 * len(items[at[1]]))}


def test_contaminated_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.contaminated(docs, benchmark).collect()}
    fold = lambda t: decontamination.folded(t.encode()).split()
    items = [(r["item_id"], fold(r["text"])) for r in benchmark.collect()]
    want = {}
    for r in docs.collect():
        words = fold(r["text"])
        for i, item in items:
            if len(set(item) & set(words)) >= 0.5 * len(set(item)):  # else no run can be near enough
                d = decontamination.distance_within(item, words)[0]
                if d <= int(0.2 * len(item)):
                    want[r["doc_id"], i] = d
    assert want and got == want


def test_contaminated_on_odd_rows(spark, monkeypatch):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (1, "the quick brown fox jumps over the lazy dog"),
                                   (2, None), (3, ""), (4, "word"), (None, "five other words stand here")],
                                  "item_id long, text string")
    docs = spark.createDataFrame([
        (0, None, 1), (1, "", 1), (2, "word", 1), (3, "so THE quick, brown fox jumps over the lazy dog!", 1),
        (None, "five other words stand here", 1), (5, "quick fox", 1), (6, "x " * 50000 + "the quick brown fox jumped over the lazy dog", 1),
    ], "doc_id long, text string, distance int")
    def key(r):
        return (r["doc_id"] is None, r["doc_id"] or 0, r["item_id"] is None, r["item_id"] or 0)
    want = [(2, 4, 0), (3, 1, 0), (3, 1, 0), (6, 1, 1), (6, 1, 1), (None, None, 0)]
    for size in (decontamination.BLOCK_BYTES, 1):  # one block, a block for each item
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = sorted(decontamination.contaminated(docs, items).collect(), key=key)
        assert [(r["doc_id"], r["item_id"], r["distance"]) for r in got] == want
    kept = decontamination.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 5]
    assert decontamination.contaminated(docs.limit(0), items).count() == 0
    assert decontamination.contaminated(docs, items.limit(0)).count() == 0


def test_rows_are_dropped_by_their_own_text(spark, monkeypatch):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "five other words stand here")],
                                  "item_id long, text string")
    bad, worse, clean = "so the quick brown fox jumps over the lazy dog", "five other words stand here", "nothing of the kind"
    docs = spark.createDataFrame([(None, bad, 1), (None, clean, 2), (None, None, 3), (7, worse, 4), (7, clean, 5), (7, clean, 6), (8, bad, 7)],
                                 "doc_id long, text string, n int").repartition(3)
    for size in (decontamination.BLOCK_BYTES, 1):  # one block, a block for each item
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        kept = decontamination.drop_contaminated(docs, items)
        assert kept.schema == docs.schema and sorted(r["n"] for r in kept.collect()) == [2, 3, 5, 6]


def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    from scholarq.llm import quality_rules
    from scholarq.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    states = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        states.append(docs)
        if name != "packing":
            assert docs.columns == columns
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    good = {r[0] for r in con.execute(quality_rules.SQL).fetchall() if r[-1]}
    after = [{r["doc_id"]: r["text"] for r in s.collect()} if "text" in s.columns else None for s in states]
    assert set(after[0]) == good and all(after[0][i] == before[i] for i in good)
    assert set(after[1]) == good
    smallest = {c for _, _, c in brute_components(sorted(after[1].items()))}
    assert set(after[2]) == smallest
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    block = decontamination.Block(items)
    bad = {i for i, t in after[2].items() if block.hits([t.encode()])}
    assert bad and set(after[3]) == set(after[2]) - bad
    assert {r["doc_id"] for r in states[4].collect()} == set(after[3])


def test_last_stages_against_plain_loops(spark):
    import zlib

    import corpus_pipeline
    from scholarq.llm import packing, tokens
    from scholarq.llm.common import stored

    rng, stages = random.Random(12), dict(corpus_pipeline.STAGES)
    items = [decontamination.folded(r["text"].encode()).split() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    filler = " ".join(rows[0][1].split()[:40])
    for k, item in enumerate(items):
        words = edited([w.decode() for w in item], int(0.2 * len(item)), ["front", "back", "block", "spread"][k % 4], rng)
        rows.append((1000 + k, f"{filler} {' '.join(words)} {filler}"))
    rows += [(None, filler), (None, None), (None, rows[70][1]), (3, rows[71][1])]

    def clean(text):
        words = decontamination.folded((text or "").encode()).split()
        return all(decontamination.distance_within(x, words)[0] > int(0.2 * len(x)) for x in items)

    left = [r for r in rows if clean(r[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    docs = stored(stages["benchmark_decontamination"](spark, docs, SF), "test-stage")
    assert len(rows) - len(left) >= len(items) and sorted(map(tuple, docs.collect()), key=repr) == sorted(left, key=repr)

    library = tokens.tokenizer(tokens.vocabulary_path())
    want = collections.defaultdict(list)
    for i, text in left:
        want[i].append(np.asarray(library.encode(text or "", add_special_tokens=False).ids + [packing.END_ID], "<u4"))
    sequences, covered, got = collections.defaultdict(list), collections.Counter(), stages["packing"](spark, docs, SF).collect()
    for r in got:
        cut = slice(r["start"], r["start"] + r["length"])
        fits = [k for k, ids in enumerate(want[r["doc_id"]]) if len(ids) == r["doc_tokens"] and zlib.crc32(ids[cut].tobytes()) == r["ids_crc32"]]
        assert len(fits) == 1  # texts under one id differ
        covered.update((r["doc_id"], fits[0], t) for t in range(cut.start, cut.stop))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert covered == collections.Counter((i, k, t) for i, texts in want.items() for k, ids in enumerate(texts) for t in range(len(ids)))
    for pieces in sequences.values():
        ends = np.cumsum([n for _, n in sorted(pieces)])
        assert [at for at, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY


def test_pipeline_of_empty_table(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
