"""Suffix-array dedup, ranked search and importance resampling, against brute force and DuckDB."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from scholarq.llm import importance, queries, ranked_search, suffix_dedup
from scholarq.llm.suffix_dedup import LENGTH

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_kept(texts):
    """(n_bytes, spans, kept) of each text: every window of LENGTH bytes counted."""
    rows = [(t or "").encode() for t in texts]
    count = collections.Counter(r[i:i + LENGTH] for r in rows for i in range(len(r) - LENGTH + 1))
    out = []
    for r in rows:
        gone = np.zeros(len(r) + 1, dtype=np.int8)
        for i in range(len(r) - LENGTH + 1):
            if count[r[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = 1
        edges = np.flatnonzero(np.diff(np.append(0, gone)))
        spans = [tuple(x) for x in edges.reshape(-1, 2).tolist()]
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def got_kept(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(suffix_dedup.kept(docs.repartition(5), **options).collect(), key=lambda r: r["doc_id"])
    return [(r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows]


def awkward_texts(seed=3):
    rng = random.Random(seed)
    letters = lambda n, a="abcdefghij é": "".join(rng.choices(a, k=n))
    base, other = letters(900), letters(400)
    texts = [None, "", "x", "a" * 199, "a" * 200, "a" * 201, "a" * 700, "ab" * 300, "abc" * 200 + "d", letters(199)]
    texts += [base, base, base[:450] + "#" + base[450:], base[100:299], base[100:300], base[100:301], "<" + base[100:301] + ">"]
    # one passage in many surroundings, cut at many places: groups with several suffixes that share more and less on either side
    for _ in range(40):
        a, b = sorted(rng.sample(range(401), 2))
        texts.append(letters(rng.randrange(60)) + other[a:b] + letters(rng.randrange(60)))
    texts += [other[150:] + base[:250] + other[:250], other + other, letters(300, "ab"), letters(300, "ab") * 2]
    return texts


def test_repeated_strings_are_those_of_brute_force(spark):
    texts = awkward_texts()
    want = brute_kept(texts)
    assert got_kept(spark, texts) == want
    assert sum(bool(s) for _, s, _ in want) > 20 and sum(not s for n, s, _ in want if n >= LENGTH) > 5


def test_large_groups_are_counted_to_the_same_result(spark):
    texts = awkward_texts(5)
    assert got_kept(spark, texts, most_contexts=1) == brute_kept(texts)


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choices("abcd ", k=5000))
    text = (text + text[1000:1900] + "zzzz" + text[4000:4300]).encode()
    for size in (300, 1000, 1 << 18):
        starts = set()
        for offset in range(0, len(text) - LENGTH + 1, size):
            own, at, low, high, gram, context = suffix_dedup.anchors([text[offset:offset + size + LENGTH - 1]])
            starts |= {s for a, lo, hi in zip((at + offset).tolist(), low.tolist(), high.tolist()) for s in range(a - hi, a - lo + 1)}
        assert starts == set(range(len(text) - LENGTH + 1))


def test_anchors_depend_on_the_window_only():
    rng = random.Random(2)
    shared = "".join(rng.choices("abc", k=600)).encode()
    found = []
    for before in (b"", b"xyz" * 31, b"c" * 500):
        own, at, low, high, gram, context = suffix_dedup.anchors([b"q" * 300, before + shared])
        places = {}
        for p, a, lo, hi in zip(own.tolist(), at.tolist(), low.tolist(), high.tolist()):
            if p == 1:
                places |= {a - k - len(before): a - len(before) for k in range(lo, hi + 1)}
        found.append({s: a for s, a in places.items() if s >= 0})
    assert found[0] == found[1] == found[2] and len(found[0]) == 401


@pytest.mark.parametrize("base", [1, 0x9E3779B97F4A7C15])
def test_suffix_order_and_common_bytes_with_and_without_collisions(base):
    """With base 1 a hash is the sum of the bytes, so that permutations collide: the verification has to notice."""
    rng = random.Random(base)
    groups = [["".join(rng.choices("ab", k=40)) for _ in range(m)] for m in (1, 2, 3, 7, 16, 33)]
    groups.append(["ab" * 20, "ba" * 20, "ab" * 20, "a" * 40, "a" * 39 + "b"])
    rows = [(x, rng.randrange(0, 20)) for g in groups for x in g]
    data = np.frombuffer("".join(x for x, _ in rows).encode(), dtype=np.uint8)
    left = np.array([k for _, k in rows])
    at = np.arange(len(rows)) * 40 + left
    s = suffix_dedup.Suffixes(data, at, left, 40 - left, suffix_dedup.Powers(base))
    size = np.array([len(g) for g in groups])
    begin, group = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    for way in (1, -1):
        order = s.sorted(begin, size, way)
        shared = s.shared(order, group, way)
        for b, m in zip(begin.tolist(), size.tolist()):
            texts = [s._bytes(int(x), way) for x in order[b:b + m]]
            assert sorted(order[b:b + m].tolist()) == list(range(b, b + m)) and texts == sorted(texts)
            for i in range(m - 1):
                x, y = texts[i], texts[i + 1]
                assert shared[b + i] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert shared[b + m - 1] == 0


def test_suffix_dedup_query_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (n, n - len(k), len(s), hashlib.sha256(k).hexdigest())
            for r, (n, s, k) in zip(docs, brute_kept([r["text"] for r in docs]), strict=True)}
    got = queries.op12_suffix_array_dedup(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(docs)


def test_suffix_dedup_reads_id_and_text_only_and_takes_odd_tables(spark):
    rows = [(None, "q" * 150 + "w" * 150, 1, 2), (None, "q" * 150 + "w" * 150, 1, 2), (7, None, 1, 2), (7, "", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, d1 int, spans int")
    got = sorted((tuple(r) for r in suffix_dedup.digests(docs).collect()), key=repr)
    none = hashlib.sha256(b"").hexdigest()
    assert got == sorted([(7, 0, 0, 0, none)] * 2 + [(None, 300, 300, 1, none)] * 2, key=repr)
    assert suffix_dedup.digests(docs.limit(0)).collect() == []


def brute_search(docs, items, k):
    words = [re.findall(ranked_search.TERM, (t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(map(bool, words)), sum(map(len, words))
    tf = [collections.Counter(w) for w in words]
    df = collections.Counter(t for c in tf for t in c)
    out = []
    for item, text in items:
        own = set(re.findall(ranked_search.TERM, (text or "").translate(LOWER)))
        scores = []
        for (doc, _), c, w in zip(docs, tf, words):
            if w:
                m = 50 + 50 * len(w) * n // total
                scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                                    for t in own if t in c), -1 if doc is None else doc))
        best = [s for s in sorted(scores) if s[0] < 0][:k]
        out += [(item, r, None if d < 0 else d, -s) for r, (s, d) in enumerate(best, 1)]
    return sorted(out, key=repr)


def search_tables(seed=1, n=700):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["é1", "Ünder", "x-y"]
    text = lambda k: " ".join(vocabulary[min(302, int(rng.expovariate(0.02)))] for _ in range(k))
    docs = [(rng.choice([i, i, None, 5]), text(rng.choice([0, 1, 5, 40, 300]))) for i in range(n)]
    docs += [(10_000 + i, "Same TEXT w1") for i in range(90)] + [(20_000, None), (20_001, "--- \n"), (20_002, "w1 " * 3000)]
    items = [(i, text(rng.choice([1, 3, 20]))) for i in range(30)] + [(31, None), (32, ""), (33, "same text"), (33, "same text"), (None, "w1 unknown")]
    return docs, items


@pytest.mark.parametrize("k, sample, trees", [(50, 100, 4096), (3, 0, 20), (1000, 0, 4096)])
def test_ranked_search_is_that_of_brute_force(spark, monkeypatch, k, sample, trees):
    monkeypatch.setattr(ranked_search, "TREE_TERMS", trees)
    docs, items = search_tables()
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
                               spark.createDataFrame(items, "item_id long, text string"), k, sample_rows=sample)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search(docs, items, k)


def test_ranked_search_prunes_whole_batches():
    rng = np.random.default_rng(5)
    topics = [[f"t{t}x{i}".encode() for i in range(40)] for t in range(8)]
    texts = [b" ".join(rng.choice(topics[int(rng.integers(8))], 30)) for _ in range(4000)]
    items = ranked_search.Items([(i, b" ".join(topics[i % 8][:20]).decode()) for i in range(16)])
    import pyarrow as pa
    blobs = []
    for text in texts:
        found = collections.Counter(items.vocabulary[w] for w in text.split() if w in items.vocabulary)
        blobs.append(np.array(sorted(found.items()), dtype=np.uint32).reshape(-1, 2).tobytes())
    corpus = object.__new__(ranked_search.Corpus)
    corpus.documents, corpus.terms, corpus.weights = 4000, 120_000, np.full(len(items.vocabulary), 2000)
    search = ranked_search.Search(items, corpus, np.zeros(16, dtype=np.int64), 10)
    scored = search.add(pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array([30] * 4000), pa.array(blobs, pa.binary())], ["a", "b", "c"]))
    assert scored < 0.25 * 16 * 4000
    assert len(search.results()) == 160


def test_ranked_search_of_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, "z")], "doc_id int, text string, n int, terms string")
    items = spark.createDataFrame([(4, "B", 1)], "item_id int, text string, item int")
    w = math.floor(1000 * math.log(4 / 3))
    assert [tuple(r) for r in ranked_search.search(docs, items).collect()] == [(4, 1, 1, w * (10**9 // (1000 + 20 * 100)))]
    assert ranked_search.search(docs.limit(0), items).collect() == []
    assert ranked_search.search(docs, items.limit(0)).collect() == []


def brute_resample(docs, target, most=1, least=20, percent=10, buckets=10_000):
    def features(text):
        words = re.findall(importance.WORD, (text or "").translate(LOWER))
        return len(words), [" ".join(words[i:i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]

    def histogram(rows):
        return collections.Counter(zlib.crc32(f.encode()) % buckets for _, fs in rows for f in fs)

    rows = [features(t) for _, t in docs]
    s, t = histogram(rows), histogram([features(x) for x in target])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    out = []
    for (doc, _), (n, fs) in zip(docs, rows):
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in fs)
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("most", [1, 3])
def test_resampling_is_that_of_brute_force(spark, monkeypatch, most):
    rng = random.Random(most)
    vocabulary = ["Apple", "B2", "été", "naïve", "c_d", "x" * 30, "ZÜ", "1", " ", "the"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", "-", "\n", "\x00", "{"]) for _ in range(n))
    docs = [(i if rng.random() < 0.9 else None, text(rng.choice([0, 5, 19, 20, 21, 80]))) for i in range(300)]
    docs += [(1, None), (1, ""), (2, " - "), (3, text(4000)), (3, docs[0][1]), (3, docs[0][1])]
    target = [text(30), None, "", "the the apple"]
    monkeypatch.setattr(importance, "PIECE_CHARS", 500)
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                              spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int"), most_words=most).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_resample(docs, target, most)


def test_pieces_end_between_words():
    for n in (1, 10, 1 << 16):
        text = "ab cd,ef" * 40 + "x" * 300 + " yz"
        importance_pieces = []
        old, importance.PIECE_CHARS = importance.PIECE_CHARS, n
        try:
            importance_pieces = list(importance.pieces(text))
        finally:
            importance.PIECE_CHARS = old
        assert "".join(importance_pieces) == text
        assert [w for p in importance_pieces for w in re.findall(importance.WORD, p)] == re.findall(importance.WORD, text)


def test_resampling_of_empty_tables_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 20, 3, "z")], "doc_id int, text string, place int, row string")
    target = spark.createDataFrame([("a",)], "text string")
    assert importance.resample(docs, target).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    got = [tuple(r) for r in importance.resample(docs, target, percent=100).collect()]
    assert got[0][:2] == (1, 40) and got[0][4] == 1
    assert importance.resample(docs.limit(0), target).collect() == []
    assert importance.resample(docs, target.limit(0), percent=100).collect()[0]["rank"] == 1


@pytest.mark.parametrize("name", ["op11_ranked_lexical_search", "op13_importance_resampling"])
def test_queries_match_duckdb(spark, name):
    from tools.check_oracle import digest
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF), con.execute(queries.ORACLE_SQL[name])
    assert digest(got.columns, [tuple(r) for r in got.collect()])[0] == digest([c[0] for c in want.description], want.fetchall())[0]
