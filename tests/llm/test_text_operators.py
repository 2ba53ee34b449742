"""Operators on single texts and lines, against brute force and DuckDB."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from scholarq.llm import chat_format, language_id, line_dedup, packing, pii, quality_rules, sharding, token_counts, tokens

ODD = [
    (0, None, "x", None), (1, "", "x", "a"), (2, " \t\n ", None, "a"), (3, "word", "x", "a"),
    (4, "A line that is long enough to count\nB\n\nA line that is long enough to count", "y", "b"),
    (5, "  a LINE that is long enough to count \nother", "y", "b"), (6, "a line that is long enough to count", "y", "b"),
    (6, "a line that is long enough to count", "y", "b"), (None, "a line that is long enough to count", "z", "c"),
    (7, "very long " * 20000, "z", "c"), (8, "one two three " * 30, "z", "c"),
    (9, "mail me.x@host.example.com or +1 (555) 555-0100, card 4111 1111 1111 1111 from 10.0.0.1", "z", "c"),
]
SCHEMA = "doc_id long, text string, h1 string, __pos string"  # two columns with clashing names


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(a, b, c, d) for a, b, c, d in ODD]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(sql, tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.execute(sql).fetchall()


def as_arrow(table, names):
    import pyarrow as pa
    kinds = {"doc_id": pa.int64()}
    return pa.table({n: pa.array([r[i] for r in table], kinds.get(n, pa.string())) for i, n in enumerate(names)})


def test_quality_matches_sql_on_odd_rows(spark, odd):
    got = rows(quality_rules.score(odd.select("doc_id", "text")))
    want = duck(quality_rules.SQL, {"documents": as_arrow([r[:2] for r in ODD], ["doc_id", "text"])})
    assert got == sorted(want, key=repr)


def test_quality_order_does_not_change_the_verdict(spark, odd):
    from pyspark.sql import functions as F
    rules = quality_rules.default_rules(F.col("text"))
    kept = [rows(odd.filter(quality_rules.cascade(order)).select("doc_id")) for order in (rules, rules[::-1])]
    assert kept[0] == kept[1]
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_quality_order_is_stable_and_follows_rejection_per_cost(spark):
    from pyspark.sql import functions as F
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality_rules.default_rules(F.col("text"))
    orders = {tuple(r.name for r in quality_rules.order_rules(docs, rules, 400)) for _ in range(3)}
    assert len(orders) == 1
    # all shout, none is short: the dear rules that reject nothing come last
    loud = spark.createDataFrame([("WORDS ARE HERE AND MORE " * 3 + " ".join(f"NR{chr(65 + i % 26)}{chr(65 + i // 26)}" for i in range(60)),)] * 30, "text string")
    assert [r.name for r in quality_rules.order_rules(loud, rules)][0] == "shouting"
    short = spark.createDataFrame([("only four words here",)] * 30, "text string")
    order = [r.name for r in quality_rules.order_rules(short, rules)]
    assert order[0] == "few_words" and order[-1] == "repeated_windows"
    assert quality_rules.order_rules(short, []) == []


def test_quality_verdicts_agree_and_columns_may_clash(spark):
    names = ["n_words", "words", "chars", "kept", "rejects", "texts", "x"]
    docs = spark.createDataFrame([(r[0], r[1], *names) for r in ODD], f"doc_id long, text string, {', '.join(n + ' string' for n in names)}")
    scored = quality_rules.score(docs)
    assert [c for c in scored.columns if c not in ("doc_id", "kept")] == [
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert rows(kept.select("doc_id")) == rows(scored.filter("kept").select("doc_id"))
    long = spark.createDataFrame([(1, " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{i % 7}" for i in range(200_000)), "n")],
                                 "doc_id long, text string, n_words string")
    assert rows(quality_rules.keep_good(long).select("doc_id")) == rows(quality_rules.score(long).filter("kept").select("doc_id"))


def test_quality_of_empty_table(empty):
    assert quality_rules.score(empty).count() == 0
    assert quality_rules.keep_good(empty).count() == 0


def test_line_dedup_matches_sql_on_odd_rows(spark, odd):
    table = [r for r in ODD if r[0] is not None]
    docs = spark.createDataFrame(table, SCHEMA)
    got = rows(line_dedup.digests(docs))
    want = duck(line_dedup.SQL, {"documents": as_arrow([r[:2] for r in table], ["doc_id", "text"])})
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_line_dedup_does_not_depend_on_batches(spark, odd, batches, fanout):
    got = rows(line_dedup.drop_repeated_lines(odd, batches=batches, fanout=fanout))
    texts = {r[0]: r[1] for r in got if r[0] is not None}
    assert texts[6] == "a line that is long enough to count"  # the largest id keeps it
    assert texts[5] == "other" and texts[4] == "B\n"
    assert [r[1] for r in got if r[0] is None] == [""]  # a null id ranks below all
    assert line_dedup.drop_repeated_lines(odd).columns == odd.columns


def test_runs_are_compacted(spark):
    docs = spark.createDataFrame([(i, f"this is a line of its own {i}") for i in range(50)], "doc_id long, text string")
    runs = line_dedup.build_runs(docs, batches=7, fanout=2)
    assert sum(len(level) for level in runs.levels.values()) <= 3
    assert runs.rows().count() == 50


def test_line_dedup_of_empty_table(empty):
    assert line_dedup.digests(empty).count() == 0


@pytest.mark.parametrize("dims,bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_neighbours(spark, dims, bits):
    from pyspark.sql import functions as F
    names = [f"c{i}" for i in range(dims)]
    grid = spark.range((1 << bits) ** dims).select(
        *[((F.col("id") / (1 << bits) ** i).cast("long") % (1 << bits)).alias(n) for i, n in enumerate(names)])
    cells = grid.withColumn("h", sharding.hilbert_index([F.col(n) for n in names], bits)).orderBy("h").collect()
    assert [r["h"] for r in cells] == list(range(len(cells)))
    assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(cells, cells[1:]))


def test_sharding_laws(spark, odd):
    docs = odd.withColumnRenamed("h1", "source").selectExpr("*", "length(text) as n_chars")
    got = sharding.places(docs).collect()
    assert len(got) == len(ODD)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(by_shard[k]) for k in range(40)]
    assert max(sizes) - min(sizes) <= 1
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _, _ in ODD)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want


def test_shard_files_prune_and_hold_all_rows(spark, tmpdir_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dims = ["source", "n_chars", "doc_id"]
    sharding.write_shards(docs, f"{tmpdir_path}/shards", dims, shards=20)
    out = spark.read.parquet(f"{tmpdir_path}/shards")
    assert rows(out.select(*docs.columns)) == rows(docs)
    # A range on one dimension touches fewer shards than rows dealt at random would.
    low, high = docs.approxQuantile("n_chars", [0.9, 1.0], 0.0)
    assert out.filter(f"n_chars >= {low}").select("shard").distinct().count() < 12
    assert sharding.assign(docs.limit(0), dims).count() == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, shape in BASE.items():
        for m in re.finditer(shape, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base_spans_equal_the_plain_patterns():
    rng = random.Random(2)
    parts = ["1", "2", "25", "0", ".", " ", "-", "+", "@", "a", "b.c", "(", ")", "4111111111111111", "é", "account ", "\n", "://"]
    for _ in range(20000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == base_spans(text), text


def test_pii_further_kinds_and_validation():
    text = "see https://example.com/a?b=1. IBAN: DE89 3704 0044 0532 0130 00, account no. 12345678, iban DE00370400440532013000"
    found = {(k, text[s:e]) for k, s, e in pii.find(text)}
    assert ("url", "https://example.com/a?b=1") in found
    assert ("account", "DE89 3704 0044 0532 0130 00") in found and ("account", "12345678") in found
    assert not any(t.startswith("DE00") for _, t in found)


def test_pii_query_on_odd_rows(odd, empty):
    got = {r["doc_id"]: r for r in pii.digests(odd).collect()}
    assert (got[9]["n_email"], got[9]["n_ip"], got[9]["n_card"], got[9]["n_phone"]) == (1, 1, 1, 1)
    text = dict(r[:2] for r in ODD)[9]
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base_spans(text))
    assert got[9]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
    assert got[0]["spans"] == "" and got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.digests(empty).count() == 0


def library():
    return tokens.tokenizer(tokens.vocabulary_path())


def random_texts(n, seed=3):
    rng = random.Random(seed)
    signs = "ab'sStTé ß́  \x1c\x85İΣς½ 12٣..,,''|<>!&#\n\t日本語​😀ªµºǅK"
    odd = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return odd + ["x <|endoftext|> y", "<|startoftext|>", "", "don't we'll I'M", "a<|endoftext|>b"]


def test_cached_tokens_equal_the_library():
    texts = random_texts(5000)
    want = library().encode_batch(texts, add_special_tokens=False)
    for entries in (tokens.CACHE_ENTRIES, 50):
        got = tokens.ChunkCache(tokens.vocabulary_path(), entries).encode([t.encode() for t in texts])
        assert [np.asarray(e.ids, "<u4").tobytes() for e in want] == got


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (100, 10), (37, 1)])
def test_spliced_tokens_equal_the_library(chunk, overlap):
    t, rng = library(), random.Random(chunk)
    for text in random_texts(60, chunk):
        text = text * rng.randint(1, 8)
        if rng.random() < 0.2:
            text = re.sub(r"\s", "", text)  # no stable boundary anywhere
        got = np.concatenate(list(token_counts.encode_long(t, text, chunk, overlap))).tolist()
        assert got == t.encode(text, add_special_tokens=False).ids


def test_token_counts_on_odd_rows(odd, empty):
    got = rows(token_counts.counts(odd))
    t = library()
    want = [(i, len((x or "").encode()), len(ids := t.encode(x or "", add_special_tokens=False).ids), len(ids) > 2048)
            for i, x, _, _ in ODD]
    assert got == sorted(want, key=repr)
    assert token_counts.counts(empty).count() == 0


def test_packing_holds_each_token_once(odd, empty):
    t = library()
    got = packing.pieces(odd).collect()
    want = {i: np.asarray(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4") for i, x, _, _ in ODD}
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    copies = collections.Counter(i for i, *_ in ODD)
    for i, ids in want.items():
        assert sum(n for _, n in by_doc[i]) == copies[i] * len(ids)
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048
    assert packing.pieces(empty).count() == 0


def test_packing_wastes_little_and_balances_cost():
    rng = random.Random(1)
    lengths = [rng.randint(1, 5000) for _ in range(2000)]
    placed = packing.place(lengths, 2048)
    sequences = collections.defaultdict(list)
    for item, start, n, k, offset in placed:
        sequences[k].append(n)
    assert len(sequences) * 2048 - sum(lengths) < 2048
    mixed = [sum(map(packing.cost, v)) for v in sequences.values() if len(v) > 1]
    plain = 2048 + 2048 * 2048 / packing.EVEN_LENGTH
    assert max(mixed) <= plain and min(mixed) > 0.4 * plain


def test_language_id_learns_only_outside_the_fold(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language_id.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)
    own = odd.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in language_id.predictions(own).collect()} == {"und"}  # nothing to learn from
    one = odd.selectExpr("doc_id", "text", "if(doc_id in (7, 8), 'en', null) as lang")
    pred = {r["doc_id"]: r["lang_pred"] for r in language_id.predictions(one).collect()}
    assert pred[0] == "und" and pred[2] == "und" and pred[3] == "en"
    assert language_id.predictions(empty).count() == 0


SIGNS = ["\\", "#", "###", "</turn>", "<", "/turn>", ":", "\n", ": ", "a", " ", "é", "😀", "### assistant:\n", chat_format.PROBE]


def test_chat_rendering_round_trips():
    rng = random.Random(1)
    t = chat_format.tokenizer(chat_format.vocabulary_path(chat_format.VOCABULARY))
    t.encode_special_tokens = True
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "a:\nb", "", " :"]), "".join(rng.choices(SIGNS, k=rng.randint(0, 9))))
                 for _ in range(rng.randint(1, 5))]
        text, spans = chat_format.render(turns)
        assert chat_format.parse(text) == turns
        offsets = np.asarray(t.encode(text, add_special_tokens=False).offsets, dtype=np.int64).reshape(-1, 2)
        mask, shared = chat_format.intersect(offsets, spans)
        assert shared == spans
        touched = [any(s < e2 and s2 < e for s2, e2 in spans) for s, e in offsets.tolist()]
        assert mask.tolist() == touched


def test_chat_query_on_odd_rows(spark):
    table = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 2, None, "x"), (2, 0, "assistant", "a" * 30000),
             (2, 0, "assistant", "a" * 30000), (3, None, "assistant", "b"), (3, 0, "user", "é 😀"), (4, 0, "system", "s")]
    source = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    source = source.selectExpr("*", "1 as ids", "'x' as turns")  # clashing names
    got = rows(chat_format.digests(chat_format.format_conversations(chat_format.with_probe(source))))
    import pyarrow as pa
    columns = list(zip(*table))
    frame = pa.table({n: pa.array(c, k) for n, c, k in zip(
        ["conv_id", "turn", "role", "text"], columns, [pa.int64(), pa.int64(), pa.string(), pa.string()])})
    want = duck(chat_format.SQL.replace("ORDER BY turn", "ORDER BY turn NULLS FIRST"), {"conversations": frame})
    assert got == sorted(want, key=repr)
    formatted = chat_format.format_conversations(source).filter("conv_id = 2").first()
    assert len(formatted["ids"]) == len(formatted["loss_mask"]) and any(formatted["loss_mask"])
    assert chat_format.format_conversations(source.limit(0)).count() == 0


def test_the_batch_that_brings_a_line_holds_it_and_a_store_can_be_reopened(spark, tmp_path):
    """Later batches have larger documents here: only the anti-join against the runs keeps the first holder."""
    from scholarq.llm.line_dedup import LineRuns
    def batch(rows):
        return spark.createDataFrame(rows, "h1 long, h2 long, n_docs long, top_doc long")
    folder = str(tmp_path / "runs")
    runs = LineRuns(spark, folder, fanout=2)
    runs.ingest(batch([(1, 1, 1, 5), (2, 2, 4, 6), (3, 3, 1, None)]))
    runs.ingest(batch([(1, 1, 1, 50), (4, 4, 1, 51), (3, 3, 2, 52)]))
    runs.ingest(batch([(1, 1, 1, 500), (4, 4, 1, 501)]))
    want = {(1, 1, 5), (2, 2, 6), (3, 3, None)}
    assert set(map(tuple, runs.frequent(3).collect())) == want
    assert {level: len(paths) for level, paths in runs.levels.items() if paths} == {0: 1, 1: 1}

    again = LineRuns(spark, folder, fanout=2)  # another session
    assert {level: sorted(p) for level, p in again.levels.items() if p} == {level: sorted(p) for level, p in runs.levels.items() if p}
    again.ingest(batch([(4, 4, 1, 5000), (5, 5, 9, 5001)]))
    assert set(map(tuple, again.frequent(3).collect())) == want | {(4, 4, 51), (5, 5, 5001)}
    assert {level: len(paths) for level, paths in again.levels.items() if paths} == {2: 1}
    # a compacted run that was not removed does not count
    again.rows().write.parquet(f"{folder}/level-0-batches-1-1")
    assert set(map(tuple, LineRuns(spark, folder, fanout=2).frequent(3).collect())) == want | {(4, 4, 51), (5, 5, 5001)}


@pytest.mark.parametrize("part", ["a://", "a@b.c x://y ", "a://b.c ", "account 12345678 ", "x@y.zz://q,"])
def test_personal_data_takes_linear_time(part):
    import time

    def seconds(n):
        text, best = part * (n // len(part)), 1e9
        for _ in range(3):
            began = time.process_time()
            pii.find(text)
            best = min(best, time.process_time() - began)
        return best

    assert seconds(300_000) <= 15 * seconds(30_000)
