"""Learned sentence boundaries against a plain re-statement and on known sentences."""

import math
import random
from collections import Counter

import pytest
import regex

from scholarq.operators import boundaries as B

WORD = r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"


def plain_abbreviations(texts):
    dot, bare = Counter(), Counter()
    for t in texts:
        for m in regex.finditer(f"({WORD})(\\.?)", t.lower()):
            (dot if m[2] else bare)[m[1]] += 1
    dots, n = sum(dot.values()), sum(dot.values()) + sum(bare.values())
    found = {}
    for w, k in dot.items():
        if dots == n or not regex.search(r"\p{L}", w):
            continue
        p = dots / n
        ratio = -2 * ((k * math.log(p) + bare[w] * math.log(1 - p)) - (k * math.log(0.99) + bare[w] * math.log(1 - 0.99)))
        size = len(w.replace(".", ""))
        score = ratio * math.exp(-size) * (w.count(".") + 1) * size ** -bare[w]
        if score >= 0.3:
            found[w] = (k, bare[w], round(score, 6))
    return found


def plain_split(text, short, starters):
    sentences, now = [], ""
    cut = [p for p in regex.split("\x01", regex.sub(r"([.!?]\s+)", "\\1\x01", text or "")) if p]
    for i, piece in enumerate(cut):
        now += piece
        nxt = cut[i + 1] if i + 1 < len(cut) else None
        m = regex.search(f"({WORD})\\.\\s+$", piece)
        start = regex.match(WORD, nxt) if nxt is not None else None
        word = start[0] if start else ""
        end = True
        if m and nxt is not None:
            last = m[1]
            if regex.fullmatch(r"\p{N}+", last) and regex.match(r"\p{Ll}", word):
                end = False
            elif last.lower() in short or regex.fullmatch(r"\p{Lu}", last):
                end = word.lower() in starters and bool(regex.match(r"\p{Lu}", word))
        if end:
            sentences.append(now)
            now = ""
    return [s.strip() for s in [*sentences, now] if s.strip()]


def corpus(rnd, n):
    nouns = ["paper", "result", "method", "lemma", "table", "graph", "proof", "bound", "kernel", "sample"]
    out = []
    for i in range(n):
        a, b, c = (rnd.choice(nouns) for _ in range(3))
        out.append(rnd.choice([
            f"The {a} of Dr. Lee et al. shows a {b}. The {c} holds.", f"We cite Dr. A. Moss, e.g. the {a}. The {b} is old!",
            f"See fig. 3. und the {a} on the {b}. The {c} fails? It does.", f"A {a} and a {b} give the {c}. The fig. 2 tells so.",
            f"This holds so and does it, so the {a} holds. The {b} does, too, and fails or is old or tells a {c}."]))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    texts = corpus(random.Random(1), 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    return texts, docs, B.learn(docs, "id", "text")


def test_abbreviations_equal_the_plain_form(learned):
    texts, _, known = learned
    got = {r["word"]: (r["n_dot"], r["n_plain"], round(r["score"], 6)) for r in known.abbreviations.collect()}
    want = plain_abbreviations(texts)
    assert {w: v[:2] for w, v in got.items()} == {w: v[:2] for w, v in want.items()}
    assert {w: v[2] for w, v in got.items()} == pytest.approx({w: v[2] for w, v in want.items()})
    assert {"dr", "al", "e.g", "fig"} <= set(got)
    assert not {"lemma", "table", "holds"} & set(got)


def test_frequent_starters_are_found(learned):
    assert {r["word"] for r in learned[2].starters.collect()} >= {"the"}
    assert all(r["score"] >= B.STARTER_FROM for r in learned[2].starters.collect())


SENTENCES = [
    ("Dr. A. Lee et al. wrote.", ["Dr. A. Lee et al. wrote."]),
    ("It is by Lee et al. The proof is new. Read it!", ["It is by Lee et al.", "The proof is new.", "Read it!"]),
    ("Am 3. mai war es. Gut.", ["Am 3. mai war es.", "Gut."]),
    ("He was born in 1990. She was not.", ["He was born in 1990.", "She was not."]),
    ("A plan b. We go", ["A plan b.", "We go"]),
    ("Wait... what? (Yes.)  \n No", ["Wait...", "what?", "(Yes.)  \n No"]),
    ("", []), (None, []), (" \n\t", []), ("no mark", ["no mark"]), (". . .", [".", ".", "."]), ("a\x01b. C", ["a b.", "C"]),
    ("É. Bon et al. Le tout. The end. ", ["É. Bon et al. Le tout.", "The end."]),
]


def test_sentences_by_hand_and_by_the_plain_form(spark, learned):
    texts, _, known = learned
    short, first = ({r["word"] for r in df.collect()} for df in (known.abbreviations, known.starters))
    rnd = random.Random(2)
    bits = ["Dr.", "et al.", "A.", "fig.", "3.", "lemma.", "The", "the", "x", "Öl!", "e.g.", "...", "\n", "No?", "(al.)", "7"]
    mixed = [" ".join(rnd.choice(bits) for _ in range(rnd.randrange(12))) for _ in range(300)]
    rows = [t for t, _ in SENTENCES] + mixed + texts[:50]
    docs = spark.createDataFrame([(i, t, "own") for i, t in enumerate(rows)], "id long, text string, piece string")
    got = {}
    for r in B.split_sentences(docs, "id", "text", known).orderBy("id", "sent_idx").collect():
        got.setdefault(r["id"], []).append(r["sentence"])
    for i, (_, want) in enumerate(SENTENCES):
        assert got.get(i, []) == want, i
    for i, t in enumerate(rows):
        assert got.get(i, []) == plain_split((t or "").replace("\x01", " "), short, first), t


@pytest.mark.parametrize("texts", [[], [None, ""], ["one. two. three."], ["no period here"]])
def test_poor_corpora_teach_nothing(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = B.learn(docs, "id", "text")
    assert known.abbreviations.count() == 0 and known.starters.count() == 0
    sentences = [r["sentence"] for r in B.split_sentences(docs, "id", "text", known).orderBy("id", "sent_idx").collect()]
    assert sentences == [s for t in texts for s in plain_split(t, set(), set())]
