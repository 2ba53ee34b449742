import random
import re
import time

from scholarq.operators.gazetteer import Automaton, tag_entities, taken


def brute_tags(text, names):
    """Try every name at every token, from the left, the longest first."""
    spans = [m.span() for m in re.finditer(r"\w+", text)]
    out, i = [], 0
    while i < len(spans):
        best = None
        for n in range(len(spans) - i, 0, -1):
            run = spans[i:i + n]
            if all(re.fullmatch(r"[ \t\n\x0b\f\r]+", text[a[1]:b[0]]) for a, b in zip(run, run[1:])):
                best = names.get(" ".join(text[a:b] for a, b in run))
                if best:
                    break
        if best:
            out.append((text[spans[i][0]:spans[i + n - 1][1]], spans[i][0], spans[i + n - 1][1], best))
        i += n if best else 1
    return out


def random_text(rng, n):
    return "".join(rng.choice("aabcé") + rng.choice([" ", " ", " ", "\n", ". ", "-", " "]) for _ in range(n))


def test_tags_are_those_of_trying_every_name(spark):
    rng = random.Random(6)
    names = {" ".join(rng.choices("abcé", k=rng.randrange(1, 6))): rng.choice(["ORG", "PERSON"]) for _ in range(25)}
    texts = [(i, random_text(rng, rng.randrange(60))) for i in range(150)] + [(150, None), (151, "")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    rows = [(n, x) for n, x in names.items()] + [(f"  {n.replace(' ', ', ')}!", "ZZZ") for n in names] + [("--", "ORG"), (None, "ORG"), ("b", None)]
    dictionary = spark.createDataFrame(rows, "name string, label string")
    want = sorted((i, *t) for i, x in texts for t in brute_tags(x or "", names))
    assert want and sorted(map(tuple, tag_entities(docs, "id", "text", dictionary).collect())) == want
    # in shards, that meet by document
    assert sorted(map(tuple, tag_entities(docs, "id", "text", dictionary, most_names=7).collect())) == want
    assert tag_entities(docs, "id", "text", dictionary.limit(0)).collect() == []


def test_time_is_linear_in_the_text():
    """Names that start at every token and reach far: no restart, no list of overlapping matches."""
    automaton = Automaton([("a", "X"), ("a a", "Y"), (" ".join("a" * 60) + " b", "Z"), ("b a", "W")])

    def seconds(n):
        text = " ".join(["a"] * 63 + ["b"]) + " "
        text *= n // 64
        best = 1e9
        for _ in range(3):
            began = time.process_time()
            found = list(taken(automaton.candidates(text)[::-1]))
            best = min(best, time.process_time() - began)
        assert len(found) > n // 64
        return best

    assert seconds(200_000) <= 14 * seconds(20_000)
