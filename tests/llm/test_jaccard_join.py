import random
import re

import numpy as np
from helpers import SMALL

from graphloom.llm import jaccard_join as J

LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows):
    sets, parent = {k: shingle_set(t) for k, t in rows}, {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in ids}


def got(frame):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in frame.collect()}


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert got(J.op6_jaccard_join(spark, SMALL)) == brute(rows)


def test_near_copies_at_the_threshold(spark, docs, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 4)
    monkeypatch.setattr(J, "SALT_ROWS", 5)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (6, 12, 30, 60, 120, 250):
        base = [rng.choice(words) for _ in range(size)]
        for copies in range(14):
            text = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [rng.choice(words)]
            rows.append((n, " ".join(text[: rng.randrange(int(0.85 * size), size + 1)]).upper() if copies % 2 else "\n".join(text)))
            n += 1
    want = brute(rows)
    assert 10 < len({c for _, c in want.values()}) < len(rows) - 10
    assert got(J.jaccard_components(spark, docs(*rows))) == want


def test_edge_cases(spark, docs):
    rows = [(1, None), (2, ""), (3, " \t "), (4, "A b"), (5, "a  B"), (6, "a"), (7, "one two three four five"), (8, "w " * 60_000), (9, "x" * 300_000)]
    assert got(J.jaccard_components(spark, docs(*rows))) == brute(rows)
    assert J.jaccard_components(spark, docs(*rows).limit(0)).count() == 0


def test_word_hashes_split_like_the_pattern(monkeypatch):
    text = "Ab\tcd  ÉF\x0bgh\x1cij ab" + "z" * 50
    monkeypatch.setattr(J, "SPAN", J.SPAN)
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    h = J.word_hashes(text)
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert np.array_equal(J.word_hashes("cd"), h[1:2])
