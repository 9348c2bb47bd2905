from itertools import product
from zlib import crc32

import numpy as np
import pytest
from helpers import SMALL, same
from pyspark.sql import functions as F

from graphloom.llm import spelling as S


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(spark, words, most=S.LIST):
    frame = spark.createDataFrame([(w, n) for n, w in enumerate(words, 1)], "word string, n long")
    rows = [tuple(sorted((r["a"], r["b"]))) for r in S.near_words(spark, frame, most).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_matches_sql(spark, duck):
    same(S.op11_spelling(spark, SMALL), duck, S.OP11_SQL)


@pytest.mark.parametrize("most", [S.LIST, 6])
def test_near_words_against_all_pairs(spark, most):
    """Repeated letters shift trigrams onto each other, and few letters make long lists; both ways to merge them find the same."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), size=n)) for n in rng.integers(5, 9, 150)} | {"a" * n for n in range(5, 12)} | {"ab" * n for n in range(3, 7)}
    words = sorted(words | {w[:i] + "z" + w[i + j :] for w in sorted(words)[:6] for i, j in product(range(len(w)), (0, 1))})
    assert near(spark, words, most) == {(a, b) for a in words for b in words if a < b and edits(a, b) == 1}


def test_a_long_list_is_split_until_it_is_short(spark):
    """All these words share their rarest trigrams."""
    letters = [chr(c) for c in range(ord("a"), ord("a") + 24)]
    words = ["qxzjqxzj" + a + b for a in letters for b in letters]
    found = near(spark, words, 30)
    assert len(found) == 24 * 24 * 46 // 2


def test_long_words(spark):
    long = "".join(chr(97 + i * i % 26) for i in range(70_000))
    words = [long, long[:-1], long[:35_000] + "é" + long[35_000:], "xy" + long[2:], "short", "shirt"]
    assert near(spark, words) == {tuple(sorted(p)) for p in [(long, words[1]), (long, words[2]), ("short", "shirt")]}


def test_a_letter_goes_by_checksum(spark, docs):
    """Of many documents with the same run, those that a fixed share picks lose a letter, over letters of one and two bytes."""
    runs = {w: [(i, crc32(f"{i}:{w}".encode())) for i in range(600)] for w in ("größere", "letters")}
    want = {}
    for w, hashes in runs.items():
        for _, h in hashes:
            word = w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w
            want[word] = want.get(word, 0) + 1
    got = {r["word"]: r["n"] for r in S.vocabulary(docs(*[(i, "GRÖßERE größere, Letters".replace("GRÖßERE ", "")) for i in range(600)])).collect()}
    assert got == {w: n for w, n in want.items() if n >= 3} and got["letters"] < 600


def test_forms_and_roots(spark, docs):
    counts = {"receive": 20, "recieve": 3, "receeve": 8, "receevx": 4, "tower": 3, "towel": 3, "lonely": 5}
    out = {r["word"]: r for r in S.variants(spark, docs(*[(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())])).collect()}
    assert {w: r["n"] for w, r in out.items()} == counts
    assert (out["receeve"]["form"], out["receeve"]["form_n"], out["receeve"]["root"], out["receeve"]["n_near"]) == ("receive", 20, "receive", 3)
    assert (out["receevx"]["form"], out["receevx"]["root"]) == ("receeve", "receive")
    assert (out["recieve"]["form"], out["recieve"]["root"], out["recieve"]["n_near"]) == ("receeve", "receive", 1)
    assert (out["tower"]["form"], out["tower"]["n_near"], out["lonely"]["n_near"]) == (None, 1, 0)


def test_edge_cases(spark, docs):
    assert S.variants(spark, docs((1, None))).collect() == []
    assert S.variants(spark, docs()).collect() == []
    rows = docs((None, "hello Hello"), (None, "hello"), (1, ""), (2, "ab " * 50_000), (2, "ÀÉÎõü÷×" * 3), (2, "x–hello, naïve naïve naïve"))
    frame = rows.withColumn("word", F.lit(1)).withColumn("n", F.lit("x")).withColumn("list", F.lit(0)).withColumn("root", F.lit(None).cast("string"))
    got = {r["word"]: r["n"] for r in S.variants(spark, frame).collect()}
    assert crc32(b":hello") % 97 and crc32(b"2:hello") % 97 and crc32("2:naïve".encode()) % 97
    assert got == {"hello": 4, "naïve": 3}
