import re
from collections import Counter, defaultdict

import numpy as np
from helpers import SMALL, same
from pyspark.sql import functions as F

from graphloom.llm import divergence as D

KIND = "doc_id long, text string, lang string, source string"


def brute(rows, least=3, ranks=200):
    """By the definition, over every kept term of every pair."""
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        counts[lang, source].update(found)
        counts[lang, None].update(found)
        held[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in held[lang].items() if n >= least]

        def share(key, kept=kept):
            total = sum(counts[key][t] for t in kept)
            return {t: 1 + 10**9 * (counts[key][t] + 1) // (total + len(kept)) for t in kept}

        p = share((lang, source))
        pairs = [(sum((p[t] - q) ** 2 // q for t, q in share((lang, other)).items()), other) for of, other in groups if of == lang and other != source]
        terms = [((p[t] - q) ** 2 // q, t) for t, q in share((lang, None)).items() if counts[lang, source][t] and p[t] > q]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, ranks)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in frame.collect())


def test_matches_sql(spark, duck):
    same(D.op12_divergence(spark, SMALL), duck, D.OP12_SQL)


def test_against_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{a}{b}" for a in "abcdef" for b in "aeiou"] + ["Éa", "é–x", "don't", "a1b", "日本"]
    rows = [(i, " ".join(words[k] for k in rng.zipf(1.3, 30) % len(words)), ["en", "de", None][i % 3], ["s", "t", "u", None][i * 7 % 11 % 4]) for i in range(60)]
    rows += [(99, None, "en", "silent"), (98, "", "xx", "s"), (98, "", "xx", "t"), (97, "only once", "yy", "s")]
    frame = spark.createDataFrame(rows, KIND)
    want = brute(rows)
    assert rows_of(D.divergences(spark, frame)) == want
    assert ("xx", "s", "pair", "t", 0, 1) in want and not any(r[0] == "yy" for r in want)
    assert rows_of(D.divergences(spark, frame, ranks=2)) == brute(rows, ranks=2)
    # a sketch that is full lets all terms through and changes nothing
    assert rows_of(D.divergences(spark, frame, cells=4)) == want


def test_sketch_never_underestimates_and_discards(spark):
    docs = [(f"common {'rare%d' % i} x{'y' * (i % 3)}", "en") for i in range(300)] * 2
    sketch = D.sketch_of(spark.createDataFrame(docs, "text string, lang string").repartition(5), 1 << 14)
    names = [b"common", b"rare", b"x", b"xy", *[b"absent%d" % i for i in range(1000)]]
    got = np.minimum(*(row[at] for row, at in zip(sketch, D._cells(b"en", names, 1 << 14), strict=True)))
    assert got[0] == 255 and (got[1:4] >= [255, 200, 200]).all()
    assert (got[4:] == 0).mean() > 0.99


def test_counts_beyond_64_bits(spark):
    """A share's numerator passes 2**63 where a count passes nine thousand million."""
    frame = spark.createDataFrame([(10**13, 3 * 10**13, 7)], "c long, n long, v long")
    assert frame.select(D._share(F.col("c"), F.col("n"), F.col("v")).alias("p")).first()["p"] == 1 + 10**9 * (10**13 + 1) // (3 * 10**13 + 7)


def test_edge_cases(spark):
    assert rows_of(D.divergences(spark, spark.createDataFrame([], KIND))) == []
    rows = [(1, "same same Words", "en", "a")] * 3 + [(2, "other words " * 40_000, "en", "b")] + [(None, None, None, None)]
    frame = spark.createDataFrame(rows, KIND)
    for clash in ("term", "count", "docs", "item", "value", "rank", "p", "q", "n", "v", "p0"):
        frame = frame.withColumn(clash, F.lit("x"))
    assert rows_of(D.divergences(spark, frame)) == brute(rows)
