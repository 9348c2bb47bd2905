"""Operators without SQL, and edge cases of those that have it."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import hearst
from graphloom.operators import analysis, extract


def test_ward_against_brute_force():
    rng = np.random.default_rng(4)
    points = rng.random((24, 3))
    clusters = [[i] for i in range(24)]
    for k in range(23, 0, -1):
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((points[a].mean(axis=0) - points[b].mean(axis=0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(clusters)) for j in range(i)), key=lambda p: cost(clusters[p[0]], clusters[p[1]]))
        clusters[j] = clusters[j] + clusters[i]
        del clusters[i]
        got = analysis.cut(analysis.ward(points.copy()), 24, k)
        assert {frozenset(np.flatnonzero(np.array(got) == c)) for c in range(k)} == {frozenset(c) for c in clusters}


def test_ward_clusters_in_spark(spark):
    rows = spark.createDataFrame([(i, [float(i // 5), 0.1 * (i % 5)]) for i in range(15)], "id long, embed array<double>")
    assert {r["id"]: r["cluster"] for r in analysis.ward_clusters(rows, 3).collect()} == {i: i // 5 for i in range(15)}
    with pytest.raises(ValueError):
        analysis.ward_clusters(rows, 3, most=14)


@pytest.mark.parametrize(("n", "alone"), [(90, 32)])
def test_ward_in_rounds_comes_to_the_same(spark, n, alone):
    """Beyond what one task joins there is no bound, and the clusters are those of one task."""
    rng = np.random.default_rng(n)
    points = rng.normal(size=(9, 5))[rng.integers(0, 9, n)] + 0.3 * rng.normal(size=(n, 5))
    rows = spark.createDataFrame([(7 * i % 1009, points[i].tolist()) for i in range(n)], "id long, embed array<double>")
    order = sorted(range(n), key=lambda i: 7 * i % 1009)
    tree = analysis.ward(points[order])
    for k in (4,):
        want = {7 * i % 1009: c for i, c in zip(order, analysis.cut(tree, n, k), strict=True)}
        assert {r["id"]: r["cluster"] for r in analysis.ward_clusters(rows, k, alone=alone).collect()} == want


def test_concepts_by_lookup_and_by_join_agree(spark):
    docs = spark.createDataFrame([(1, "the end of the sea of the end".split()), (2, []), (3, None), (4, ["of"])], "doc_id long, tokens array<string>")
    concepts = spark.createDataFrame([("of the",), ("of the sea",), ("end",), ("the end of",), ("end",), (None,)], "concept string")
    a = sorted(map(tuple, extract.tag_concepts(docs, concepts).collect()))
    b = sorted(map(tuple, extract.tag_concepts(docs, concepts, most_literals=1).collect()))
    assert a == b == [(1, 0, 3, "the end of"), (1, 5, 2, "of the"), (1, 7, 1, "end")]
    tags = {r["doc_id"]: r["tags"] for r in extract.bio_tags(docs, extract.tag_concepts(docs, concepts)).collect()}
    assert tags == {1: list("BIIOOBIB"), 2: [], 3: None, 4: ["O"]}


def sentence(text):
    """word/tag or word/lemma/tag tokens."""
    return [(w[0], w[-2] if len(w) == 3 else w[0].lower(), w[-1]) for w in (t.split("/") for t in text.split())]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("A/DT cat/NN is/be/VBZ a/DT kind/NN of/IN animal/NN", [("animal", "cat", "example of")]),
        ("cats/NNS and/CC other/JJ small/JJ animals/NNS", [("small animals", "cats", "and other 0")]),
        ("cats/NNS ,/, dogs/NNS or/CC any/DT other/JJ pets/NNS", [("pets", "dogs", "and other 0"), ("pets", "cats", "and other 1")]),
        ("systems/NNS of/IN law/NN such/JJ as/IN civil/JJ law/NN", [("systems of law", "civil law", "such as 0")]),
        ("pets/NNS including/VBG cats/NNS ,/, dogs/NNS", [("pets", "cats", "including 0"), ("pets", "dogs", "including 1")]),
        ("Like/IN most/JJS pets/NNS ,/, the/DT cat/NN", [("pets", "cat", "like most")]),
        ("a/DT cube/NN is/be/VBZ a/DT special/JJ case/NN of/IN prism/NN", [("prism", "cube", "special case of")]),
    ],
)
def test_tagged_patterns(spark, text, want):
    frame = spark.createDataFrame([(sentence(text),)], "tokens array<struct<word:string,lemma:string,tag:string>>")
    got = {tuple(r) for r in frame.select(F.inline(hearst.tagged_pairs(F.col("tokens")))).collect()}
    assert {w for w in want if w[2] != "such as 0"} <= got


def test_a_rule_begins_at_a_token(spark):
    """A word that may not stand there is not dodged by beginning within it."""
    for text, want in (("features/NNS in/IN animals/NNS such/JJ as/IN cats/NNS", []), ("some/DT features/NNS of/IN animals/NNS such/JJ as/IN cats/NNS", []), ("the/DT cats/NNS dogs/NNS pets/NNS such/JJ as/IN rats/NNS", [("dogs pets", "rats", "!features such as")])):
        words = sentence(text)
        assert hearst.pairs_of([w for w, _, _ in words], "".join(hearst.character(*t) for t in words)) == want


def test_long_sentences_take_time_in_proportion():
    """All rules over a hundred thousand nouns, a list of as many, and adverbs."""
    noun, comma, adverb = (hearst.character(*t) for t in (("x", "x", "NN"), (",", ",", ","), ("so", "so", "RB")))
    began = time.perf_counter()
    for text in (noun * 100_000, (noun + comma) * 50_000, adverb * 100_000):
        assert hearst.pairs_of(["x"] * len(text), text) == []
    assert time.perf_counter() - began < 60
    such = hearst.character("such", "such", "JJ") + hearst.character("as", "as", "IN")
    assert {r for _, _, r in hearst.pairs_of(["x"] * 100_004, noun * 50_000 + such + noun * 50_000)} == {"!features such as"}


def test_odd_sentences(spark):
    kind = "tokens array<struct<word:string,lemma:string,tag:string>>"
    rows = spark.createDataFrame([(None,), ([],), ([(None, None, None), ("a b", None, "NN"), ("such", "such", None), ("as", None, "IN"), ("c", "c", "NN")],), ([("p", "p", "NN"), ("including", None, None), ("q", "q", "NN")],)], kind)
    got = [None if r[0] is None else [tuple(x) for x in r[0]] for r in rows.coalesce(1).select(hearst.tagged_pairs(F.col("tokens"))).collect()]
    assert got == [None, [], [], [("p", "q", "including 0")]]


def test_tagger_is_a_parameter(spark):
    docs = spark.createDataFrame([("a", "cats and other pets"), ("b", None)], "id string, text string")
    tags = {"cats": "NNS", "and": "CC", "other": "JJ", "pets": "NNS"}
    rows = hearst.tagged_documents(docs, lambda x: [[(w, w, tags[w]) for w in x.split()]] if x else [])
    assert [tuple(r) for r in rows.select("id", F.inline(hearst.tagged_pairs(F.col("tokens")))).collect()] == [("a", "pets", "cats", "and other 0")]


def test_nested_edges_quarantine_and_bound(spark):
    rows = spark.createDataFrame([("1", '{"a": {"b": {}, "c": {"d": 1}}}'), ("2", "{"), ("3", None), ("4", "{}")], "id string, text string")
    edges, bad = analysis.nested_edges(rows, "text")
    assert sorted((r["depth"], r["src"], r["dst"]) for r in edges.collect()) == [(0, "a", "b"), (0, "a", "c"), (1, "c", "d")]
    assert sorted(r["id"] for r in bad.collect()) == ["2", "3"]
    with pytest.raises(ValueError):
        analysis.nested_edges(rows, "text", deepest=1)


def test_generation_resumes(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"t{i}") for i in range(10)] + [("3", "t3")], "id string, title string")
    path = f"file://{tmp_path}/answers"
    analysis.generated(docs.filter("id < '4'"), lambda p: [x + "!" for x in p], F.col("title"), path)
    out = analysis.generated(docs, lambda p: [x + "?" for x in p], F.col("title"), path, size=2).collect()
    assert sorted((r["id"], r["response"]) for r in out) == [(str(i), f"t{i}{'!' if i < 4 else '?'}") for i in range(10)]


def test_quantiles_hold_no_group(spark):
    """Quantiles of all pairs of a group, with copies and a vector without length; no task keeps the scores of a group."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 4))
    x[5:9] = x[4]
    x[11] = 0
    rows = spark.createDataFrame([(i, i % 2, x[i].tolist()) for i in range(40)] + [(99, 7, [1.0])], "id long, label int, embed array<double>")
    out = analysis.similarity_quantiles(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    got = {r["group"]: r for r in out.collect()}
    assert set(got) == {0, 1}
    for g in (0, 1):
        own = [x[i] for i in range(g, 40, 2)]
        all_ = [a @ b / np.linalg.norm(a) / np.linalg.norm(b) for i, a in enumerate(own) for b in own[:i] if a.any() and b.any()]
        assert got[g]["n"] == 190 and np.allclose(got[g]["quantiles"], np.quantile(all_, (0.05, 0.25, 0.5, 0.75, 0.95)))


def test_nearest_edges_by_vectors_list_no_pairs(spark, monkeypatch):
    """40 equal vectors beside others: as by the similar titles, in blocks of any size, while no table holds more than the edges."""
    from graphloom.operators import similarity

    vectors = spark.createDataFrame([(f"t{i:02}", [1.0, 2.0, 0.5] if i < 40 else [float(i % 5), 1.0 - i % 3, float(i % 7) - 2]) for i in range(60)] + [("zero", [0.0] * 3), ("none", None)], "title string, embed array<double>")
    a = spark.createDataFrame([(f"t{i:02}", f"t{(i * 7 + 1) % 60:02}") for i in range(0, 60, 2)] + [("zero", "t01"), ("none", "t02")], "src string, dst string")
    b = spark.createDataFrame([(f"t{i:02}", f"t{(i * 11 + 3) % 60:02}") for i in range(60)], "src string, dst string")
    v = vectors.withColumnRenamed("title", "id")
    rows = lambda f: sorted((r["src"], r["dst"], r["place"], r["near_src"], r["near_dst"], round(r["score"], 9)) for r in f.collect())
    similar = similarity.pairs_above(v, v, 0.2).withColumn("score", F.round("score", 12))
    want = rows(analysis.nearest_edges(a, b, similar))
    written, plain = [], analysis.materialise
    monkeypatch.setattr(analysis, "materialise", lambda f, name="table": written.append((out := plain(f, name)).count()) or out)
    assert len(want) > 100
    for block in (None, 7):
        assert rows(analysis.nearest_edges_above(a, b, vectors, 0.2, block=block)) == want
    assert max(written) <= 62
    assert analysis.nearest_edges_above(a.limit(0), b, vectors, 0.2).count() == 0
    assert analysis.nearest_edges_above(a, b.limit(0), vectors, 0.2).count() == 0


@pytest.mark.parametrize("block", [7, 1000])
def test_quantiles_write_no_pairs(spark, monkeypatch, block):
    """Parts of groups meet in tasks: no table holds more rows than there are vectors, ranges or wanted places; equal ids, widths, nulls and zero vectors as before."""
    rng = np.random.default_rng(8)
    rows = [(i, i % 3, rng.normal(size=5).tolist()) for i in range(150)] + [(4, 1, [1.0] * 5), (4, 1, [2.0] * 5), (7, 1, [0.0] * 5), (200, 1, [1.0, 2.0]), (201, 1, [2.0, 1.0]), (202, 1, None), (203, 1, [1.0, None]), (300, None, [1.0]), (None, 1, [1.0])]
    kept, write = {}, analysis.materialise
    monkeypatch.setattr(analysis, "materialise", lambda f, name: kept.setdefault(name, write(f, name)))
    got = {r["group"]: r for r in analysis.similarity_quantiles(spark.createDataFrame(rows, "id long, label int, embed array<double>"), (0.0, 0.3, 0.5, 1.0), block=block).collect()}
    assert set(got) == {0, 1, 2}
    for g in range(3):
        own = sorted((r for r in rows if r[1] == g and r[0] is not None), key=lambda r: r[0])
        pairs = [(x, y) for k, (a, _, x) in enumerate(own) for b, _, y in own[k + 1 :] if a < b]
        sims = [np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) for x, y in pairs if x and y and None not in x + y and any(x) and any(y) and len(x) == len(y)]
        assert got[g]["n"] == len(pairs) and np.allclose(got[g]["quantiles"], np.quantile(sims, (0.0, 0.3, 0.5, 1.0)), atol=1e-12)
    assert "pairs" not in kept and kept["unit"].count() <= len(rows)


def test_ward_writes_no_pairs_of_blocks(spark, monkeypatch):
    """Nearest clusters come as a row for each cluster; what a pair of parts finds is merged without being written."""
    rng = np.random.default_rng(3)
    points = rng.normal(size=(60, 4))
    points[5] = points[4]
    kept, write = [], analysis.materialise
    monkeypatch.setattr(analysis, "materialise", lambda f, name: kept.append((name, write(f, name))) or kept[-1][1])
    got = {r["id"]: r["cluster"] for r in analysis.ward_clusters(spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, embed array<double>"), 5, alone=16).collect()}
    assert got == dict(enumerate(analysis.cut(analysis.ward(points), 60, 5)))
    assert {name for name, _ in kept} == {"near", "merges", "clusters"}
    assert all(f.count() <= 60 for _, f in kept)
