"""Drawn pairs and the pair classifier."""

import hashlib
import inspect
import random

import numpy as np
import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from graphloom.functions import md5
from graphloom.operators import pairs, sampling, tables
from graphloom.plans import whole_queries as W


def graph(spark, n, edges):
    vertices = spark.createDataFrame([(f"t{i:02d}",) for i in range(n)] * 2 + [(None,)], "title string")
    return vertices, spark.createDataFrame([(f"t{i:02d}", f"t{j:02d}") for i, j in edges], "src string, dst string")


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_each_number_is_dealt_once(spark, bits):
    got = [r[0] for r in spark.range(1 << 2 * bits).select(sampling.dealt(F.col("id"), bits, 3)).collect()]
    assert sorted(got) == list(range(1 << 2 * bits))
    if bits == 5:
        assert got != sorted(got) and abs(np.corrcoef(got, range(len(got)))[0, 1]) < 0.1


def test_all_non_edges_and_prefixes(spark):
    known = {(i, (i * 5 + 1) % 11) for i in range(11)} | {(3, 3)}
    vertices, edges = graph(spark, 11, [*known, *known])
    rows = sampling.non_edges(vertices, edges, 1000).orderBy("draw").collect()
    every = [(r["src"], r["dst"]) for r in rows]
    assert len(every) == len(set(every)) == 121 - len(known)
    assert set(every) == {(f"t{i:02d}", f"t{j:02d}") for i in range(11) for j in range(11) if (i, j) not in known}
    for n, parts in ((1, 1), (7, 3), (60, 9)):
        some = sampling.non_edges(vertices.repartition(parts), edges.repartition(parts), n).orderBy("draw").collect()
        assert [(r["src"], r["dst"]) for r in some] == every[:n]
    assert [(r["src"], r["dst"]) for r in sampling.non_edges(vertices, edges, 7, seed=1).orderBy("draw").collect()] != every[:7]


def test_none_to_draw(spark):
    vertices, edges = graph(spark, 2, [(0, 0), (0, 1), (1, 0), (1, 1)])
    assert sampling.non_edges(vertices, edges, 5).collect() == []
    assert sampling.non_edges(vertices.limit(0), edges, 5).collect() == []
    assert sampling.non_edges(vertices, edges, 0).collect() == []


def test_no_quadratic_stage(spark):
    """Two hundred thousand titles have 4e10 pairs; no plan holds a product of tables, and a sample comes at once."""
    vertices = spark.range(200_000).select(F.concat(F.lit("v"), "id").alias("title"))
    edges = spark.range(1000).select(F.concat(F.lit("v"), "id").alias("src"), F.concat(F.lit("v"), F.col("id") + 1).alias("dst"))
    out = sampling.non_edges(vertices, edges, 5000)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert out.distinct().count() == 5000 and out.agg(F.count_distinct("src")).first()[0] > 4800


def test_inserted_edges(spark):
    _, edges = graph(spark, 30, [(i, (i + 1) % 30) for i in range(30)])
    out = sampling.with_non_edges(edges.withColumn("weight", F.lit(2)), 0.5).collect()
    assert len(out) == 45 and len({(r["src"], r["dst"]) for r in out}) == 45 and sorted(r["weight"] for r in out) == [1.0] * 15 + [2.0] * 30


def test_gradient_is_that_of_the_definition(spark):
    rng = np.random.default_rng(0)
    rows = [(sorted({int(x) for x in rng.integers(0, 20, 4)}), int(rng.integers(0, 2)), bool(rng.random() < 0.3)) for _ in range(50)]
    weights = rng.normal(size=20)
    loss, slope, held = pairs.gradient(spark.createDataFrame(rows, "features array<int>, label int, held boolean").repartition(3), weights, 0.1)
    x = np.zeros((50, 20))
    for i, (at, _, _) in enumerate(rows):
        x[i, at] = 1
    y, apart = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    p = 1 / (1 + np.exp(-x @ weights))
    each = -(y * np.log(p) + (1 - y) * np.log(1 - p))
    assert np.isclose(loss, each[~apart].mean() + 0.05 * weights @ weights) and np.isclose(held, each[apart].mean())
    assert np.allclose(slope, x[~apart].T @ (p - y)[~apart] / (~apart).sum() + 0.1 * weights)


def test_held_out_edges_are_found(spark):
    """Of held-out pairs one in eleven is an edge: a constant gives 0 or 0.17."""
    model, scored = W.classified(spark, SMALL)
    rows = [(r["label"], r["score"]) for r in scored.select("label", "score").collect()]
    true = sum(y for y, _ in rows)
    hits, found = sum(y for y, s in rows if s >= 0.5), sum(s >= 0.5 for _, s in rows)
    precision, recall = hits / max(found, 1), hits / true
    assert true > 15 and len(rows) > 8 * true
    assert 2 * precision * recall / max(precision + recall, 1e-9) > 0.85
    losses = [x for x, _ in model.history]
    assert losses == sorted(losses, reverse=True) and losses[-1] < 0.3 * losses[0]


def test_training_stops_where_the_held_part_gets_worse(spark):
    """Labels without sense: learning them by heart does not help."""
    rng = np.random.default_rng(1)
    rows = [(f"a{i}", f"b{i * 7 % 60}", int(rng.integers(0, 2))) for i in range(120)]
    frame = spark.createDataFrame(rows, "src string, dst string, label int")
    model = pairs.train(frame.filter("src < 'a5'"), frame.filter("src >= 'a5'"), rounds=40, patience=2)
    held = [h for _, h in model.history]
    assert len(held) < 41 and min(held) <= held[-1]
    with pytest.raises(ValueError):
        pairs.train(frame.limit(0), frame, rounds=2)


def test_odd_titles(spark):
    frame = spark.createDataFrame([(None, "a"), ("", ""), ("x " * 5000, "y"), ("Ünï-cödé 9", "ünï")], "src string, dst string")
    got = [r[0] for r in frame.select(pairs.features(F.col("src"), F.col("dst"), 64)).collect()]
    assert all(x and all(0 <= i < 64 for i in x) and len(x) == len(set(x)) for x in got)


@pytest.mark.parametrize("n", [0, 5, 300, 10**6])
def test_negative_pairs_list_only_what_may_be_first(spark, monkeypatch, n):
    """All pairs are hashed, few are kept, and where edges took most of those, more; no number of titles is too great."""
    names = [f"t{i}" for i in range(120)]
    order = sorted((hashlib.md5(f"{a}:{b}:0".encode()).hexdigest(), a, b) for a in names for b in names)
    edges = [p[1:] for p in order[:2000]]
    kept, write = [], tables.materialise
    monkeypatch.setattr(tables, "materialise", lambda f, name: kept.append((name, write(f, name))) or kept[-1][1])
    got = tables.negative_pairs(spark.createDataFrame([(x,) for x in names * 2], "title string"), spark.createDataFrame(edges, "src string, dst string"), n).collect()
    assert [tuple(r) for r in got] == [p[1:] for p in order[2000:]][:n]
    sizes = [f.count() for name, f in kept if name == "below"]
    assert sizes[0] < 4000 or n > 4000
    assert "most_nodes" not in inspect.signature(tables.negative_pairs).parameters


@pytest.mark.parametrize("few", [0, 1000])
def test_beginnings_of_hashes(monkeypatch, few):
    """Starts and ends of all lengths over one, two and more blocks."""
    monkeypatch.setattr(md5, "FEW", few)
    rng = random.Random(1)
    for begin in (*range(70), 118, 119, 120, 127, 200):
        for end in (0, 1, 4, 5, 27, 55, 64, 100):
            start, ends = rng.randbytes(begin), [rng.randbytes(end) for _ in range(3)]
            assert md5.Ends(ends, b":0").heads(start).tolist() == [int(hashlib.md5(start + e + b":0").hexdigest()[:8], 16) for e in ends]


def test_negative_pairs_are_hashed_in_packs(spark, monkeypatch):
    """Titles of many lengths, empty, null and beyond ASCII: the first pairs by hash order, which no plan hashes pair by pair."""
    monkeypatch.setattr(tables, "PACK", 64)
    monkeypatch.setattr(md5, "FEW", 4)
    names = ["x" * (k % 9) + str(k) for k in range(150)] + ["", "é☃" * 30, None]
    order = [(hashlib.md5(":".join(x for x in (a, b, "7") if x is not None).encode()).hexdigest(), a, b) for a in names for b in names]
    order = sorted(order, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2] or ""))
    edges = [p[1:] for p in order[:40] if None not in p]
    plans, write = [], tables.materialise
    monkeypatch.setattr(tables, "materialise", lambda f, name: plans.append((name, f._jdf.queryExecution().toString())) or write(f, name))
    got = [tuple(r) for r in tables.negative_pairs(spark.createDataFrame([(x,) for x in names], "title string"), spark.createDataFrame(edges, "src string, dst string"), 120, seed=7).collect()]
    assert got == [p[1:] for p in order if p[1:] not in edges][:120]
    assert any("MapInArrow" in plan for name, plan in plans if name == "below")
