"""Searches in blocks against all products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import vectors as V


def made(spark, n, dim=6, seed=0, spread=0.1, ids="long", scale=False):
    """Clusters, so that bounds can tell blocks apart."""
    rng = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(7, dim))
    x = centres[rng.integers(0, 7, n)] + spread * rng.normal(size=(n, dim))
    if scale:
        x *= np.exp(rng.normal(size=(n, 1)) * 1.5)
    x[n // 2] = x[0]
    name = (lambda i: i) if ids == "long" else (lambda i: f"v{i:04d}")
    return x, spark.createDataFrame([(name(i), row.tolist()) for i, row in enumerate(x)], f"id {ids}, embed array<double>")


def cosines(x, y):
    return x / np.linalg.norm(x, axis=1, keepdims=True) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T


@pytest.mark.parametrize("threshold", [-1.0, 0.3, 0.95, 1.1])
def test_pairs_above(spark, threshold):
    x, left = made(spark, 150)
    y, right = made(spark, 90, seed=1, ids="string")
    want = {(int(i), f"v{j:04d}") for i, j in zip(*np.nonzero(cosines(x, y) >= threshold), strict=True)}
    got = V.pairs_above(left, right, threshold, block=16).collect()
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_blocks_that_are_far_apart_stay_closed(spark):
    _, left = made(spark, 400, spread=0.02)
    row = V.share_opened(left, left, 0.98, block=20).first()
    assert row["blocks"] == 400 and row["opened"] < 160 and row["share"] < 0.4
    plan = V.pairs_above(left, left, 0.98, block=20)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("k", [1, 5, 500])
def test_nearest(spark, k):
    x, left = made(spark, 130)
    sims = cosines(x, x)
    np.fill_diagonal(sims, -np.inf)
    got = V.nearest(left, left, k, block=16).orderBy("a", "place").collect()
    by = {}
    for r in got:
        by.setdefault(r["a"], []).append((r["b"], r["score"]))
    for i in range(130):
        order = sorted(range(130), key=lambda j: (-round(sims[i, j], 9), j))[: min(k, 129)]
        assert [round(s, 9) for _, s in by[i]] == [round(sims[i, j], 9) for j in order]
        assert {b for b, _ in by[i]} - {i} == {b for b, _ in by[i]}


def test_best_matches(spark):
    x, left = made(spark, 60)
    y, right = made(spark, 45, seed=3)
    got = {r["a"]: r["score"] for r in V.best_matches(left, right).collect()}
    assert np.allclose([got[i] for i in range(60)], cosines(x, y).max(axis=1))


@pytest.mark.parametrize("k", [1, 40, 3000, 10**6])
def test_top_products(spark, k):
    x, left = made(spark, 120, scale=True)
    y, right = made(spark, 80, seed=5, scale=True, ids="string")
    x[7] = 0
    left = left.withColumn("embed", F.when(F.col("id") == 7, F.transform("embed", lambda _: F.lit(0.0))).otherwise(F.col("embed")))
    products = x @ y.T
    want = sorted(((i, f"v{j:04d}") for i in range(120) for j in range(80)), key=lambda p: (-round(products[p[0], int(p[1][1:])], 9), p))[:k]
    report = {}
    got = V.top_products(left, right, k, block=10, report=report).collect()
    assert sorted(round(r["score"], 9) for r in got) == sorted(round(products[i, int(j[1:])], 9) for i, j in want)
    for r in got:
        assert np.isclose(r["score"], products[r["a"], int(r["b"][1:])])
    assert report["blocks"] == 12 * 8
    if k <= 40:
        assert report["opened"] < 30


def test_odd_vectors(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (None, [0.0, 2.0])], "id long, embed array<double>")
    assert sorted((r["a"] or 0, r["b"] or 0) for r in V.pairs_above(frame, frame, 0.5).collect()) == [(0, 0), (1, 1), (1, 4), (4, 1), (4, 4)]
    assert sorted((r["a"] or 0, r["b"] or 0, r["score"]) for r in V.nearest(frame, frame, 1).filter("a is not null").collect()) == [(1, 4, 1.0), (4, 1, 1.0)]
    for empty in (frame.limit(0), frame.filter("id = 2")):
        assert V.pairs_above(empty, frame, 0.5).collect() == [] and V.pairs_above(frame, empty, 0.5).collect() == []
        assert V.nearest(frame, empty, 2).collect() == []
    assert V.top_products(frame.limit(0), frame, 3).collect() == []


@pytest.mark.parametrize("held", [1, 200])
def test_tasks_hold_a_bounded_number_of_products(spark, held, monkeypatch):
    """Some rows of a block at a time give what whole blocks do."""
    monkeypatch.setattr(V, "HELD", held)
    x, left = made(spark, 50)
    sims = cosines(x, x)
    a, b, width = V.both(left, left, True, 25)
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "a int, b int")

    def work(p, q, mine, theirs, state):
        return np.zeros(1, int), np.zeros(1, int), np.array([float(len(p) * len(q))])

    assert max(r["score"] for r in V._opened(pairs, a, b, width, work).collect()) <= max(held, 25)
    seen = V.nearest(left, left, 3, block=25).collect()
    np.fill_diagonal(sims, -np.inf)
    assert np.allclose(sorted(r["score"] for r in seen), np.sort(np.sort(sims, axis=1)[:, -3:].ravel()))
    products = np.sort((x @ x.T).ravel())[-40:]
    assert np.allclose(sorted(r["score"] for r in V.top_products(left, left, 40, block=25).collect()), products)


def test_blocks_are_not_copied_for_each_pair(spark, monkeypatch):
    """A block is sent once for each row or column of cells; before, once for each block that it meets."""
    x, left = made(spark, 400)
    sent, plain = [], type(left).mapInArrow
    monkeypatch.setattr(type(left), "mapInArrow", lambda self, task, schema: sent.append((schema, self)) or plain(self, task, schema))
    got = V.pairs_above(left, left, -1.0, block=8)
    assert got.count() == 400 * 400
    blocks = next(f for schema, f in reversed(sent) if schema.startswith("a bigint, b bigint"))
    assert blocks.count() < 50 * 2 * 8
