"""Factors kept as tables against numpy."""

import numpy as np
import pytest
from helpers import SMALL

from graphloom.operators import association, factors
from graphloom.plans import queries as Q


def table(spark, x):
    rows = [(f"r{i:02d}", f"c{j:02d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    return spark.createDataFrame(rows, "row string, col string, v double").repartition(3)


def test_triangular_factor_of_a_tall_table(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4)) * [1, 1e-3, 1e3, 1]
    r = factors.triangular(spark.createDataFrame([(row.tolist(),) for row in x], "x array<double>").repartition(7), 4)
    assert np.allclose(r.T @ r, x.T @ x, rtol=1e-9, atol=1e-9 * 1e6)


def test_orthonormal_columns(spark):
    """Weights ten powers of ten apart, and a column that depends on others."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5)) @ np.diag([1, 1e-5, 1e-10, 1, 1])
    x[:, 4] = x[:, 0] - 2 * x[:, 3]
    thin, back = factors.orthonormal(spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, x array<double>"), 5)
    q = np.array([r["x"] for r in thin.orderBy("id").collect()])
    assert q.shape[1] == 4 and np.allclose(q.T @ q, np.eye(4), atol=1e-9) and np.allclose(q @ back, x, atol=1e-9)


@pytest.mark.parametrize("rank", [2, 40])
def test_factors_are_those_of_numpy(spark, rank):
    rng = np.random.default_rng(2)
    x = (rng.random((30, 22)) < 0.4) * rng.random((30, 22)) + np.outer(rng.random(30) < 0.5, rng.random(22) < 0.5) * 2.0
    left, right, values = factors.thin_factors(table(spark, x), rank)
    u, s, vt = np.linalg.svd(x)
    k = min(rank, 22)
    assert np.allclose(values[:k], s[:k], atol=1e-4)
    a, b = ({r[0]: np.array(r[1]) for r in f.collect()} for f in (left, right))
    got = np.array([[a.get(f"r{i:02d}", np.zeros(k)) @ b.get(f"c{j:02d}", np.zeros(k)) for j in range(22)] for i in range(30)])
    assert np.allclose(got, u[:, :k] * s[:k] @ vt[:k], atol=1e-3)


def test_both_ways_give_the_same_scores(spark):
    cells = association.ppmi(Q._cells(spark, SMALL))
    pairs = cells.select("row", "col")
    a, b = ({(r["row"], r["col"]): r["score"] for r in association.svd_scores(cells, pairs, 4, most_nodes=most).collect()} for most in (10**6, 0))
    assert a.keys() == b.keys() and max(abs(a[p] - b[p]) for p in a) < 2e-3


def test_nothing_to_factor(spark):
    left, right, values = factors.thin_factors(spark.createDataFrame([], "row string, col string, v double"), 3, rounds=1)
    assert left.collect() == right.collect() == [] and len(values) == 0


def test_cells_are_worked_out_once(spark):
    """Each row of the cells' source is read once, whatever the rounds."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    cells = spark.createDataFrame([(f"r{i}", f"c{i * j % 7}", 1.0 + i) for i in range(9) for j in range(2)], "row string, col string, v double")
    association.truncated_svd(cells.mapInPandas(counted, cells.schema), 2)
    assert seen.value == 18
