"""Low-rank factors of a sparse matrix whose rows and columns are tables, not arrays on the driver.

Subspace iteration: a thin matrix (a vector of ``rank`` + 8 numbers for each column) is multiplied by the sparse one and back, as
joins and sums over cells. After each product its columns are made orthonormal: every task folds its rows into one triangular
factor, tasks' factors are folded into each other in a tree, and the last one, as small as the thin
matrix is wide, goes to the driver, which sends back what each row is to be multiplied by. At the end this is done twice, as
the first time loses some orthogonality where singular values lie far apart. Directions without weight go.

What the driver holds has ``rank`` + 8 rows and columns, however many names and cells there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialise

#: Factors that are folded in one task, and numbers of a vector beyond the rank.
FOLD, SPARE = 64, 8
#: A direction goes whose weight is this much below the first one's.
NOTHING = 1e-12


def _stacked(batch: pa.RecordBatch, column: str = "x") -> np.ndarray:
    return np.array(batch.column(column).flatten().to_numpy(), float).reshape(batch.num_rows, -1)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a task as the triangular factor of their QR factorisation."""
    held = None
    for batch in batches:
        if batch.num_rows:
            rows = _stacked(batch)
            held = np.linalg.qr(rows if held is None else np.vstack([held, rows]), mode="r")
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.list_(pa.float64()))], names=["x"])


def triangular(thin: DataFrame, width: int) -> np.ndarray:
    """The factor R of the QR factorisation of a table of rows ``x``, up to signs: a tree over tasks."""
    parts = thin.select("x").mapInArrow(_folded, "x array<double>")
    tasks = thin.rdd.getNumPartitions()
    while tasks > FOLD:
        tasks = -(-tasks // FOLD)
        parts = materialise(parts, "folded").repartition(tasks).mapInArrow(_folded, "x array<double>")
    rows = [r["x"] for r in parts.collect()]  # FOLD times the width at most
    return np.linalg.qr(np.array(rows, float).reshape(-1, width), mode="r") if rows else np.zeros((0, width))


def times(thin: DataFrame, by: np.ndarray) -> DataFrame:
    """Each row ``x`` multiplied by a small matrix; other columns stay."""
    others = [f for f in thin.schema.fields if f.name != "x"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _stacked(batch) @ by if batch.num_rows else np.zeros((0, by.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(list(rows), pa.list_(pa.float64()))], names=[*(f.name for f in others), "x"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return thin.select(*[f.name for f in others], "x").mapInArrow(task, f"{kind}, x array<double>")


def orthonormal(thin: DataFrame, width: int, passes: int = 2) -> tuple[DataFrame, np.ndarray]:
    """The same columns' span with orthonormal columns, and what takes them back: the table times that is ``thin``."""
    back, by = np.eye(width), np.eye(width)
    for _ in range(passes):
        _, weights, turn = np.linalg.svd(triangular(times(thin, by), back.shape[0]), full_matrices=False)
        real = weights > NOTHING * max(weights.max(initial=0.0), 1e-300)
        by = by @ (turn[real].T / weights[real])
        back = weights[real, None] * turn[real] @ back
    return times(thin, by), back


def product(cells: DataFrame, thin: DataFrame, by: str, to: str, width: int) -> DataFrame:
    """The matrix (row, col, v) times a thin one that has a vector ``x`` for each ``by``: a vector for each ``to``."""
    met = cells.join(thin, by).groupBy(to).agg(*[F.sum(F.col("v").cast("double") * F.col("x")[k]).alias(f"x{k}") for k in range(width)])
    return materialise(met.select(to, F.array(*[f"x{k}" for k in range(width)]).alias("x")), "product")


def thin_factors(cells: DataFrame, rank: int, rounds: int = 12, seed: int = 0) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Left factors (row, u: scaled by the singular values), right factors (col, w), singular values; (row, col) cells are distinct."""
    cells = materialise(cells.select("row", "col", "v"), "cells")
    columns = cells.select("col").distinct()
    width = min(rank + SPARE, columns.count(), cells.select("row").distinct().count())
    if not width:
        none = F.array().cast("array<double>")
        return cells.select("row", none.alias("u")), cells.select("col", none.alias("w")), np.zeros(0)
    # any start will do that depends on names alone; it is as good as random
    uniform = lambda k: (F.xxhash64(F.lit(seed), F.lit(k), F.col("col")) / F.lit(2.0**63)).cast("double")
    right, back = orthonormal(materialise(columns.select("col", F.array(*[uniform(k) for k in range(width)]).alias("x")), "start"), width)
    for _ in range(rounds):
        # between rounds the span matters, not the last digits of its columns
        left, back = orthonormal(product(cells, right, "col", "row", len(back)), len(back), 1)
        right, back = orthonormal(product(cells, left, "row", "col", len(back)), len(back), 1)
    right, back = orthonormal(materialise(right, "right"), len(back))
    left, back = orthonormal(product(cells, right, "col", "row", len(back)), len(back))
    u, values, vt = np.linalg.svd(back, full_matrices=False)
    k = min(rank, len(values))
    a = times(left, u[:, :k] * values[:k]).withColumnRenamed("x", "u")
    b = times(right, vt[:k].T).withColumnRenamed("x", "w")
    return materialise(a, "left"), materialise(b, "right"), values[:k]
