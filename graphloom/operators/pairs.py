"""A classifier of concept pairs: is the one the parent of the other?

Pairs of titles become hashed features (words of each side, what they share, how the one stands in the other), made of
built-in functions. Logistic regression over them is fitted by limited-memory BFGS: gradients are summed up by
task and then by feature, so that the driver sees one vector of ``dims`` numbers a pass, however many pairs there are. It
stops when the loss on a held part has not fallen for some rounds, and keeps the weights that were best there.

Empty and null titles have no words; a held part without pairs never stops it; no pairs to learn from are an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.runtime import materialise

DIMS = 1 << 16
#: Steps that are remembered, and halvings of a step before it is given up.
MEMORY, HALVINGS = 10, 12
#: Rows of a pass's result that are no feature: loss and rows, for learning and held.
LOSS, ROWS, HELD_LOSS, HELD_ROWS = -1, -2, -3, -4


def words(x: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def features(src: Column, dst: Column, dims: int = DIMS) -> Column:
    """array<int>: the distinct hashed features of a pair (parent, child), the first for all pairs."""
    a, b = words(src), words(dst)
    tag = lambda name, xs: F.transform(xs, lambda w: F.concat(F.lit(name), w))
    shared = F.array_intersect(a, b)
    tenths = lambda of: F.coalesce(F.floor(F.try_divide(F.size(shared) * 10, F.size(F.array_distinct(of)))).cast("string"), F.lit("-"))
    plain = lambda x: F.lower(F.coalesce(x, F.lit("")))
    flag = lambda name, c: F.concat(F.lit(name), c.cast("string"))
    single = [
        F.lit("all"),
        F.concat(F.lit("of parent "), tenths(a)),
        F.concat(F.lit("of child "), tenths(b)),
        flag("begins ", plain(dst).startswith(plain(src))),
        flag("ends ", plain(dst).endswith(plain(src))),
        flag("around ", plain(src).contains(plain(dst))),
        flag("equal ", plain(src) == plain(dst)),
        F.concat(F.lit("longer "), F.greatest(F.lit(-5), F.least(F.lit(5), F.size(b) - F.size(a))).cast("string")),
        F.concat(F.lit("sizes "), F.least(F.lit(6), F.size(a)).cast("string"), F.lit(" "), F.least(F.lit(6), F.size(b)).cast("string")),
        F.concat(F.lit("last "), F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")), F.lit(" "), F.coalesce(F.try_element_at(b, F.lit(-1)), F.lit(""))),
        F.concat(F.lit("first "), F.coalesce(F.get(a, F.lit(0)), F.lit("")), F.lit(" "), F.coalesce(F.get(b, F.lit(0)), F.lit(""))),
    ]
    names = F.concat(F.array(*single), tag("parent ", a), tag("child ", b), tag("both ", shared), tag("only child ", F.array_except(b, a)))
    return F.array_distinct(F.transform(names, lambda x: F.pmod(F.xxhash64(x), F.lit(dims)).cast("int")))


def _margins(column: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of weights of each row's features; the features of all rows, and the row of each."""
    at = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
    return np.bincount(row, weights[at], minlength=len(column)), at, row


def gradient(table: DataFrame, weights: np.ndarray, l2: float = 0.0) -> tuple[float, np.ndarray, float]:
    """Mean logistic loss of the rows to learn from (features, label, held) with its gradient, and the mean loss of those held; one pass."""
    shared = table.sparkSession.sparkContext.broadcast(weights)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        total, slope = dict.fromkeys((LOSS, ROWS, HELD_LOSS, HELD_ROWS), 0.0), np.zeros(w.size)
        for batch in batches:
            if not batch.num_rows:
                continue
            margin, at, row = _margins(batch.column("features"), w)
            label, held = batch.column("label").to_numpy().astype(float), batch.column("held").to_numpy(zero_copy_only=False)
            loss = np.logaddexp(0, margin) - label * margin
            for name, value in ((LOSS, loss[~held].sum()), (ROWS, (~held).sum()), (HELD_LOSS, loss[held].sum()), (HELD_ROWS, held.sum())):
                total[name] += float(value)
            wrong = np.where(held, 0.0, 1 / (1 + np.exp(-margin)) - label)
            slope += np.bincount(at, wrong[row], minlength=w.size)
        some = np.flatnonzero(slope)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([list(total), some]).astype(np.int64)), pa.array(np.concatenate([list(total.values()), slope[some]]))], names=["at", "v"])

    summed = table.select("features", "label", "held").mapInArrow(task, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # one row a feature at most
    found = dict(zip(summed["at"].tolist(), summed["v"].tolist(), strict=True))
    rows = found.get(ROWS, 0.0)
    if not rows:
        raise ValueError("no pairs to learn from")
    out = np.zeros(weights.size)
    is_feature = (summed["at"] >= 0).to_numpy()
    out[summed["at"].to_numpy()[is_feature]] = summed["v"].to_numpy()[is_feature] / rows
    held = found[HELD_LOSS] / found[HELD_ROWS] if found.get(HELD_ROWS) else float("nan")
    return found[LOSS] / rows + l2 * float(weights @ weights) / 2, out + l2 * weights, held


def direction(slope: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Minus the gradient, bent by the curvature of the last steps."""
    q, parts = slope.copy(), []
    for s, y in zip(reversed(steps), reversed(changes), strict=True):
        a = (s @ q) / (y @ s)
        q -= a * y
        parts.append(a)
    if steps:
        q *= (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, a in zip(steps, changes, reversed(parts), strict=True):
        q += (a - (y @ q) / (y @ s)) * s
    return -q


@dataclass
class PairModel:
    """Weights by hashed feature, and the (loss, held loss) of each round."""

    weights: np.ndarray
    history: list[tuple[float, float]] = field(default_factory=list)

    def scorer(self, spark: SparkSession) -> Callable[[str, str], Column]:
        """(parent, child) -> probability, as :func:`graphloom.operators.association.classified_pairs` wants it."""
        shared = spark.sparkContext.broadcast(self.weights)

        @F.pandas_udf("double")
        def probability(at: pd.Series) -> pd.Series:
            sums = at.map(lambda a: float(shared.value[np.asarray(a, np.int64)].sum()))
            return 1 / (1 + np.exp(-sums.astype(float)))

        return lambda a, b: probability(features(F.col(a), F.col(b), self.weights.size))


def train(learn: DataFrame, held: DataFrame, dims: int = DIMS, l2: float = 1e-6, rounds: int = 60, patience: int = 3) -> PairModel:
    """A model from pairs (src, dst, label 0 or 1); ``held`` are those that say when to stop."""
    rows = learn.select("src", "dst", "label", F.lit(False).alias("held")).unionByName(held.select("src", "dst", "label", F.lit(True).alias("held")))
    table = materialise(rows.select(features(F.col("src"), F.col("dst"), dims).alias("features"), F.col("label").cast("int").alias("label"), "held"), "pair-features")
    weights = np.zeros(dims)
    loss, slope, apart = gradient(table, weights, l2)
    steps: list[np.ndarray] = []
    changes: list[np.ndarray] = []
    best, least, worse = weights, np.inf if np.isnan(apart) else apart, 0
    history = [(loss, apart)]
    for _ in range(rounds):
        way = direction(slope, steps, changes)
        if way @ slope >= 0:  # rounding has spoilt the memory
            steps, changes, way = [], [], -slope
        size = 1.0 if steps else min(1.0, 1 / max(np.linalg.norm(slope), 1e-12))
        for _ in range(HALVINGS):
            there = weights + size * way
            new_loss, new_slope, apart = gradient(table, there, l2)
            if new_loss <= loss + 1e-4 * size * float(way @ slope):
                break
            size /= 2
        else:
            break
        step, change = there - weights, new_slope - slope
        if step @ change > 1e-12:
            steps, changes = [*steps, step][-MEMORY:], [*changes, change][-MEMORY:]
        settled = loss - new_loss < 1e-7 * max(1.0, abs(loss))
        weights, loss, slope = there, new_loss, new_slope
        history.append((loss, apart))
        if np.isnan(apart) or apart < least:
            best, least, worse = weights, apart if not np.isnan(apart) else least, 0
        else:
            worse += 1
        if worse >= patience or settled:
            break
    return PairModel(best, history)
