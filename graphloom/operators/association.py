"""Association of concept pairs: counts, PPMI, and low-rank smoothing of sparse matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.factors import thin_factors
from graphloom.operators.tables import numbered
from graphloom.operators.vectors import top_products
from graphloom.runtime import materialise

OTHER = "<OOV>"


def vocabulary(edges: DataFrame) -> DataFrame:
    """concept, at: numbers in alphabetical order from 1; 0 is for what is not in it."""
    words = edges.select(F.explode(F.array("src", "dst")).alias("concept")).distinct()
    numbered = words.withColumn("at", F.row_number().over(Window.orderBy("concept")))
    return numbered.unionByName(words.sparkSession.range(1).select(F.lit(OTHER).alias("concept"), F.lit(0).alias("at")))


def marginals(cells: DataFrame) -> DataFrame:
    """row, col, v with row_sum, col_sum and total. Sums are aggregated and joined, so a heavy row is no single task."""
    rows = cells.groupBy("row").agg(F.sum("v").alias("row_sum"))
    columns = cells.groupBy("col").agg(F.sum("v").alias("col_sum"))
    total = cells.agg(F.sum("v").alias("total"))
    return cells.join(rows, "row").join(columns, "col").join(F.broadcast(total)).select("row", "col", "v", "row_sum", "col_sum", "total")  # one row


def ppmi(cells: DataFrame) -> DataFrame:
    """row, col, v: positive pointwise mutual information of the counts."""
    value = F.log(F.col("total").cast("double")) + F.log(F.col("v").cast("double")) - F.log(F.col("row_sum").cast("double")) - F.log(F.col("col_sum").cast("double"))
    return marginals(cells).select("row", "col", F.least(F.greatest(value, F.lit(0.0)), F.lit(1e12)).alias("v"))


def lookup(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """row, col, score of pairs (row, col): their cell, or 0."""
    return pairs.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("score"))


def truncated_svd(cells: DataFrame, rank: int, most_nodes: int = 200_000, rounds: int = 12, seed: int = 0) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Left factors (row, u: scaled by the singular values), right factors (col, w), singular values.

    Subspace iteration: each round multiplies the sparse matrix by a thin one of width ``rank`` + 8 and
    back, as a distributed sum over cells. With up to ``most_nodes`` rows and columns thin matrices are
    on the driver; with more they are tables (:func:`graphloom.operators.factors.thin_factors`).
    """
    spark = cells.sparkSession
    cells = materialise(cells.select("row", "col", "v"), "cells")  # read in every round
    if any(cells.select(c).distinct().limit(most_nodes + 1).count() > most_nodes for c in ("row", "col")):
        return thin_factors(cells, rank, rounds, seed)
    rows = [r["row"] for r in cells.select("row").distinct().orderBy("row").collect()]
    columns = [r["col"] for r in cells.select("col").distinct().orderBy("col").collect()]
    at_row, at_column = ({x: i for i, x in enumerate(xs)} for xs in (rows, columns))
    width = min(rank + 8, len(rows), len(columns))

    def product(thin: np.ndarray, by: str) -> np.ndarray:
        """The matrix times a thin one (``by`` col), or its transpose times one (``by`` row)."""
        shared = spark.sparkContext.broadcast((thin, at_row, at_column))
        size = len(rows) if by == "col" else len(columns)

        def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x, r, c = shared.value
            for batch in batches:
                i, j = batch["row"].map(r).to_numpy(), batch["col"].map(c).to_numpy()
                to, of = (i, j) if by == "col" else (j, i)
                places, back = np.unique(to, return_inverse=True)
                out = np.zeros((len(places), x.shape[1]))
                np.add.at(out, back, batch["v"].to_numpy(float)[:, None] * x[of])
                yield pd.DataFrame({"at": places, "x": list(out)})

        summed = cells.mapInPandas(task, "at long, x array<double>").groupBy("at").agg(F.array(*[F.sum(F.col("x")[k]) for k in range(thin.shape[1])]).alias("x")).toPandas()
        out = np.zeros((size, thin.shape[1]))
        if len(summed):
            out[summed["at"].to_numpy(int)] = np.stack(summed["x"].to_numpy())
        return out

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(len(columns), width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(product(product(basis, "col"), "row"))[0]
    u, s, vt = np.linalg.svd(product(basis, "col"), full_matrices=False)
    k = min(rank, len(s))
    left, right = u[:, :k] * s[:k], (vt[:k] @ basis.T).T
    name = lambda kind: cells.schema[kind].dataType.simpleString()
    a = spark.createDataFrame([(x, left[i].tolist()) for x, i in at_row.items()], f"row {name('row')}, u array<double>")
    b = spark.createDataFrame([(x, right[i].tolist()) for x, i in at_column.items()], f"col {name('col')}, w array<double>")
    return a, b, s[:k]


def svd_scores(cells: DataFrame, pairs: DataFrame, rank: int, most_nodes: int = 200_000) -> DataFrame:
    """row, col, score of pairs by the smoothed matrix; unknown rows and columns score 0."""
    left, right, _ = truncated_svd(cells, rank, most_nodes)
    value = F.aggregate(F.zip_with("u", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(left, "row", "left").join(right, "col", "left").select("row", "col", F.coalesce(value, F.lit(0.0)).alias("score"))


def all_pairs(nodes: DataFrame, most_nodes: int = 30_000) -> DataFrame:
    """row, col: every ordered pair, a concept with itself included. The number of concepts is bounded, and the result is not to be stored."""
    n = nodes.distinct().count()
    if n > most_nodes:
        raise ValueError(f"all_pairs: more than {most_nodes} concepts")
    names = nodes.select(F.col(nodes.columns[0]).alias("row")).distinct()
    return names.crossJoin(F.broadcast(names.withColumnRenamed("row", "col")))


def top_pairs(scored: DataFrame, n_nodes: int, factor: float = 10.0) -> DataFrame:
    """The ``min(int(n * factor), n * n)`` highest scores; ties in order of row, col."""
    return scored.orderBy(F.desc("score"), "row", "col").limit(min(int(n_nodes * factor), n_nodes * n_nodes))


def top_cells(cells: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """row, col, score: the ``k`` best pairs of nodes (id) where a pair without a cell scores 0; ties in order of row, col.

    Pairs have numbers in the order of their names, so of those without a cell only the first are looked at: as many as
    are asked for, and one more for each cell.
    """
    names = materialise(numbered(nodes.select(F.col(nodes.columns[0]).alias("name")).filter("name is not null").distinct(), "name"), "names")
    n = names.count()
    end = lambda c: names.select(F.col("name").alias(c), F.col("at").alias(f"_{c}"))
    known = materialise(cells.select("row", "col", F.col("v").cast("double").alias("score")).join(end("row"), "row").join(end("col"), "col").withColumn("pair", F.col("_row") * n + F.col("_col")), "known")
    first = min(n * n, k + known.count())
    free = known.sparkSession.range(first).select(F.col("id").alias("pair")).join(known, "pair", "left_anti")
    free = free.withColumn("_row", F.expr(f"pair div {max(n, 1)}L")).withColumn("_col", F.expr(f"pair % {max(n, 1)}L")).join(end("row"), "_row").join(end("col"), "_col")
    best = known.select("row", "col", "score", "pair").unionByName(free.select("row", "col", F.lit(0.0).alias("score"), "pair"))
    return numbered(best, F.desc("score"), "pair").filter(F.col("at") < k).select("row", "col", "score")


def smoothed_graph(cells: DataFrame, concepts: DataFrame, rank: int, factor: float = 10.0) -> DataFrame:
    """src, dst, weight: the best-scored pairs of given concepts by the smoothed PPMI matrix; rows are sources.

    Scores are products of factors, so the best ones are searched in blocks (:func:`top_products`). A
    concept that the matrix does not know has factors of 0.
    """
    names = materialise(concepts.select(F.col(concepts.columns[0]).alias("id")).filter("id is not null").distinct(), "concepts")
    n = names.count()
    left, right, values = truncated_svd(ppmi(cells), rank)
    zeros = F.array(*[F.lit(0.0)] * len(values))
    side = lambda f, key, x: names.join(f.select(F.col(key).alias("id"), x), "id", "left").select("id", F.coalesce(x, zeros).alias("embed"))
    best = top_products(side(left, "row", "u"), side(right, "col", "w"), min(int(n * factor), n * n))
    return best.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("score").alias("weight"))


def classified_pairs(pairs: DataFrame, scorer, keep: int | None = None) -> DataFrame:
    """row, col, score by a vectorised model of two texts; with ``keep`` only so many best."""
    scored = pairs.withColumn("score", scorer("row", "col"))
    return scored if keep is None else scored.orderBy(F.desc("score"), "row", "col").limit(keep)


def positive_probability(logits: Column) -> Column:
    """The second class's share of two logits."""
    return 1 / (1 + F.exp(logits[0] - logits[1]))
