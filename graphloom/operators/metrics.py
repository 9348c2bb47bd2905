"""Literal comparison of graphs, curves, and choices among settings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.similarity import precision_recall
from graphloom.operators.tables import running


def _literal(p: DataFrame, t: DataFrame) -> DataFrame:
    """Both sides counted in one pass over their union."""
    keys = p.columns
    marked = p.distinct().withColumn("_p", F.lit(1)).withColumn("_t", F.lit(0)).unionByName(t.distinct().withColumn("_p", F.lit(0)).withColumn("_t", F.lit(1)))
    each = marked.groupBy(*keys).agg(F.max("_p").alias("p"), F.max("_t").alias("t"))
    counts = each.agg(F.sum(F.col("p") * F.col("t")).alias("hits"), F.sum("p").alias("np"), F.sum("t").alias("nt"))
    return precision_recall(counts, "hits", "np", "hits", "nt")


def node_scores(pred: Graph, true: Graph) -> DataFrame:
    """One row, precision, recall, f1 over distinct titles; zeros with an empty side."""
    return _literal(pred.vertices.select("title"), true.vertices.select("title"))


def edge_scores(pred: Graph, true: Graph) -> DataFrame:
    """One row, precision, recall, f1 over distinct titled edges."""
    return _literal(pred.titled_edges().select("src", "dst"), true.titled_edges().select("src", "dst"))


def precision_recall_curve(scored: DataFrame, n_true: int) -> DataFrame:
    """score, precision, recall at each distinct threshold. ``scored``: score, hit (0 or 1).

    One pass over the distinct scores in place of pruning anew for each.
    """
    each = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    n, h = F.col("n"), F.col("h")
    return running(each, F.desc("score"), "n", "h").select("score", (h / n).alias("precision"), (F.try_divide(h, F.lit(n_true))).alias("recall"))


def average_precision(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """ap (trapezoids over recall, from 0 at the first precision) and best_f1 of each curve."""
    keys = by or []
    order = Window.partitionBy(*keys).orderBy("recall", F.desc("precision"))
    last_r, last_p = F.lag("recall", 1, 0.0).over(order), F.coalesce(F.lag("precision").over(order), F.col("precision"))
    steps = curve.select(*keys, ((F.col("recall") - last_r) * (F.col("precision") + last_p) / 2).alias("area"), F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)).alias("f1"))
    return steps.groupBy(*keys).agg(F.sum("area").alias("ap"), F.max("f1").alias("best_f1"))


def best_setting(results: DataFrame, metric: str, order: str = "row_idx") -> DataFrame:
    """The row with the highest metric, nulls skipped, the first of ties; an error if there is none."""
    best = results.filter(F.col(metric).isNotNull() & ~F.isnan(metric)).orderBy(F.desc(metric), order).limit(1)
    if best.isEmpty():
        raise ValueError(f"no result has {metric}")
    return best


def venn(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """in_<name> flags and n: how many keys lie in exactly those parts."""
    marked = reduce(lambda a, b: a.unionByName(b), [f.select(*keys).distinct().select(*keys, *[F.lit(int(n == m)).alias(f"in_{m}") for m in parts]) for n, f in parts.items()])
    each = marked.groupBy(*keys).agg(*[F.max(f"in_{m}").alias(f"in_{m}") for m in parts])
    return each.groupBy(*[f"in_{m}" for m in parts]).agg(F.count("*").alias("n"))


def classification_scores(predictions: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """One row: accuracy, precision, recall, f1 of class 1."""
    hit, p, t = (F.col(label) == 1) & (F.col(predicted) == 1), F.col(predicted) == 1, F.col(label) == 1
    counts = predictions.agg(F.avg((F.col(label) == F.col(predicted)).cast("int")).alias("accuracy"), F.count_if(hit).alias("h"), F.count_if(p).alias("p"), F.count_if(t).alias("t"))
    ratio = lambda b: F.coalesce(F.try_divide(F.col("h").cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = counts.select("accuracy", ratio("p").alias("precision"), ratio("t").alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
