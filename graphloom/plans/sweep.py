"""The sweep over pruning settings, and the evaluation with the best one."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import asdict, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import metrics, prune, similarity, structure
from graphloom.operators.assignment import BOUND, assign
from graphloom.runtime import materialise


def grid(n_edges: int, points: int = 11) -> list[tuple[float, float]]:
    """(absolute, relative) percentiles: both dense towards keeping little, the larger graphs first."""
    n = max(n_edges, 2)
    absolute = (1 - np.geomspace(1 / n, 1, points))[::-1]
    relative = 1 - np.geomspace(0.1, 1, points) + 0.1
    return [(float(a), float(min(1.0, r))) for a in absolute for r in relative]


def pruned_by_setting(graph: Graph, settings: list[tuple[float, float]], base: prune.Settings = prune.Settings()) -> DataFrame:
    """setting, absolute, relative, src, dst, weight: what each setting keeps.

    Ranks and running shares are found once; each setting is then a filter on them. A
    relative rule needs one aggregate by source and distinct relative percentile.
    """
    spark, n = graph.edges.sparkSession, graph.edges.count()
    marked = materialise(prune.flagged(graph.edges), "flagged")
    table = spark.createDataFrame([(i, a, r, prune.absolute_cut(n, a)) for i, (a, r) in enumerate(settings)], "setting int, absolute double, relative double, cut long")
    shares = spark.createDataFrame([(r,) for r in sorted({r for _, r in settings})], "relative double")
    # both tables hold one row for each point of the grid
    cuts = marked.join(F.broadcast(shares)).groupBy("src", "relative").agg(F.max(F.when(F.col("cum") > F.col("relative"), F.col("weight"))).alias("least"))
    keep = (F.col("rank") > F.col("cut")) & ((F.col("relative") == 1.0) | F.coalesce(F.col("weight") > F.col("least"), F.lit(False)))
    if base.remove_inverse_edges:
        keep &= ~F.col("is_inverse")
    if base.remove_self_loops:
        keep &= ~F.col("is_loop")
    return marked.join(cuts, "src").join(F.broadcast(table), "relative").filter(keep).select("setting", "absolute", "relative", "src", "dst", "weight")


def rooted_by_setting(kept: DataFrame, root: str) -> DataFrame:
    """Adds, for each setting, edges of weight 1 from the root to vertices without incoming edges, where the root is none of them."""
    ends = kept.select("setting", "absolute", "relative", F.explode(F.array("src", "dst")).alias("id")).distinct()
    has = ends.filter(F.col("id") == root).select("setting").distinct()
    tops = ends.join(kept.select("setting", F.col("dst").alias("id")).distinct(), ["setting", "id"], "left_anti").join(has, "setting", "left_anti")
    return kept.unionByName(tops.select("setting", "absolute", "relative", F.lit(root).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight")))


def sweep(pred: Graph, true: Graph, embeds: DataFrame, settings: list[tuple[float, float]], threshold: float = 0.436, base: prune.Settings = prune.Settings(), most_cost: float = BOUND) -> DataFrame:
    """setting, absolute, relative and the soft and hard edge scores of each point of the grid, null beyond the cost bound.

    All points are scored in parallel, one task each; a point's edges and the truth's are
    bounded by the cost that is checked before they are sent.
    """
    kept = rooted_by_setting(pruned_by_setting(pred, settings, base), "Main topic classifications") if base.add_root and pred.root is None else pruned_by_setting(pred, settings, base)
    kept = materialise(kept, "kept")
    t = true.titled_edges().select("src", "dst")
    m = t.count()
    sizes = kept.groupBy("setting").agg(F.count("*").alias("n")).withColumn("able", F.pow(F.least("n", F.lit(m)), 2) * F.greatest("n", F.lit(m)) <= most_cost)
    e = embeds.select("title", "embed")
    both = lambda f: f.join(e.select(F.col("title").alias("src"), F.col("embed").alias("a")), "src", "left").join(e.select(F.col("title").alias("dst"), F.col("embed").alias("b")), "dst", "left")
    able = sizes.filter("able").select("setting")
    mine = both(kept.join(able, "setting").select("setting", "src", "dst")).withColumn("side", F.lit(0))
    theirs = both(t).join(F.broadcast(able)).select("setting", "src", "dst", "a", "b").withColumn("side", F.lit(1))  # one row a setting
    columns = [f"edge_{k}_{s}" for k in ("soft", "hard") for s in ("precision", "recall", "f1")]

    def score(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["src", "dst"])
        p, q = frame[frame.side == 0], frame[frame.side == 1]
        if not len(p) or not len(q):
            return pd.DataFrame([[key[0], *[0.0] * 6]], columns=["setting", *columns])
        sims = similarity.edge_similarities(p, q)
        total = float(sims[assign(sims)].sum(dtype=float))
        near = sims >= threshold
        out = []
        for x, y in ((total / len(p), total / len(q)), (near.any(axis=1).mean(), near.any(axis=0).mean())):
            out += [x, y, 2 * x * y / (x + y) if x + y else 0.0]
        return pd.DataFrame([[key[0], *out]], columns=["setting", *columns])

    scored = mine.select("setting", "src", "dst", "a", "b", "side").unionByName(theirs).groupBy("setting").applyInPandas(score, "setting int, " + ", ".join(f"{c} double" for c in columns))
    spark = pred.edges.sparkSession
    table = spark.createDataFrame([(i, a, r) for i, (a, r) in enumerate(settings)], "setting int, absolute double, relative double")
    empty = sizes.select("setting", F.lit(False).alias("empty"))
    out = table.join(scored, "setting", "left").join(empty, "setting", "left")
    return out.select("setting", "absolute", "relative", *[F.when(F.col("empty").isNull(), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in columns])


def best_settings(results: DataFrame, metric: str, base: prune.Settings = prune.Settings()) -> prune.Settings:
    row = metrics.best_setting(results, metric, "setting").first()
    return replace(base, absolute_percentile=row["absolute"], relative_percentile=row["relative"])


#: name -> (pred, true, embeds) -> one row with precision, recall, f1 or a single value.
METRICS: dict[str, Callable[[Graph, Graph, DataFrame], DataFrame]] = {
    "node": lambda p, t, e: metrics.node_scores(p, t),
    "edge": lambda p, t, e: metrics.edge_scores(p, t),
    "edge_hard": lambda p, t, e: similarity.edge_match(p, t, e, 0.436),
    "edge_soft": lambda p, t, e: similarity.soft_edge_match(p, t, e, math.inf),  # its cost is not guarded here
    "graph": lambda p, t, e: similarity.graph_match(_embedded(p, e), _embedded(t, e), 2, "forward"),
    "motif": lambda p, t, e: structure.motif_distance(structure.motif_census(p.edges), structure.motif_census(t.edges)),
}


def _embedded(graph: Graph, embeds: DataFrame) -> Graph:
    return replace(graph, vertices=graph.vertices.select("id", "title").join(embeds.select("title", "embed"), "title"))


def evaluate(name: str, pred: Graph, true: Graph, embeds: DataFrame, settings: prune.Settings) -> DataFrame:
    """One row: name, the settings, sizes and every metric after post-processing."""
    done = prune.post_process(pred, settings)
    done = replace(done, vertices=materialise(done.vertices.select("id", "title"), "vertices"), edges=materialise(done.edges, "edges"))
    spark = pred.edges.sparkSession
    out = spark.range(1).select(F.lit(name).alias("name"), F.struct(*[F.lit(v).alias(k) for k, v in asdict(settings).items()]).alias("hp"), F.lit(done.vertices.count()).alias("num_nodes"), F.lit(done.edges.count()).alias("num_edges"))
    for metric, f in METRICS.items():
        row = f(done, true, embeds)
        out = out.join(row.select(*[F.col(c).alias(f"{metric}_{c}") for c in row.columns]))  # one row each
    return out


def catalogue(rows: list[dict], spark) -> DataFrame:
    """Experiments as a table; columns that only some have are null elsewhere."""
    columns = sorted({k for r in rows for k in r})
    kinds = {k: next((type(r[k]) for r in rows if r.get(k) is not None), str) for k in columns}
    sql = {int: "bigint", float: "double", bool: "boolean"}
    return spark.createDataFrame([tuple(r.get(k) for k in columns) for r in rows], ", ".join(f"{k} {sql.get(kinds[k], 'string')}" for k in columns))


def ordered(results: DataFrame, by: str = "setting") -> DataFrame:
    return results.withColumn("row_idx", F.row_number().over(Window.orderBy(by)))  # one row a point of the grid
