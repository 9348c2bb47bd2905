"""Pruning of weighted edges, and the post-processing that combines the rules."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import ROOT
from graphloom.graph import Graph, endpoints
from graphloom.operators.tables import numbered


@dataclass(frozen=True)
class Settings:
    """``relative_percentile`` is the share kept of each node's outgoing weight. ``prune_unconnected_nodes`` has no effect."""

    absolute_percentile: float = 0.0
    relative_percentile: float = 1.0
    remove_self_loops: bool = True
    remove_inverse_edges: bool = True
    prune_unconnected_nodes: bool = False
    add_root: bool = True


def weight_ranks(edges: DataFrame) -> DataFrame:
    """Adds ``rank``: the place (from 1) in the order by weight, src, dst, counted over sorted ranges, none of which holds all edges."""
    return numbered(edges, "weight", "src", "dst", name="rank").withColumn("rank", F.col("rank") + 1)


def outgoing_shares(edges: DataFrame) -> DataFrame:
    """Adds ``cum``: the running share of the source's outgoing weight, heaviest first, up to and with this edge."""
    ordered = Window.partitionBy("src").orderBy(F.desc("weight"), "dst").rowsBetween(Window.unboundedPreceding, 0)
    return edges.withColumn("cum", F.try_divide(F.sum("weight").over(ordered), F.sum("weight").over(Window.partitionBy("src"))))


def absolute_cut(n_edges: int, percentile: float) -> int:
    """How many edges the absolute rule removes."""
    return n_edges if percentile == 1 else int(percentile * n_edges)


def prune_absolute(edges: DataFrame, percentile: float) -> DataFrame:
    """Without the lightest ``int(percentile * n)`` edges; ties go by src, dst."""
    return weight_ranks(edges).filter(F.col("rank") > absolute_cut(edges.count(), percentile)).drop("rank")


def prune_relative(edges: DataFrame, percentile: float) -> DataFrame:
    """For each source: finds the edge at which the running share first exceeds ``percentile``, and keeps only heavier ones.

    With 1 nothing is removed. Without such an edge, all of the source's edges go.
    """
    if percentile == 1:
        return edges
    cut = F.max(F.when(F.col("cum") > percentile, F.col("weight"))).over(Window.partitionBy("src"))
    return outgoing_shares(edges).withColumn("_cut", cut).filter(F.col("weight") > F.col("_cut")).drop("cum", "_cut")


def prune_relative_inclusive(edges: DataFrame, percentile: float) -> DataFrame:
    """The published variant: lightest first, removes edges while their running share is at most ``percentile``."""
    ordered = Window.partitionBy("src").orderBy("weight", F.desc("dst")).rowsBetween(Window.unboundedPreceding, 0)
    share = F.try_divide(F.sum("weight").over(ordered), F.sum("weight").over(Window.partitionBy("src")))
    return edges.withColumn("_share", share).filter(F.col("_share") > percentile).drop("_share")


def inverse_edges(edges: DataFrame) -> DataFrame:
    """src, dst of edges whose reverse is heavier; of equal ones neither."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("_back"))
    return edges.join(back, ["src", "dst"]).filter("_back > weight").select("src", "dst")


def prune_inverse(edges: DataFrame) -> DataFrame:
    return edges.join(inverse_edges(edges), ["src", "dst"], "left_anti").select(*edges.columns)


def prune_self_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def flagged(edges: DataFrame) -> DataFrame:
    """Adds what every setting's decision needs: rank, cum, is_inverse and is_loop, all on the raw graph."""
    back = inverse_edges(edges).withColumn("is_inverse", F.lit(True))
    return outgoing_shares(weight_ranks(edges)).join(back, ["src", "dst"], "left").withColumn("is_inverse", F.coalesce("is_inverse", F.lit(False))).withColumn("is_loop", F.col("src") == F.col("dst"))


def post_process(graph: Graph, settings: Settings) -> Graph:
    """All rules judge the raw graph, and an edge goes if any says so. Vertices without edges vanish. May add a root."""
    edges = graph.edges
    cut = absolute_cut(edges.count(), settings.absolute_percentile)
    marked = flagged(edges)
    least = F.max(F.when(F.col("cum") > settings.relative_percentile, F.col("weight"))).over(Window.partitionBy("src"))
    keep = F.col("rank") > cut
    if settings.relative_percentile != 1:
        marked = marked.withColumn("_cut", least)
        keep &= F.coalesce(F.col("weight") > F.col("_cut"), F.lit(False))
    if settings.remove_inverse_edges:
        keep &= ~F.col("is_inverse")
    if settings.remove_self_loops:
        keep &= ~F.col("is_loop")
    left = marked.filter(keep).select("src", "dst", "weight")
    ids = endpoints(left)
    out = Graph(graph.vertices.join(ids, "id", "left_semi"), left, graph.root)
    return add_root(out) if settings.add_root else out


def add_root(graph: Graph, root: str = ROOT) -> Graph:
    """Where the root is None or no vertex: a new one, with an edge of weight 1 to each vertex without incoming edges."""
    if graph.root is not None and not graph.vertices.filter(F.col("id") == graph.root).isEmpty():
        return graph
    tops = graph.vertices.select("id").join(graph.edges.select(F.col("dst").alias("id")), "id", "left_anti").filter(F.col("id") != root)
    new = tops.select(F.lit(root).alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    one = graph.vertices.sparkSession.range(1).select(F.lit(root).alias("id"), F.lit(root).alias("title"))
    vertices = graph.vertices.filter(F.col("id") != root).unionByName(one, allowMissingColumns=True)
    return Graph(vertices, graph.edges.select("src", "dst", "weight").unionByName(new), root)
