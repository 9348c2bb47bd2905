"""Similarity of concepts and graphs by embeddings."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from graphloom.graph import Graph
from graphloom.operators.assignment import BOUND, best_assignment, by_slices
from graphloom.operators.vectors import best_matches, nearest, pairs_above  # noqa: F401  searches by cosine
from graphloom.runtime import materialise

@pandas_udf(ArrayType(FloatType()))
def trigram_embedding(titles: pd.Series) -> pd.Series:
    """Hashed character trigrams, 64 wide, of length 1. A stand-in for a sentence model, and no equal of one."""

    def one(text: str | None) -> np.ndarray:
        out = np.zeros(64, np.float32)
        padded = f"  {(text or '').lower()} "
        for i in range(len(padded) - 2):
            h = crc32(padded[i : i + 3].encode())
            out[h % 64] += 1.0 if h >> 16 & 1 else -1.0
        return out / max(float(np.linalg.norm(out)), 1e-9)

    return titles.map(one)


def embed(titles: DataFrame, embedder=trigram_embedding) -> DataFrame:
    """title, embed for each distinct title; ``embedder`` is any vectorised function from text to array<float>."""
    return titles.select("title").distinct().withColumn("embed", embedder("title"))


def embed_missing(vertices: DataFrame, embedder=trigram_embedding) -> DataFrame:
    """Fills ``embed`` where it is null, once for each title."""
    lacking = embed(vertices.filter("embed is null"), embedder).withColumnRenamed("embed", "_new")
    return vertices.join(lacking, "title", "left").withColumn("embed", F.coalesce("embed", "_new")).drop("_new")


def pooled(tokens: Column, mask: Column, how: str = "mean") -> Column:
    """Mean of the unmasked token vectors (array<array<double>>), or the first one."""
    if how == "cls":
        return tokens[0]
    kept = F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] != 0)
    zero = F.transform(tokens[0], lambda _: F.lit(0.0))
    return F.aggregate(kept, zero, lambda a, x: F.zip_with(a, x["t"], lambda p, q: p + q), lambda a: F.transform(a, lambda p: p / F.greatest(F.size(kept).cast("double"), F.lit(1e-9))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def scaled_cosine(a: Column, b: Column) -> Column:
    return (cosine(a, b) + 1) / 2


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return x / np.linalg.norm(x, axis=1, keepdims=True)


def convolved(graph: Graph, rounds: int, direction: str = "forward", embed_column: str = "embed") -> DataFrame:
    """id, embed after rounds of a graph convolution with identity weights.

    Each round is D^-1/2 (A + I) D^-1/2 X, degrees counting incoming edges and the loop. Weights play no part.
    """
    turned = {"forward": lambda g: g, "reverse": Graph.reverse, "undirected": Graph.undirected}
    if direction not in turned:
        raise ValueError(f"no direction {direction}")
    pairs = turned[direction](graph).edges.select("src", "dst").filter("src <> dst").distinct()
    loops = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    pairs = pairs.unionByName(loops)
    degree = pairs.groupBy(F.col("dst").alias("id")).agg((1 / F.sqrt(F.count("*").cast("double"))).alias("d"))
    scaled = pairs.join(degree.select(F.col("id").alias("src"), F.col("d").alias("x")), "src").join(degree.select(F.col("id").alias("dst"), F.col("d").alias("y")), "dst").select("src", "dst", (F.col("x") * F.col("y")).alias("c"))
    state = graph.vertices.select("id", F.posexplode(embed_column).alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    for _ in range(rounds):
        moved = scaled.join(state.withColumnRenamed("id", "src"), "src")
        state = moved.groupBy(F.col("dst").alias("id"), "i").agg(F.sum(F.col("v") * F.col("c")).alias("v"))
    return state.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("embed"))


def graph_similarity(a: Graph, b: Graph, rounds: int = 3, direction: str = "forward") -> DataFrame:
    """One row, similarity: the mean best cosine of each side's vertices, averaged; 0 with an empty side."""
    x, y = (materialise(convolved(g, rounds, direction), "convolved") for g in (a, b))
    one, two = (best_matches(*p).agg(F.avg("score").alias(n)) for p, n in (((x, y), "x"), ((y, x), "y")))
    return one.join(two).select(((F.coalesce("x", F.lit(0.0)) + F.coalesce("y", F.lit(0.0))) / 2).alias("similarity"))  # one row each


def _scores(total: float | None, n: int, m: int) -> tuple[float | None, float | None, float | None]:
    if total is None:
        return None, None, None
    p, r = total / n, total / m
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def graph_match(a: Graph, b: Graph, rounds: int = 3, direction: str = "forward") -> DataFrame:
    """One row, precision, recall, f1: best one-to-one matching of convolved vertices. Null beyond the cost bound."""
    n, m = a.vertices.count(), b.vertices.count()
    spark = a.vertices.sparkSession
    if not n or not m:
        return spark.range(1).select(*[F.lit(0.0).alias(c) for c in ("precision", "recall", "f1")])
    x, y = convolved(a, rounds, direction).withColumn("side", F.lit(0)), convolved(b, rounds, direction).withColumn("side", F.lit(1))

    def similarities(frame: pd.DataFrame) -> np.ndarray:
        frame = frame.sort_values("id")
        one, two = (_unit(frame[frame.side == k]["embed"]) for k in (0, 1))
        return by_slices(lambda at: one[at] @ two.T, len(one), len(two))

    return best_assignment(x.unionByName(y), similarities, n, m, _scores)


def edge_match(pred: Graph, true: Graph, embeds: DataFrame, threshold: float = 0.9) -> DataFrame:
    """One row, precision, recall, f1: edges that have some edge on the other side with both ends similar enough (>=).

    Distinct titles are compared once; the rest are two equi-joins on pairs of similar titles.
    """
    p, t = pred.titled_edges().select("src", "dst"), true.titled_edges().select("src", "dst")
    titles = lambda e: e.select(F.explode(F.array("src", "dst")).alias("title")).distinct().join(embeds, "title").select(F.col("title").alias("id"), "embed")
    near = pairs_above(titles(p), titles(t), threshold).select("a", "b")
    joined = p.select(F.col("src").alias("ps"), F.col("dst").alias("pd")).join(near.select(F.col("a").alias("ps"), F.col("b").alias("ts")), "ps").join(near.select(F.col("a").alias("pd"), F.col("b").alias("td")), "pd")
    hits = joined.join(t.select(F.col("src").alias("ts"), F.col("dst").alias("td")), ["ts", "td"]).select("ps", "pd", "ts", "td")
    found = hits.agg(F.count_distinct("ps", "pd").alias("hp"), F.count_distinct("ts", "td").alias("ht"))
    counts = found.join(p.agg(F.count("*").alias("np"))).join(t.agg(F.count("*").alias("nt")))  # one row each
    return precision_recall(counts, "hp", "np", "ht", "nt")


def precision_recall(counts: DataFrame, hits_p: str, n_p: str, hits_t: str, n_t: str) -> DataFrame:
    """precision, recall and f1, each 0 where it has nothing to divide by."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    out = counts.withColumn("precision", ratio(hits_p, n_p)).withColumn("recall", ratio(hits_t, n_t))
    return out.select("precision", "recall", safe_f1(F.col("precision"), F.col("recall")).alias("f1"))


def safe_f1(precision: Column, recall: Column) -> Column:
    return F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))


def edge_similarities(one: pd.DataFrame, two: pd.DataFrame) -> np.ndarray:
    """Edges by edges: the less similar of the sources (a) and the destinations (b)."""
    a, b, c, d = _unit(one["a"]), _unit(one["b"]), _unit(two["a"]).T, _unit(two["b"]).T
    return by_slices(lambda at: np.minimum(a[at] @ c, b[at] @ d), len(one), len(two))


def soft_edge_match(pred: Graph, true: Graph, embeds: DataFrame, most_cost: float = BOUND) -> DataFrame:
    """One row, precision, recall, f1: best one-to-one matching of edges, a pair scoring its less similar ends. Null beyond the cost bound."""
    p, t = pred.titled_edges().select("src", "dst"), true.titled_edges().select("src", "dst")
    n, m = p.count(), t.count()
    if not n or not m:
        return pred.edges.sparkSession.range(1).select(*[F.lit(0.0).alias(c) for c in ("precision", "recall", "f1")])
    both = p.withColumn("side", F.lit(0)).unionByName(t.withColumn("side", F.lit(1)))
    e = embeds.select("title", "embed")
    both = both.join(e.select(F.col("title").alias("src"), F.col("embed").alias("a")), "src").join(e.select(F.col("title").alias("dst"), F.col("embed").alias("b")), "dst")

    def similarities(frame: pd.DataFrame) -> np.ndarray:
        frame = frame.sort_values(["src", "dst"])
        return edge_similarities(frame[frame.side == 0], frame[frame.side == 1])

    return best_assignment(both, similarities, n, m, _scores, most_cost)
