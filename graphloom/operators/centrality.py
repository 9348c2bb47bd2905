"""Betweenness as tables: breadth-first counts from many sources at once, then sums back from the last level.

State is one row for each vertex and each turn of ``WIDTH`` sources at the present depth, with a number for each
source. Sources are taken in batches of turns, so what is written at a time is bounded by batch x vertices, whatever the
number of sources. Links are dealt into parts by the end that has fewer of them, so no task holds all links of a hub:
only vertices go to the parts in which they have links, and only sums by vertex and part come back, never a row for each link.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators.tables import numbered
from graphloom.runtime import materialise

#: Links of a part, about; an end that has fewer links than the other has at most the root of twice all links.
HUB = 2_000_000
#: Sources of a turn, and links from which on a part of its own is worth a task.
WIDTH, WORTH = 32, 100_000


class Links:
    """Undirected links in parts. ``parts``: part, ids, a, b (places in ids, packed); ``places``: in which parts a vertex is, and at which place."""

    def __init__(self, edges: DataFrame, hub: int = HUB):
        pairs = edges.filter("src <> dst").select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q")).distinct()
        pairs = materialise(pairs, "links")
        n, cores = pairs.count(), edges.sparkSession.sparkContext.defaultParallelism
        self.n = max(1, math.ceil(n / hub), min(2 * cores, math.ceil(n / WORTH)))
        degree = materialise(pairs.select(F.explode(F.array("p", "q")).alias("id")).groupBy("id").agg(F.count("*").alias("d")), "degrees")
        of = lambda c: degree.select(F.col("id").alias(c), F.col("d").alias(f"d{c}"))
        low = F.when(F.col("dp") <= F.col("dq"), F.col("p")).otherwise(F.col("q"))
        dealt = pairs.join(of("p"), "p").join(of("q"), "q").select("p", "q", F.pmod(F.xxhash64(low), F.lit(self.n)).cast("int").alias("part"))
        kind = edges.schema["src"].dataType.simpleString()

        def packed(key: tuple, rows: pa.Table) -> pa.Table:
            ends = pa.chunked_array(rows.column("p").chunks + rows.column("q").chunks).combine_chunks().dictionary_encode()
            places = ends.indices.to_numpy().astype(np.int32)
            cells = [pa.array([key[0].as_py()], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ends.dictionary)], pa.int32()), ends.dictionary)]
            cells += [pa.array([half.tobytes()], pa.binary()) for half in np.split(places, 2)]
            return pa.Table.from_arrays(cells, names=["part", "ids", "a", "b"])

        self.parts = materialise(dealt.repartition(2 * self.n, "part").groupBy("part").applyInArrow(packed, f"part int, ids array<{kind}>, a binary, b binary"), "parts")
        self.places = materialise(self.parts.select("part", F.posexplode("ids").alias("place", "id")), "places")

    def neighbours(self, level: DataFrame, values, turns: list[int], width: int) -> DataFrame:
        """turn, id, x: ``values`` of all rows of the level that are linked with id, summed source by source."""
        tasks = 2 * self.n * len(turns)
        rows = level.select("turn", "id", values.alias("x")).join(self.places, "id").select("turn", "part", "place", "x").repartition(tasks, "part", "turn")
        parts = self.parts.withColumn("turn", F.explode(F.array(*map(F.lit, turns)))).repartition(tasks, "part", "turn")
        kind = self.places.schema["id"].dataType.simpleString()

        def summed(key: tuple, at: pa.Table, links: pa.Table) -> pa.Table:
            found, x = pa.array([], at_kind), np.zeros(0)
            if at.num_rows and links.num_rows:
                ids = links.column("ids").combine_chunks().flatten()
                a, b = (np.frombuffer(links.column(c)[0].as_py(), np.int32) for c in ("a", "b"))
                ahead, sums = np.zeros((width, len(ids))), np.zeros((width, len(ids)))
                ahead[:, at.column("place").to_numpy()] = at.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width).T
                for value, total in zip(ahead, sums, strict=True):  # source by source
                    if value.any():
                        for start, end in ((a, b), (b, a)):
                            sent = value[start]
                            if sent.any():
                                total += np.bincount(end, sent, len(ids))
                reached = np.flatnonzero(sums.any(axis=0))
                found, x = ids.take(pa.array(reached)), np.ascontiguousarray(sums[:, reached].T).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * width, pa.int32()), pa.array(x, pa.float64()))
            return pa.Table.from_arrays([pa.array([key[1].as_py()] * len(found), pa.int32()), found, lists], names=["turn", "id", "x"])

        at_kind = pa.string() if kind == "string" else {"bigint": pa.int64(), "int": pa.int32()}[kind]
        sums = rows.groupBy("part", "turn").cogroup(parts.groupBy("part", "turn")).applyInArrow(summed, f"turn int, id {kind}, x array<double>")
        return sums.groupBy("turn", "id").agg(F.array(*[F.sum(F.get("x", F.lit(i))) for i in range(width)]).alias("x"))


def _batch(links: Links, sources: DataFrame, turns: list[int], width: int, most_depth: int) -> DataFrame:
    """id, owed of the batch's sources (id, turn, lane): the shares of shortest paths from them that lead through a vertex."""
    own = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == F.col("lane"), 1.0).otherwise(0.0))
    levels = [materialise(sources.select("turn", "id", own.alias("ways")), "level")]
    while True:
        ahead = links.neighbours(levels[-1], F.col("ways"), turns, width)
        for seen in levels[-2:]:  # links are undirected, so a neighbour is at most one level back
            ahead = ahead.join(seen, ["turn", "id"], "left")
            ahead = ahead.select("turn", "id", F.coalesce(F.zip_with("x", "ways", lambda x, w: F.when(w > 0, 0.0).otherwise(x)), "x").alias("x"))
        ahead = materialise(ahead.filter(F.exists("x", lambda x: x > 0)).withColumnRenamed("x", "ways"), "level")
        if ahead.isEmpty():
            break
        if len(levels) > most_depth:
            raise RuntimeError(f"paths of more than {most_depth} links")
        levels.append(ahead)
    owed, sums = None, []
    for level in reversed(levels[1:]):
        if owed is None:
            owed = level.withColumn("owed", F.array_repeat(F.lit(0.0), width))
        else:
            back = links.neighbours(owed, F.zip_with("owed", "ways", lambda o, w: F.when(w > 0, (1 + o) / w).otherwise(0.0)), turns, width)
            owed = level.join(back, ["turn", "id"], "left").select("turn", "id", "ways", F.coalesce(F.zip_with("x", "ways", lambda x, w: x * w), F.array_repeat(F.lit(0.0), width)).alias("owed"))
        owed = materialise(owed, "owed")
        sums.append(owed.select("id", F.aggregate("owed", F.lit(0.0), lambda s, x: s + x).alias("owed")))
    if not sums:
        return sources.select("id", F.lit(0.0).alias("owed")).limit(0)
    return reduce(DataFrame.unionByName, sums).groupBy("id").agg(F.sum("owed").alias("owed"))


def path_shares(edges: DataFrame, sources: DataFrame, batch: int = 4096, most_depth: int = 10_000, hub: int = HUB) -> DataFrame:
    """id, owed: the summed shares of shortest undirected paths from ``sources`` (id) that lead through a vertex, ends not counted.

    Loops, repeated edges and directions play no part; sources without a link give nothing;
    a vertex that no path leads through has 0, one that no source reaches has no row.
    """
    links = Links(edges, hub)
    wanted = materialise(numbered(sources.filter("id is not null").select("id").distinct(), "id"), "sources")
    n = wanted.count()
    width = max(1, min(WIDTH, batch, n))
    turns = math.ceil(n / width)
    wanted = wanted.select("id", F.floor(F.col("at") / width).cast("int").alias("turn"), (F.col("at") % width).cast("int").alias("lane"))
    step = max(1, batch // width)
    parts = []
    for i in range(0, turns, step):
        here = list(range(i, min(i + step, turns)))
        parts.append(materialise(_batch(links, wanted.filter(F.col("turn").between(here[0], here[-1])), here, width, most_depth), "shares"))
    if not parts:
        return wanted.select("id", F.lit(0.0).alias("owed"))
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("owed").alias("owed"))


def betweenness(graph: Graph, pivots: int | None = None, batch: int = 4096, sure: float = 0.99, hub: int = HUB) -> DataFrame:
    """id, title, score, error: undirected and normalised, from all vertices or from so many that a hash order chooses.

    With pivots, scores are estimates: with probability ``sure`` none is off by more than ``error``
    (Hoeffding's bound over all vertices); with all vertices they are exact and ``error`` is 0.
    """
    known = graph.vertices.select("id").distinct()
    n = known.count()
    chosen, k = known, n
    if pivots is not None and pivots < n:
        chosen, k = known.orderBy(F.md5("id"), "id").limit(pivots), pivots
    shares = path_shares(graph.edges, chosen, batch, hub=hub)
    scale = n / k / ((n - 1) * (n - 2)) if n > 2 else 1.0
    error = n / (n - 1) * math.sqrt(math.log(2 * n / (1 - sure)) / (2 * k)) if k < n and n > 2 else 0.0
    return graph.vertices.select("id", "title").join(shares, "id", "left").select("id", "title", (F.coalesce("owed", F.lit(0.0)) * scale).alias("score"), F.lit(error).alias("error"))
