"""Structure of graphs: degrees, components, motifs, centrality, spectra and cycles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import centrality
from graphloom.operators.traverse import bfs
from graphloom.runtime import bounded, materialise


def degrees(graph: Graph) -> DataFrame:
    """id, in_degree, out_degree of every vertex."""
    ins = graph.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"))
    outs = graph.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"))
    return graph.vertices.select("id").join(ins, "id", "left").join(outs, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """id, degree: undirected; of a reciprocal pair the larger weight counts, a loop counts twice."""
    pair = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("w"))
    return pair.select(F.explode(F.array("a", "b")).alias("id"), "w").groupBy("id").agg(F.sum("w").alias("degree"))


def summary(graph: Graph) -> DataFrame:
    """One row: num_nodes, num_edges, density."""
    nodes, edges = graph.vertices.agg(F.count("*").alias("num_nodes")), graph.edges.agg(F.count("*").alias("num_edges"))
    n, m = F.col("num_nodes").cast("double"), F.col("num_edges").cast("double")
    return nodes.join(edges).withColumn("density", F.coalesce(F.try_divide(m, n * (n - 1)), F.lit(0.0)))  # one row each


def weak_components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (its smallest id): alternating large-star and small-star rounds, a logarithmic number of them."""
    now = edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now, before = materialise(now, "stars"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return vertices.select("id").distinct().join(now.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("component"))
        before = mark
    raise RuntimeError("components did not settle")


def component_sizes(components: DataFrame) -> DataFrame:
    """size, n: how many components have each size."""
    return components.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def strong_components(vertices: DataFrame, edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """id, component (its smallest id).

    At first the graph is folded, which long paths and rings take a logarithmic number of rounds for: vertices that have no way in or no way
    out are alone, and one with a single way in (from u) and a single way out (to w) becomes an edge from u to w; it is with u where u and w are together. Rounds
    of colouring do the rest: each vertex takes the smallest id that reaches it, and what that id's vertex is reached by within
    its colour is a component.
    """
    pairs, folded = materialise(edges.filter("src <> dst").select("src", "dst").distinct(), "pairs"), []
    size = pairs.count()
    for turn in range(most_rounds):
        if not size:
            break
        ends = pairs.select(F.col("src").alias("id"), F.col("dst").alias("w"), F.lit(None).alias("u")).unionByName(pairs.select(F.col("dst").alias("id"), F.lit(None).alias("w"), F.col("src").alias("u")))
        ends = ends.groupBy("id").agg(F.count("u").alias("ins"), F.count("w").alias("outs"), F.min("u").alias("u"), F.min("w").alias("w"))
        ends = materialise(ends.filter("ins = 0 or outs = 0 or (ins = 1 and outs = 1)").withColumn("rank", F.struct(F.xxhash64("id", F.lit(turn)), "id")), "ends")
        inner = ends.filter("ins = 1 and outs = 1")
        # of neighbours on a path the one of the greatest rank goes
        beside = lambda c: inner.select(F.col("id").alias(c), F.col("rank").alias(f"{c}_rank"))
        gone = inner.join(beside("u"), "u", "left").join(beside("w"), "w", "left").filter("(u_rank is null or rank > u_rank) and (w_rank is null or rank > w_rank)").select("id", "u", "w")
        gone = materialise(gone.unionByName(ends.filter("ins = 0 or outs = 0").select("id", F.lit(None).alias("u"), F.lit(None).alias("w"))), "gone")
        stay = pairs.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")
        single = gone.filter("u <> w").select(F.col("u").alias("src"), F.col("w").alias("dst"))
        for c in ("src", "dst"):  # no edges to what is alone
            single = single.join(gone.filter("u is null").select(F.col("id").alias(c)), c, "left_anti")
        pairs, before = materialise(stay.unionByName(single.select("src", "dst")).distinct(), "pairs"), size
        size = pairs.count()
        folded.append(gone)
        if size > 0.95 * before:
            break
    kernel = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    held = reduce(DataFrame.unionByName, [g.select("id") for g in folded]) if folded else kernel.limit(0)
    rest = vertices.select("id").distinct().join(held, "id", "left_anti")
    done = rest.join(kernel, "id", "left_anti").select("id", F.col("id").alias("component"))
    if size:
        done = done.unionByName(_coloured(kernel, pairs, most_rounds))
    done = materialise(done, "strong")
    for gone in reversed(folded):
        at = lambda c, done=done: done.select(F.col("id").alias(c), F.col("component").alias(f"{c}_in"))
        found = gone.join(at("u"), "u", "left").join(at("w"), "w", "left")
        # what is alone at this turn is not among those done; nothing is with it
        found = found.select("id", F.when(F.col("u_in") == F.col("w_in"), F.col("u_in")).otherwise(F.col("id")).alias("component"))
        done = materialise(done.unionByName(found), "strong")
    least = done.groupBy("component").agg(F.min("id").alias("least"))
    return done.join(least, "component").select("id", F.col("least").alias("component"))


def _coloured(vertices: DataFrame, edges: DataFrame, most_rounds: int) -> DataFrame:
    """id, component by rounds of colouring."""
    left, pairs = vertices.select("id").distinct(), edges.filter("src <> dst").select("src", "dst").distinct()
    done = None
    for _ in range(most_rounds):
        pairs = materialise(pairs, "pairs")
        able = pairs.select(F.col("src").alias("id")).intersect(pairs.select(F.col("dst").alias("id")))
        alone = left.join(able, "id", "left_anti").select("id", F.col("id").alias("component"))
        colours = materialise(able.select("id", F.col("id").alias("c")), "colours")
        while True:
            passed = pairs.join(colours.select(F.col("id").alias("src"), "c"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("c").alias("p"))
            fresh = materialise(colours.join(passed, "id", "left").select("id", F.least("c", F.coalesce("p", "c")).alias("c")), "colours")
            changed = fresh.join(colours.withColumnRenamed("c", "old"), "id").filter("c <> old").isEmpty()
            colours = fresh
            if changed:
                break
        inside = pairs.join(colours.select(F.col("id").alias("src"), "c"), "src").join(colours.select(F.col("id").alias("dst"), F.col("c").alias("d")), "dst").filter("c = d")
        back = bfs(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colours.filter("id = c").select("id"))
        found = back.join(colours, "id").select("id", F.col("c").alias("component")).unionByName(alone)
        done = materialise(found if done is None else done.unionByName(found), "strong")
        left = materialise(left.join(done, "id", "left_anti"), "left")
        if left.isEmpty():
            return done
        pairs = pairs.join(left.select(F.col("id").alias("src")), "src", "left_semi").join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
    raise RuntimeError("strong components did not settle")


def diameter_estimate(graph: Graph) -> int:
    """A lower bound of the diameter of the largest weak component, undirected: two sweeps, each to the farthest vertex."""
    parts = weak_components(graph.vertices, graph.edges)
    largest = parts.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").first()
    if largest is None:
        return 0
    edges, at, far = graph.undirected().edges, largest["component"], 0
    for _ in range(2):
        found = bfs(edges, graph.vertices.sparkSession.range(1).select(F.lit(at).alias("id"))).orderBy(F.desc("depth"), "id").first()
        at, far = found["id"], found["depth"]
    return far


#: Bits of a triad a, b, c: ab, ba, ac, ca, bc, cb.
_PAIRS = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))


def triad_class(bits: int) -> int:
    """The smallest number that any order of the three vertices gives the same adjacency."""
    held = {p for i, p in enumerate(_PAIRS) if bits >> i & 1}
    return min(sum(1 << i for i, (x, y) in enumerate(_PAIRS) if (order[x], order[y]) in held) for order in permutations(range(3)))


def motif_triples(edges: DataFrame) -> DataFrame:
    """a < b < c and their motif: every connected triple, found from pairs of edges that share a vertex.

    A triple comes once for each of its shared vertices, so up to three times, and is made
    distinct; its six possible edges are then read off pair by pair.
    """
    loops = edges.filter("src <> dst").select("src", "dst").distinct()
    side = loops.select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"), (F.when(F.col("src") < F.col("dst"), 1).otherwise(2)).alias("bit"))
    pairs = materialise(side.groupBy("p", "q").agg(F.sum("bit").alias("bits")), "pairs")  # 1: up, 2: down, 3: both
    around = pairs.select(F.col("p").alias("m"), F.col("q").alias("n")).unionByName(pairs.select(F.col("q").alias("m"), F.col("p").alias("n")))
    wedges = around.join(around.select("m", F.col("n").alias("o")), "m").filter("n < o").select(F.array_sort(F.array("m", "n", "o")).alias("t")).distinct()
    triples = wedges.select(F.col("t")[0].alias("a"), F.col("t")[1].alias("b"), F.col("t")[2].alias("c"))
    for x, y, name in (("a", "b", "ab"), ("a", "c", "ac"), ("b", "c", "bc")):
        triples = triples.join(pairs.select(F.col("p").alias(x), F.col("q").alias(y), F.col("bits").alias(name)), [x, y], "left")
    number = F.coalesce("ab", F.lit(0)) + F.coalesce("ac", F.lit(0)) * 4 + F.coalesce("bc", F.lit(0)) * 16
    classes = F.array(*[F.lit(triad_class(i)) for i in range(64)])
    return triples.select("a", "b", "c", F.get(classes, number.cast("int")).alias("motif"))


def triangles(edges: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """u, v, w, uv, uw, vw: every three vertices that are linked pair by pair; bits are 1 for an edge from the first, 2 for one to it.

    Links go from the vertex with fewer of them to the one with more (by name if equal), so no vertex has more than
    the root of twice their number, hubs included; triangles are the pairs of a vertex's links that are linked themselves.
    """
    linked = _linked(edges) if linked is None else linked
    degree = linked.select(F.explode(F.array("p", "q")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    ranked = linked.join(degree.select(F.col("id").alias("p"), F.col("d").alias("dp")), "p").join(degree.select(F.col("id").alias("q"), F.col("d").alias("dq")), "q")
    up = (F.col("dp") < F.col("dq")) | ((F.col("dp") == F.col("dq")) & (F.col("p") < F.col("q")))
    high = F.struct(F.greatest("dp", "dq").alias("d"), F.when(up, F.col("q")).otherwise(F.col("p")).alias("id"))
    out = ranked.select(F.when(up, F.col("p")).otherwise(F.col("q")).alias("low"), high.alias("high"), F.when(up, F.col("bits")).otherwise(_turned(F.col("bits"))).alias("bits"))
    out = materialise(out, "upward")
    closing = out.select(F.col("low").alias("v"), F.col("high.id").alias("w"), F.col("bits").alias("vw"))
    return _wedges(out).join(closing, ["v", "w"]).select("u", "v", "w", "uv", "uw", "vw")


def _wedges(out: DataFrame) -> DataFrame:
    """u, v, w, uv, uw: pairs of links up from a vertex (low, high, bits) that a link from v to w may close.

    Where no link goes up from v, as from the hubs of a two-sided graph, nothing is paired.
    """
    begun = out.select(F.col("low").alias("_id")).distinct()
    first = out.join(begun, F.col("high.id") == F.col("_id"), "left_semi").select(F.col("low").alias("u"), F.col("high").alias("_v"), F.col("bits").alias("uv"))
    second = out.select(F.col("low").alias("u"), F.col("high").alias("_w"), F.col("bits").alias("uw"))
    return first.join(second, "u").filter("_v < _w").select("u", F.col("_v.id").alias("v"), F.col("_w.id").alias("w"), "uv", "uw")


def _linked(edges: DataFrame) -> DataFrame:
    """p < q, bits (1: up, 2: down, 3: both): the pairs of distinct vertices with an edge between them."""
    plain = edges.filter("src <> dst").select("src", "dst").distinct()
    side = plain.select(F.least("src", "dst").alias("p"), F.greatest("src", "dst").alias("q"), F.when(F.col("src") < F.col("dst"), 1).otherwise(2).alias("bit"))
    return materialise(side.groupBy("p", "q").agg(F.sum("bit").cast("int").alias("bits")), "pairs")


def _turned(bits: Column) -> Column:
    """The bits of a pair as its other end sees them."""
    return F.when(bits == 3, bits).otherwise(3 - bits)


def motif_census(edges: DataFrame) -> DataFrame:
    """motif, n, share: connected triples by isomorphism class.

    Triangles are listed (:func:`triangles`). Triples with two links are not: how many a vertex is the middle of
    follows from how many links of each kind it has, less those that a triangle closes.
    """
    wide = "decimal(38,0)"
    linked = _linked(edges)
    ends = linked.select(F.col("p").alias("id"), "bits").unionByName(linked.select(F.col("q").alias("id"), _turned(F.col("bits")).alias("bits")))
    kinds = ends.groupBy("id").agg(*[F.count_if(F.col("bits") == k).cast(wide).alias(f"k{k}") for k in (1, 2, 3)])
    n = {k: F.col(f"k{k}") for k in (1, 2, 3)}
    middles = [(F.lit(triad_class(x + 4 * y)), n[x] * n[y] if x < y else F.call_function("div", n[x] * (n[x] - 1), F.lit(2).cast(wide)).cast(wide)) for x in n for y in n if x <= y]
    open_ = kinds.select(F.inline(F.array(*[F.struct(m.alias("motif"), F.coalesce(c, F.lit(0)).cast(wide).alias("n")) for m, c in middles])))
    shapes = triangles(edges, linked).groupBy("uv", "uw", "vw").agg(F.count("*").cast(wide).alias("n"))  # 27 rows at most
    classes = F.array(*[F.lit(triad_class(i)) for i in range(64)])
    seen = lambda x, y: F.get(classes, x + 4 * y)
    uv, uw, vw = F.col("uv"), F.col("uw"), F.col("vw")
    parts = [(F.get(classes, uv + 4 * uw + 16 * vw), F.col("n"))] + [(seen(x, y), -F.col("n")) for x, y in ((uv, uw), (_turned(uv), vw), (_turned(uw), _turned(vw)))]
    closed = shapes.select(F.inline(F.array(*[F.struct(m.alias("motif"), c.cast(wide).alias("n")) for m, c in parts])))
    counted = open_.unionByName(closed).groupBy("motif").agg(F.sum("n").cast("long").alias("n")).filter("n > 0")
    total = counted.agg(F.sum("n").alias("total"))
    return counted.join(F.broadcast(total)).select("motif", "n", (F.col("n") / F.col("total")).alias("share"))  # at most 13 rows


def motif_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, distance: half the summed difference of two censuses' shares."""
    both = a.select("motif", F.col("share").alias("x")).join(b.select("motif", F.col("share").alias("y")), "motif", "full")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))) / 2, F.lit(0.0)).alias("distance"))


def motif_divergence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, divergence: Kullback-Leibler of two censuses' counts, each raised by one."""
    both = a.select("motif", F.col("n").alias("x")).join(b.select("motif", F.col("n").alias("y")), "motif", "full")
    both = both.select((F.coalesce("x", F.lit(0)) + 1).cast("double").alias("x"), (F.coalesce("y", F.lit(0)) + 1).cast("double").alias("y"))
    totals = both.agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    p, q = F.col("x") / F.col("sx"), F.col("y") / F.col("sy")
    return both.join(F.broadcast(totals)).agg(F.coalesce(F.sum(p * F.log(p / q)), F.lit(0.0)).alias("divergence"))


def motif_depths(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """motif, mean_depth of the triples that are a fork (one vertex to two) or a chain."""
    fork, chain = triad_class(0b000101), triad_class(0b010001)
    triples = motif_triples(edges).filter(F.col("motif").isin(fork, chain))
    for x in "abc":
        triples = triples.join(distances.select(F.col("id").alias(x), F.col("depth").alias(f"d{x}")), x)
    return triples.select(F.when(F.col("motif") == fork, "fork").otherwise("chain").alias("motif"), ((F.col("da") + F.col("db") + F.col("dc")) / 3).alias("mean_depth"))


def betweenness(graph: Graph, most_edges: int = 2_000_000) -> DataFrame:
    """id, score, undirected and normalised: Brandes' sums, sources in parallel.

    The adjacency goes to every task up to ``most_edges`` links; beyond, counts and sums stay tables.
    """
    links = graph.undirected().edges.select("src", "dst").filter("src <> dst")
    rows = links.limit(most_edges + 1).collect()
    if len(rows) > most_edges:
        return centrality.betweenness(graph).select("id", "title", "score").orderBy(F.desc("score"), "id")
    around: dict[str, list[str]] = {}
    for r in rows:
        around.setdefault(r["src"], []).append(r["dst"])
    spark = graph.vertices.sparkSession
    shared, n = spark.sparkContext.broadcast(around), graph.vertices.count()

    def sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links, total = shared.value, {}
        for batch in batches:
            for s in batch["id"]:
                depth, ways, order = {s: 0}, {s: 1.0}, [s]
                for v in order:
                    for w in links.get(v, ()):
                        if w not in depth:
                            depth[w], ways[w] = depth[v] + 1, 0.0
                            order.append(w)
                        if depth[w] == depth[v] + 1:
                            ways[w] += ways[v]
                owed = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in links.get(w, ()):
                        if depth[v] == depth[w] - 1:
                            owed[v] += ways[v] / ways[w] * (1 + owed[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + owed[w]
        yield pd.DataFrame({"id": list(total), "score": list(total.values())})

    summed = graph.vertices.select("id").mapInPandas(sources, "id string, score double").groupBy("id").agg(F.sum("score").alias("score"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return graph.vertices.select("id", "title").join(summed, "id", "left").select("id", "title", (F.coalesce("score", F.lit(0.0)) * scale).alias("score")).orderBy(F.desc("score"), "id")


def laplacian_spectrum(graph: Graph, most_nodes: int = 4000) -> DataFrame:
    """at, value: eigenvalues of the normalised Laplacian, undirected, rising. The matrix is dense, so its size is bounded."""
    ids = [r["id"] for r in bounded(graph.vertices.select("id").distinct(), most_nodes, "laplacian_spectrum")]
    place = {v: i for i, v in enumerate(sorted(ids))}

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((len(place), len(place)))
        for x, y in zip(frame["src"], frame["dst"], strict=True):
            if x in place and y in place:
                a[place[x], place[y]] = 1.0
        d = a.sum(axis=1)
        scale = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1e-300)), 0.0)
        values = np.linalg.eigvalsh(np.diag((d > 0).astype(float)) - scale[:, None] * a * scale[None, :])
        return pd.DataFrame({"at": np.arange(len(values)), "value": values})

    return graph.undirected().edges.select("src", "dst", F.lit(0).alias("_all")).groupBy("_all").applyInPandas(solve, "at long, value double")


def short_cycles(edges: DataFrame, most_edges: int) -> DataFrame:
    """path: the simple cycles of at most so many edges, each once, from its smallest vertex; loops are none."""
    pairs = edges.filter("src <> dst").select("src", "dst").distinct()
    level = pairs.filter("src < dst").select(F.array("src", "dst").alias("path"))
    out = None
    for _ in range(most_edges - 1):
        level = materialise(level, "walks")
        if level.isEmpty():
            break
        ahead = level.join(pairs, F.element_at("path", -1) == F.col("src"))
        closed = ahead.filter(F.col("dst") == F.col("path")[0]).select("path")
        out = closed if out is None else out.unionByName(closed)
        level = ahead.filter((F.col("dst") > F.col("path")[0]) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"))
    return out if out is not None else edges.sparkSession.range(0).select(F.array().cast("array<string>").alias("path"))


def feedback_edges(edges: DataFrame, most_edges: int, most_rounds: int = 1000) -> DataFrame:
    """src, dst: edges that break all short cycles, each time the one on most of those left (ties in order)."""
    ring = F.concat("path", F.array(F.col("path")[0]))
    steps = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.element_at(ring, i).alias("src"), F.element_at(ring, i + 1).alias("dst")))
    left = materialise(short_cycles(edges, most_edges).select(F.col("path").alias("cycle"), F.explode(steps).alias("e")).select("cycle", "e.src", "e.dst"), "cycles")
    taken: list[tuple[str, str]] = []
    while (top := left.groupBy("src", "dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src", "dst").first()) is not None:
        taken.append((top["src"], top["dst"]))
        if len(taken) > most_rounds:
            raise RuntimeError("too many feedback edges")
        broken = left.filter((F.col("src") == top["src"]) & (F.col("dst") == top["dst"])).select("cycle")
        left = materialise(left.join(broken, "cycle", "left_anti"), "cycles")
    return edges.sparkSession.createDataFrame(taken, "src string, dst string")


def coverage(part: Graph, whole: Graph) -> DataFrame:
    """One row: the shares of the whole's vertices and edges that lie in the part."""
    ids = whole.vertices.select("id").distinct().join(part.vertices.select("id").distinct().withColumn("in", F.lit(1)), "id", "left").agg(F.avg(F.coalesce("in", F.lit(0))).alias("node_coverage"))
    pairs = whole.edges.select("src", "dst").distinct().join(part.edges.select("src", "dst").distinct().withColumn("in", F.lit(1)), ["src", "dst"], "left").agg(F.avg(F.coalesce("in", F.lit(0))).alias("edge_coverage"))
    return ids.join(pairs)  # one row each


