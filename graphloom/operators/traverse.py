"""Traversals: breadth-first distances, reachability, paths and splits.

Each hop is one join of the frontier with the edges; what was reached is written
out after each, so plans stay short and a lost executor costs one hop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.runtime import materialise, table_path


def hash_order(*columns: str | Column, seed: int = 0) -> Column:
    """A seeded order in place of a random one: the same in any engine that has md5."""
    return F.md5(F.concat_ws(":", *columns, F.lit(str(seed))))


def bfs(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None, parents: bool = False) -> DataFrame:
    """id, depth (hops from the nearest seed); with ``parents`` also ``parent``, the smallest of the nearer neighbours."""
    pairs = edges.select("src", "dst").filter("src <> dst").distinct()
    columns = ["id", "depth", "parent"] if parents else ["id", "depth"]
    none = F.lit(None).cast("string").alias("parent")
    spark, path = edges.sparkSession, table_path(edges.sparkSession, "bfs")
    start = seeds.select(F.col("id").cast("string").alias("id"), F.lit(0).alias("depth"), none).distinct().select(*columns)
    start.write.parquet(path)
    reached = lambda: spark.read.schema(start.schema).parquet(path)  # noqa: E731  what is there by now
    pairs = materialise(pairs, "ways")
    hop = 0
    while max_hops is None or hop < max_hops:
        # each hop is added to those before it, which are not written again
        seen = reached()
        front = seen.filter(F.col("depth") == hop).select(F.col("id").alias("src"))
        fresh = front.join(pairs, "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh.withColumn("depth", F.lit(hop + 1)).select(*columns).write.mode("append").parquet(path)
        hop += 1
        if reached().filter(F.col("depth") == hop).isEmpty():
            break
    return reached()


def root_of(graph: Graph) -> DataFrame:
    return graph.vertices.sparkSession.range(1).select(F.lit(graph.root).alias("id")).filter("id is not null")


def depths(graph: Graph, max_hops: int | None = None) -> DataFrame:
    """Distances from the root along edges."""
    return bfs(graph.edges, root_of(graph), max_hops)


def reachable(edges: DataFrame, seeds: DataFrame, max_hops: int | None = None) -> DataFrame:
    return bfs(edges, seeds, max_hops).select("id")


def depth_cut(graph: Graph, depth: int) -> Graph:
    """What is at most ``depth`` hops from the root."""
    return graph.induced(depths(graph, depth))


def clean_up(graph: Graph, paged: DataFrame) -> Graph:
    """Keeps what the root reaches, and of that what has pages or reaches something that has. ``paged``: id."""
    inner = graph.induced(depths(graph))
    seeds = paged.select(F.col("id").cast("string").alias("id")).distinct().join(inner.vertices.select("id"), "id", "left_semi")
    return inner.induced(reachable(inner.reverse().edges, seeds))


def nodes_at(distances: DataFrame, depth: int) -> DataFrame:
    return distances.filter(F.col("depth") == depth).select("id")


def edges_at(graph: Graph, distances: DataFrame, depth: int) -> DataFrame:
    """Edges whose source is at a depth."""
    return graph.edges.join(distances.select(F.col("id").alias("src"), "depth"), "src").filter(F.col("depth") == depth).select("src", "dst")


def _reversed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def simple_paths(edges: DataFrame, root: str, most_edges: int, targets: DataFrame | None = None) -> DataFrame:
    """path (array of ids from the root), end: every path without repeated vertices of at most so many edges.

    Paths are found once for all vertices. The length bound is needed: their number
    grows exponentially with it on graphs with many crossings. With ``targets`` (id), only paths that end
    there come out, and a path goes on only as long as its end is near enough to one of them.
    """
    pairs = edges.select("src", "dst").distinct()
    level = pairs.sparkSession.range(1).select(F.array(F.lit(root)).alias("path"), F.lit(root).alias("end"))
    if targets is not None:
        left = bfs(_reversed(pairs), targets, most_edges).select(F.col("id").alias("dst"), F.col("depth").alias("left"))
        pairs = pairs.join(left, "dst")
        ends = targets.select(F.col("id").cast("string").alias("end")).distinct()
    out = level
    for n in range(1, most_edges + 1):
        step = level.join(pairs, F.col("end") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
        if targets is not None:
            step = step.filter(F.col("left") <= most_edges - n)
        level = materialise(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end")), "paths")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out if targets is None else out.join(ends, "end", "left_semi").select("path", "end")


def page_paths(edges: DataFrame, root: str, page_category: DataFrame, cutoff: int) -> DataFrame:
    """page_id, paths (sorted, distinct): the simple paths from the root to the page's vertices; the hop to the page counts as one edge."""
    ends = page_category.select("page_id", F.col("node_id").alias("end")).distinct()
    paths = simple_paths(edges, root, cutoff - 1, ends.select(F.col("end").alias("id")).distinct())
    found = ends.join(paths, "end")
    return found.groupBy("page_id").agg(F.array_sort(F.collect_set("path")).alias("paths"))


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """at, id along one shortest path (smallest predecessors); empty if there is none."""
    spark = edges.sparkSession
    found = bfs(edges, spark.range(1).select(F.lit(source).alias("id")), parents=True)
    goal = found.filter(F.col("id") == target).first()
    if goal is None:
        return spark.range(0).select(F.col("id").cast("int").alias("at"), F.lit("").alias("id"))
    path, node = [target], goal
    while node["parent"] is not None:
        node = found.filter(F.col("id") == node["parent"]).first()
        path.append(node["id"])
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(p) for p in reversed(path)])).alias("at", "id"))


def k_shortest_paths(edges: DataFrame, source: str, target: str, k: int, most_edges: int, ties: str | Column = "path") -> DataFrame:
    """path: the ``k`` shortest simple paths of at most so many edges, those of equal length by ``ties``, which must tell all paths apart.

    Lengths come in turn, beginning with the distance. For each, a path goes on only where the target is near enough
    to be reached in what is left of it, so on the way to the shortest paths nothing else is
    looked at; it ends with the length at which there are ``k``.
    """
    spark = edges.sparkSession
    none = spark.range(0).select(F.array(F.lit(source)).alias("path"))
    if source == target:
        return spark.range(1).select(F.array(F.lit(source)).alias("path")).limit(k)
    pairs = edges.select("src", "dst").filter("src <> dst").distinct()
    left = bfs(_reversed(pairs), spark.range(1).select(F.lit(target).alias("id")), most_edges)
    first = left.filter(F.col("id") == source).first()
    if first is None or k <= 0:
        return none
    pairs = materialise(pairs.join(left.select(F.col("id").alias("dst"), F.col("depth").alias("left")), "dst").filter(F.col("src") != target), "ways")
    out, have = none, 0
    for length in range(first["depth"], most_edges + 1):
        level = spark.range(1).select(F.array(F.lit(source)).alias("path"), F.lit(source).alias("end"))
        for n in range(1, length + 1):
            near = F.col("left") <= length - n if n < length else F.col("dst") == target
            # an end before the last step must be another vertex, and the last one the target
            step = level.join(pairs.filter(near), F.col("end") == F.col("src")).filter(~F.array_contains("path", F.col("dst")))
            if n < length:
                step = step.filter(F.col("dst") != target)
            level = materialise(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end")), "paths")
        out, have = out.unionByName(level.select("path")), have + level.count()
        if have >= k:
            break
    return out.orderBy(F.size("path"), ties).limit(k)


def split(graph: Graph, split_depth: int, share: float, seed: int = 0) -> tuple[Graph, Graph]:
    """Two graphs that share what is above ``split_depth``; the vertices at it are dealt out, ``int(share * n)`` to the first.

    Each has what its own reach within the remaining depth. Dealing follows a seeded
    hash order. The rank is exact: it is counted over the vertices of one depth only.
    """
    distances = materialise(depths(graph), "depths")
    deepest = distances.agg(F.max("depth")).first()[0]
    level = distances.filter(F.col("depth") == split_depth).select("id", hash_order("id", seed=seed).alias("h"))
    n = int(share * level.count())
    first = materialise(level.orderBy("h", "id").limit(n).select("id"), "first")
    second = level.select("id").join(first, "id", "left_anti")
    shared = distances.filter(F.col("depth") < split_depth).select("id")
    return tuple(graph.induced(reachable(graph.edges, s, deepest - split_depth).unionByName(shared)) for s in (first, second))


def split_report(graph: Graph, train: Graph, test: Graph) -> DataFrame:
    """depth (null: all together), kind (node, edge), total, train, test, shared, covered. An edge's depth is its ends' smaller one."""
    distances = materialise(depths(graph), "depths")
    marks = lambda g, on: g.select(*on).distinct().withColumn("in", F.lit(True))
    a = distances.select("id", "depth").join(marks(train.vertices, ["id"]).withColumnRenamed("in", "a"), "id", "left").join(marks(test.vertices, ["id"]).withColumnRenamed("in", "b"), "id", "left")
    nodes = a.select(F.lit("node").alias("kind"), "depth", "a", "b")
    d = distances.select("id", "depth")
    edges = graph.edges.select("src", "dst").join(d.select(F.col("id").alias("src"), F.col("depth").alias("x")), "src").join(d.select(F.col("id").alias("dst"), F.col("depth").alias("y")), "dst")
    edges = edges.join(marks(train.edges, ["src", "dst"]).withColumnRenamed("in", "a"), ["src", "dst"], "left").join(marks(test.edges, ["src", "dst"]).withColumnRenamed("in", "b"), ["src", "dst"], "left")
    both = nodes.unionByName(edges.select(F.lit("edge").alias("kind"), F.least("x", "y").alias("depth"), "a", "b"))
    x, y = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    counts = [F.count("*").alias("total"), F.count_if(x).alias("train"), F.count_if(y).alias("test"), F.count_if(x & y).alias("shared"), F.count_if(x | y).alias("covered")]
    return both.groupingSets([["kind", "depth"], ["kind"]], "kind", "depth").agg(*counts)


def topic_subgraph(graph: Graph, topic: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """src, dst, where (train, test, neither): the topic's children and the shortest path to it from the root."""
    path = shortest_path(graph.edges, graph.root, topic).select("id")
    around = path.unionByName(graph.edges.filter(F.col("src") == topic).select(F.col("dst").alias("id"))).distinct()
    inside = graph.induced(around).edges.select("src", "dst")
    a = train.select("src", "dst").distinct().withColumn("_a", F.lit(True))
    b = test.select("src", "dst").distinct().withColumn("_b", F.lit(True))
    where = F.when(F.col("_a"), "train").when(F.col("_b"), "test").otherwise("neither")
    return inside.join(a, ["src", "dst"], "left").join(b, ["src", "dst"], "left").select("src", "dst", where.alias("where"))


def random_neighbourhood(graph: Graph, radius: int, least: int, most: int, seed: int = 0) -> Graph:
    """The subgraph around a vertex, by hash order the first whose neighbourhood has a size within bounds; an error if none has.

    Neighbourhood sizes are found for all vertices at once, hop by hop.
    """
    near = graph.vertices.select("id", F.col("id").alias("reached"))
    pairs = graph.edges.select(F.col("src").alias("reached"), F.col("dst").alias("next")).distinct()
    for _ in range(radius):
        near = materialise(near.unionByName(near.join(pairs, "reached").select("id", F.col("next").alias("reached"))).distinct(), "near")
    sizes = near.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n").between(least, most))
    pick = sizes.orderBy(hash_order("id", seed=seed), "id").first()
    if pick is None:
        raise ValueError(f"no neighbourhood of {least} to {most} vertices")
    return graph.induced(near.filter(F.col("id") == pick["id"]).select(F.col("reached").alias("id")))
