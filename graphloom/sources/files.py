"""Record files: graphs, JSON lines, tagged text, scored pairs, concept maps, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions import text as T
from graphloom.graph import Graph
from graphloom.operators.tables import shards
from graphloom.operators.traverse import clean_up, depth_cut


def read_graph(spark: SparkSession, path: str, depth: int | None = None) -> Graph:
    """A node-link JSON graph; with a positive ``depth`` only what is so near to the root. The path must end in .json and the root be declared."""
    if not path.endswith(".json"):
        raise ValueError(f"{path}: not a .json file")
    whole = spark.read.schema(schemas.GRAPH).json(path, multiLine=True)
    head = whole.select("graph").first()
    if head is None or head["graph"] is None:
        raise ValueError(f"{path}: no root is declared")
    vertices = whole.select(F.inline("nodes"))
    edges = whole.select(F.inline("links")).select(F.col("source").alias("src"), F.col("target").alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    graph = Graph(vertices, edges, head["graph"]["root"])
    return depth_cut(graph, depth) if depth and depth > 0 else graph


def read_graphs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The pages of all vertices of several graphs, in order: file, node, at, id, title, abstract."""
    out = None
    for number, path in enumerate(paths):
        nodes = spark.read.schema(schemas.GRAPH).json(path, multiLine=True).select(F.posexplode("nodes").alias("node", "n"))
        pages = nodes.select(F.lit(number).alias("file"), "node", F.posexplode("n.pages").alias("at", "p")).select("file", "node", "at", "p.*")
        out = pages if out is None else out.unionByName(pages)
    return out


def write_graph(graph: Graph, path: str, depth: int | None = None, paged: DataFrame | None = None) -> None:
    """``vertices`` and ``edges`` as Parquet under a folder; cut to ``depth`` and then cleaned up by ``paged`` vertices, if given."""
    if depth and depth > 0:
        graph = depth_cut(graph, depth)
    if paged is not None:
        graph = clean_up(graph, paged)
    graph.vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    spark = graph.vertices.sparkSession
    spark.range(1).select(F.lit(graph.root).cast("string").alias("root")).write.mode("overwrite").parquet(f"{path}/root")


def read_tables(spark: SparkSession, path: str) -> Graph:
    """What :func:`write_graph` wrote."""
    return Graph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/root").first()["root"])


def write_depths(graph: Graph, path: str, depths: tuple[int, ...] = (1, 2, 3)) -> None:
    """One edge table for several depths, partitioned by the deepest; distances are found once."""
    from graphloom.operators.traverse import depths as distances

    found = distances(graph, max(depths))
    d = lambda a, b: found.select(F.col("id").alias(a), F.col("depth").alias(b))
    edges = graph.edges.join(d("src", "x"), "src").join(d("dst", "y"), "dst")
    both = edges.select("src", "dst", "weight", F.explode(F.filter(F.array(*[F.lit(k) for k in depths]), lambda k: k >= F.greatest("x", "y"))).alias("max_depth"))
    both.write.mode("overwrite").partitionBy("max_depth").parquet(path)


def graph_json(graph: Graph, most: int = 1_000_000) -> DataFrame:
    """One row, value: the node-link JSON document, for small graphs; the number of vertices and edges is bounded."""
    n = graph.vertices.count() + graph.edges.count()
    if n > most:
        raise ValueError(f"graph_json: more than {most} vertices and edges")
    nodes = graph.vertices.agg(F.array_sort(F.collect_list(F.struct(*[c for c in ("id", "title", "pages") if c in graph.vertices.columns]))).alias("nodes")) if "pages" not in graph.vertices.columns else graph.vertices.agg(F.collect_list(F.struct("id", "title", "pages")).alias("nodes"))
    links = graph.edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "weight"))).alias("links"))
    root = F.struct(F.lit(graph.root).cast("string").alias("root")).alias("graph")
    return nodes.join(links).select(F.to_json(F.struct(F.lit(True).alias("directed"), F.lit(False).alias("multigraph"), root, "nodes", "links")).alias("value"))  # one row each


def read_lines(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """JSON lines of one or several files; the schema is declared."""
    return spark.read.schema(schema).json(list(paths))


def append_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def overwrite_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def read_tagged(spark: SparkSession, folder: str) -> DataFrame:
    """child, parent, rule of the relation lines in a folder's ``*.txt.conll`` files."""
    lines = spark.read.option("pathGlobFilter", "*.txt.conll").text(folder)
    return lines.select(T.tagged_relation(F.col("value")).alias("r")).filter("r is not null").select("r.*")


def read_concepts(spark: SparkSession, path: str) -> DataFrame:
    """concept, n of a JSON object from concept to count."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,bigint>")).alias("concept", "n"))


def concepts_json(counts: DataFrame, most: int = 1_000_000) -> DataFrame:
    """One row, value: the map as JSON, most frequent first; its size is bounded, as a top-k is."""
    pairs = counts.orderBy(F.desc("n"), "concept").limit(most)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "concept", "n")))
    return pairs.agg(F.to_json(F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["concept"], x["n"])))).alias("value"))


def read_scored_pairs(spark: SparkSession, path: str) -> DataFrame:
    """hypo, hyper, sim of a tab-separated file with a header, without pairs that are flagged as out of vocabulary."""
    rows = spark.read.schema(schemas.SCORED_PAIRS).csv(path, sep="\t", header=True)
    return rows.filter(~F.coalesce(F.lower("is_oov").isin("1", "t", "true"), F.lit(False))).select("hypo", "hyper", "sim")


def write_text_shards(rows: DataFrame, text: Column, path: str, size: int = 1000, *order: str) -> None:
    """A text file for each so many documents, in folders by shard."""
    shards(rows, text, size, *order).repartition("shard").write.mode("overwrite").partitionBy("shard").text(path)


def metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))
