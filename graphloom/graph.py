"""A rooted, labelled, weighted, directed graph as two DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """``vertices``: id, title and more; ``edges``: src, dst, weight (one row a pair). Ids are text; ``root`` may be None."""

    vertices: DataFrame
    edges: DataFrame
    root: str | None = None

    @staticmethod
    def of(edges: DataFrame, root: str | None = None, vertices: DataFrame | None = None) -> Graph:
        """A graph from edges; vertices are the endpoints, titled by their id, unless given. A missing weight is 1."""
        weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in edges.columns else F.lit(1.0)
        pairs = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), weight.alias("weight"))
        if vertices is None:
            vertices = endpoints(pairs).select("id", F.col("id").alias("title"))
        return Graph(vertices, pairs, root)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def induced(self, keep: DataFrame) -> Graph:
        """The subgraph on the vertices in ``keep`` (id)."""
        ids = keep.select("id").distinct()
        edges = self.edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(self.vertices.join(ids, "id", "left_semi"), edges.select(*self.edges.columns), self.root)

    def reverse(self) -> Graph:
        return self.with_edges(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in self.edges.columns if c not in ("src", "dst")]))

    def undirected(self) -> Graph:
        """Both directions of every edge, once."""
        both = self.edges.select("src", "dst").unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
        return self.with_edges(both.withColumn("weight", F.lit(1.0)))

    def titled_edges(self) -> DataFrame:
        """src, dst, weight by title in place of id; distinct pairs keep their largest weight."""
        names = self.vertices.select("id", "title")
        out = self.edges.join(names.select(F.col("id").alias("src"), F.col("title").alias("_a")), "src").join(names.select(F.col("id").alias("dst"), F.col("title").alias("_b")), "dst")
        return out.groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.max("weight").alias("weight"))


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct endpoints of edges, as id."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
