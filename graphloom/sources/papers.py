"""Paper snapshots, citations, and taxonomies of categories."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions import text as T
from graphloom.graph import Graph

# Categories with more than one id; the first of each is the one used.
ALIASES = [
    ["math.MP", "math-ph"],
    ["stat.TH", "math.ST"],
    ["math.IT", "cs.IT"],
    ["econ.GN", "q-fin.EC"],
    ["cs.SY", "eess.SY"],
    ["cs.NA", "math.NA"],
    ["physics", "grp_physics"],
    ["econ", "grp_econ"],
    ["math", "grp_math"],
    ["q-bio", "grp_q-bio"],
    ["q-fin", "grp_q-fin"],
    ["cs", "grp_cs"],
    ["stat", "grp_stat"],
    ["eess", "grp_eess"],
]


def category_of(x: Column) -> Column:
    """The id in use for a category."""
    known = F.create_map(*[F.lit(v) for v in chain.from_iterable((other, names[0]) for names in ALIASES for other in names)])
    return F.coalesce(F.element_at(known, x), x)


def papers_of(snapshot: DataFrame) -> DataFrame:
    """id, title, categories, abstract, date from snapshot rows."""
    return snapshot.select("id", T.one_line(F.col("title")).alias("title"), F.split("categories", " ").alias("categories"), T.one_line(F.col("abstract")).alias("abstract"), T.http_date(T.first_version(F.col("versions"))).alias("date"))


def load_papers(spark: SparkSession, path: str, date_min: str, date_max: str, cache: str | None = None) -> DataFrame:
    """Papers first submitted within the bounds; ``date_max`` is its midnight. A cache is kept by bounds, so other bounds read anew."""
    if cache:
        at = f"{cache}/papers-{date_min}-{date_max}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return spark.read.parquet(at)
    found = papers_of(spark.read.schema(schemas.SNAPSHOT).json(path)).filter(F.col("date").between(F.lit(date_min).cast("timestamp"), F.lit(date_max).cast("timestamp")))
    if cache:
        found.write.mode("overwrite").parquet(at)
        return spark.read.parquet(at)
    return found


def with_citations(papers: DataFrame, citations: DataFrame, least: int | None = None) -> DataFrame:
    """Papers with a known citation_count, and at least ``least`` of them."""
    out = papers.join(citations.select("id", "citation_count"), "id").filter("citation_count is not null")
    return out if least is None else out.filter(F.col("citation_count") >= least)


def paper_graph(papers: DataFrame, graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(page_category, unknown): pages by the graph's vertices, and category ids that are none of them, with how often."""
    rows = papers.select(F.col("id").alias("page_id"), F.explode(F.array_distinct(F.transform("categories", category_of))).alias("node_id"))
    ids = graph.vertices.select(F.col("id").alias("node_id"))
    return rows.join(ids, "node_id", "left_semi").select("page_id", "node_id"), rows.join(ids, "node_id", "left_anti").groupBy("node_id").agg(F.count("*").alias("n"))


def taxonomy(spark: SparkSession, groups: DataFrame, archives: DataFrame, categories: DataFrame, root: str = T.ROOT) -> Graph:
    """root -> groups -> archives -> categories as a graph. ``groups``: id, name, is_test; ``archives``: id, name, in_group, is_test; ``categories``: id, name, in_archive.

    Test groups and archives are left out; ids are replaced by the ones in use; loops that come of that go.
    """
    g, a = (f.filter(~F.coalesce("is_test", F.lit(False))) for f in (groups, archives))
    top = g.select(F.lit(root).alias("src"), category_of(F.col("id")).alias("dst"), "name")
    middle = a.select(category_of(F.col("in_group")).alias("src"), category_of(F.col("id")).alias("dst"), "name")
    low = categories.select(category_of(F.col("in_archive")).alias("src"), category_of(F.col("id")).alias("dst"), "name")
    rows = top.unionByName(middle).unionByName(low)
    own = spark.range(1).select(F.lit(root).alias("id"), F.lit(root).alias("title"))
    vertices = rows.groupBy(F.col("dst").alias("id")).agg(F.min("name").alias("title")).filter(F.col("id") != root).unionByName(own)
    edges = rows.filter("src <> dst").select("src", "dst").distinct().withColumn("weight", F.lit(1.0))
    return Graph(vertices, edges, root)


def category_graph(categories: DataFrame, pages: DataFrame, root: str) -> tuple[Graph, DataFrame, int]:
    """(graph, page_category, missing) from crawled records: subcategory edges whose ends are both known; pages that are known; how many were not.

    Of repeated page ids and category ids, the last in ``at`` order counts if there is such a column.
    """
    from graphloom.operators.tables import last_wins

    if "at" in categories.columns:
        categories = last_wins(categories, "id", "at")
    if "at" in pages.columns:
        pages = last_wins(pages, "id", "at")
    vertices = categories.select(F.col("id").cast("string").alias("id"), T.without_prefix(F.col("title")).alias("title"))
    links = categories.select(F.col("id").cast("string").alias("src"), F.explode("sub_categories").alias("s")).select("src", F.col("s.id").cast("string").alias("dst")).distinct().withColumn("weight", F.lit(1.0))
    graph = Graph(vertices, links, root)
    rows = categories.select(F.col("id").cast("string").alias("node_id"), F.explode("pages").alias("page_id")).distinct()
    known = pages.select(F.col("id").alias("page_id")).distinct()
    return graph.induced(vertices), rows.join(known, "page_id", "left_semi"), rows.join(known, "page_id", "left_anti").count()
