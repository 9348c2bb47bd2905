"""Graphs and records made from the driver's tables, each with the SQL that makes the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import ROOT
from graphloom.graph import Graph
from graphloom.operators.extract import transitions


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an event type follows another within a user's events: dense, with loops and reciprocal edges."""
    return transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


EVENT_EDGES = """event_edges AS (
  SELECT src, dst, count(*)::DOUBLE AS weight FROM (
    SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src, event_type AS dst FROM events)
  WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src, dst)"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders between nations: supplier's to customer's, counted."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    s, c, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = l.select("l_orderkey", "l_suppkey").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(s.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(c.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    names = lambda k, a: n.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(a))
    counted = rows.groupBy("s_nationkey", "c_nationkey").agg(F.count("*").cast("double").alias("weight"))
    return counted.join(names("s_nationkey", "src"), "s_nationkey").join(names("c_nationkey", "dst"), "c_nationkey").select("src", "dst", "weight")


TRADE_EDGES = """trade_edges AS (
  SELECT a.n_name AS src, b.n_name AS dst, count(*)::DOUBLE AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey GROUP BY a.n_name, b.n_name)"""


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier to part, by how many line items: sparse and large."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").cast("double").alias("weight"))
    return rows.select(F.concat(F.lit("s:"), "l_suppkey").alias("src"), F.concat(F.lit("p:"), "l_partkey").alias("dst"), "weight")


SUPPLY_EDGES = """supply_edges AS (
  SELECT 's:' || l_suppkey AS src, 'p:' || l_partkey AS dst, count(*)::DOUBLE AS weight FROM lineitem GROUP BY l_suppkey, l_partkey)"""


def taxonomy(spark: SparkSession, sf_dir: str) -> Graph:
    """root -> regions -> nations -> suppliers."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    vertices = spark.range(1).select(F.lit("root").alias("id"), F.lit(ROOT).alias("title"))
    vertices = vertices.unionByName(r.select(key("r:", "r_regionkey").alias("id"), F.col("r_name").alias("title")))
    vertices = vertices.unionByName(n.select(key("n:", "n_nationkey").alias("id"), F.col("n_name").alias("title"))).unionByName(s.select(key("s:", "s_suppkey").alias("id"), F.col("s_name").alias("title")))
    edges = r.select(F.lit("root").alias("src"), key("r:", "r_regionkey").alias("dst"))
    edges = edges.unionByName(n.select(key("r:", "n_regionkey").alias("src"), key("n:", "n_nationkey").alias("dst"))).unionByName(s.select(key("n:", "s_nationkey").alias("src"), key("s:", "s_suppkey").alias("dst")))
    return Graph(vertices, edges.withColumn("weight", F.lit(1.0)), "root")


TAXONOMY = f"""tax_v AS (
  SELECT 'root' AS id, '{ROOT}' AS title UNION ALL SELECT 'r:' || r_regionkey, r_name FROM region
  UNION ALL SELECT 'n:' || n_nationkey, n_name FROM nation UNION ALL SELECT 's:' || s_suppkey, s_name FROM supplier),
tax_e AS (
  SELECT 'root' AS src, 'r:' || r_regionkey AS dst FROM region UNION ALL SELECT 'r:' || n_regionkey, 'n:' || n_nationkey FROM nation
  UNION ALL SELECT 'n:' || s_nationkey, 's:' || s_suppkey FROM supplier)"""

DEPTHS = """tax_d AS (
  WITH RECURSIVE b(id, depth) AS (SELECT 'root', 0 UNION SELECT dst, depth + 1 FROM b JOIN tax_e ON src = id) SELECT id, min(depth) AS depth FROM b GROUP BY id)"""


def page_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of the suppliers that sold them in some quantity: many to many."""
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity >= 25").select(F.col("l_partkey").alias("page_id"), F.concat(F.lit("s:"), "l_suppkey").alias("node_id"))
    return rows.distinct()


PAGE_CATEGORY = """page_category AS (
  SELECT DISTINCT l_partkey AS page_id, 's:' || l_suppkey AS node_id FROM lineitem WHERE l_quantity >= 25)"""


def path_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated text for each supplier: a path, the same again, a blank line, and for some an invalid one."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat_ws(" -> ", F.lit(ROOT), "r_name", "n_name", "s_name")
    bad = F.when(F.col("s_suppkey") % 7 == 0, F.concat(F.lit("\n"), F.lit(ROOT))).when(F.col("s_suppkey") % 5 == 0, F.concat(F.lit("\n"), F.lit(ROOT), F.lit(" -> "), "r_name", F.lit("->"), "n_name")).otherwise("")
    return rows.select(F.col("s_suppkey").alias("id"), F.concat(path, F.lit("\n\n  "), path, F.lit("  "), bad).alias("hierarchy"), F.array(F.array(F.lit(ROOT), "r_name", "n_name", "s_name")).alias("paths"))


PATH_ROWS = """path_rows AS (
  SELECT s_suppkey, r_name, n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def chain_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer to the next of its nation and segment; building customers' chains are closed to rings."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer")
    group = Window.partitionBy("c_nationkey", "c_mktsegment")
    order = group.orderBy("c_custkey")
    rows = c.select(F.col("c_custkey").alias("src"), F.lead("c_custkey").over(order).alias("next"), F.min("c_custkey").over(group).alias("first"), "c_mktsegment")
    rows = rows.select("src", F.coalesce("next", F.when(F.col("c_mktsegment") == "BUILDING", F.col("first"))).alias("dst")).filter("dst is not null")
    key = lambda x: F.lpad(F.col(x).cast("string"), 9, "0").alias(x)
    return rows.select(key("src"), key("dst"), F.lit(1.0).alias("weight"))


CHAIN_EDGES = """chain_edges AS (
  SELECT lpad(src::VARCHAR, 9, '0') AS src, lpad(dst::VARCHAR, 9, '0') AS dst FROM (
    SELECT c_custkey AS src, coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey),
      CASE WHEN c_mktsegment = 'BUILDING' THEN min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) END) AS dst FROM customer)
  WHERE dst IS NOT NULL)"""


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("id")).withColumn("title", F.col("id"))
