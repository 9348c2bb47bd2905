"""The registered queries on the driver's tables, with equivalent SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import prompts
from graphloom.functions import text as T
from graphloom.graph import Graph, endpoints
from graphloom.operators import association, extract, metrics, prune, similarity, structure, tables, traverse
from graphloom.plans import fixtures as X
from graphloom.plans import sweep as S
from graphloom.runtime import materialise
from graphloom.sources import papers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _six(c: str):
    return F.round(F.col(c), 6).alias(c)


# extraction -----------------------------------------------------------------


@query(f"WITH {X.EVENT_EDGES} SELECT * FROM event_edges")
def edge_count_transitions(spark, d):
    return X.event_edges(spark, d)


@query(
    f"""WITH {X.PATH_ROWS}, p AS (SELECT ['{T.ROOT}', r_name, n_name, s_name] AS v FROM path_rows),
    e AS (SELECT unnest([1, 2, 3]) AS i, v FROM p) SELECT v[i] AS src, v[i + 1] AS dst, count(*)::DOUBLE AS weight FROM e GROUP BY v[i], v[i + 1]"""
)
def edge_count_per_doc(spark, d):
    return extract.edges_per_document(X.path_texts(spark, d), T.parse_paths(F.col("hierarchy"))["relations"])


@query(
    f"""WITH {X.PATH_ROWS} SELECT s_suppkey AS id, (2 + (s_suppkey % 7 = 0 OR s_suppkey % 5 = 0)::INT)::INT AS total, (s_suppkey % 7 = 0 OR s_suppkey % 5 = 0)::INT AS invalid,
    '{T.ROOT}>' || r_name || '|' || r_name || '>' || n_name || '|' || n_name || '>' || s_name AS relations FROM path_rows"""
)
def parse_paths(spark, d):
    p = X.path_texts(spark, d).withColumn("p", T.parse_paths(F.col("hierarchy")))
    return p.select("id", "p.total", "p.invalid", F.array_join(F.transform("p.relations", lambda r: F.concat_ws(">", r["src"], r["dst"])), "|").alias("relations"))


@query(
    f"""WITH {X.PATH_ROWS}, t AS (SELECT (s_suppkey % 7 = 0 OR s_suppkey % 5 = 0)::INT AS bad FROM path_rows)
    SELECT count(*) AS n_samples, sum(bad)::BIGINT AS n_invalid_samples, sum(2 + bad)::BIGINT AS n_paths, sum(bad)::BIGINT AS n_invalid_paths, (3 * count(*))::BIGINT AS n_relations,
    round(sum(bad) / count(*)::DOUBLE, 6) AS invalid_samples, round(sum(bad)::DOUBLE / sum(2 + bad), 6) AS invalid_paths FROM t"""
)
def parse_quality(spark, d):
    return extract.parse_quality(X.path_texts(spark, d)).select("n_samples", "n_invalid_samples", "n_paths", "n_invalid_paths", "n_relations", _six("invalid_samples"), _six("invalid_paths"))


@query(
    """SELECT p_brand AS src, p_name AS dst, count(*)::DOUBLE AS weight FROM part GROUP BY p_brand, p_name
    UNION ALL SELECT p_type, p_name, count(*)::DOUBLE FROM part WHERE p_size > 25 GROUP BY p_type, p_name"""
)
def parse_triplets(spark, d):
    extra = F.when(F.col("p_size") > 25, F.concat(F.lit(" <subj> "), "p_type", F.lit(" <obj> part of"))).otherwise(F.concat(F.lit(" <subj> "), "p_type", F.lit(" <obj> country")))
    text = F.concat(F.lit("<s><triplet> "), "p_name", F.lit(" <subj> "), "p_brand", F.lit(" <obj> subclass of"), extra, F.lit("</s>"))
    return extract.edges_per_document(X.table(spark, d, "part").select(text.alias("t")), T.triplet_edges(T.parse_triplets(F.col("t"))))


@query(
    """SELECT 'subclass of' AS type, count(DISTINCT (p_brand, p_name)) AS n FROM part
    UNION ALL SELECT 'instance of', count(DISTINCT (p_type, p_name)) FROM part"""
)
def relation_histogram(spark, d):
    text = F.concat(F.lit("<triplet> "), "p_name", F.lit(" <subj> "), "p_brand", F.lit(" <obj> subclass of <subj> "), "p_type", F.lit(" <obj> instance of"))
    return extract.relation_histogram(X.table(spark, d, "part").select(T.parse_triplets(text).alias("triplets")))


@query("SELECT concept, count(*) AS n FROM (SELECT p_type AS concept FROM part UNION ALL SELECT p_brand FROM part) GROUP BY concept ORDER BY n DESC, concept LIMIT 40")
def parse_concepts_topk(spark, d):
    text = F.concat(F.lit('"'), "p_type", F.lit('". , '), "p_brand", F.lit(".\n"))
    counts = extract.concept_counts(X.table(spark, d, "part").select(text.alias("concepts"))).filter("concept <> ''")
    return counts.orderBy(F.desc("n"), "concept").limit(40).select("concept", "n")


@query(
    f"""WITH {X.PATH_ROWS}, e AS (
      SELECT '{T.ROOT}' AS src, r_name AS dst FROM path_rows UNION ALL SELECT r_name, n_name FROM path_rows UNION ALL SELECT n_name, s_name FROM path_rows),
    c AS (SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst) SELECT src, dst, n, round(avg(n) OVER () / n, 6) AS ratio FROM c"""
)
def edge_reweighting(spark, d):
    return extract.edge_reweighting(X.path_texts(spark, d)).select("src", "dst", "n", _six("ratio"))


@query(
    f"""WITH {X.PATH_ROWS}, e AS (
      SELECT '{T.ROOT}' AS src, r_name AS dst FROM path_rows UNION ALL SELECT r_name, n_name FROM path_rows UNION ALL SELECT n_name, s_name FROM path_rows),
    c AS (SELECT src, dst, count(*) AS n FROM e GROUP BY src, dst), r AS (SELECT src, dst, avg(n) OVER () / n AS ratio FROM c),
    w AS (SELECT s_suppkey AS doc_id, unnest([0, 1, 2, 3]) AS "at", unnest(['{T.ROOT}', r_name, n_name, s_name]) AS word, unnest([NULL, '{T.ROOT}', r_name, n_name]) AS before FROM path_rows)
    SELECT doc_id, 0 AS path, "at", word, "at" > 0 AND (('0x' || substr(md5(doc_id || ':0:' || "at" || ':0'), 1, 8))::BIGINT / 4294967296.0) > coalesce(ratio, 1.0) AS ignored
    FROM w LEFT JOIN r ON before = src AND word = dst"""
)
def loss_mask(spark, d):
    samples = X.path_texts(spark, d)
    return extract.loss_mask(samples, extract.edge_reweighting(samples))


@query(
    """WITH h AS (SELECT doc_id, 'NP_' || lang AS a, 'NP_' || source AS b FROM documents)
    SELECT a AS src, b AS dst, 'such as' AS rule, count(*)::DOUBLE AS weight FROM h GROUP BY a, b UNION ALL SELECT b, a, 'and other', count(*)::DOUBLE FROM h GROUP BY a, b
    UNION ALL SELECT a, 'NP_x', 'such as', count(*)::DOUBLE FROM h GROUP BY a"""
)
def hearst_patterns(spark, d):
    a, b = F.concat(F.lit("NP_"), "lang"), F.concat(F.lit("NP_"), "source")
    text = F.concat(F.lit("Some "), a, F.lit(", such as "), b, F.lit(", and NP_x. The "), a, F.lit(" and other "), b, F.lit(" too."))
    rows = X.table(spark, d, "documents").select(F.inline(T.hearst_pairs(text)))
    return rows.groupBy("src", "dst", "rule").agg(F.count("*").cast("double").alias("weight"))


@query("SELECT p_name AS dst, p_brand AS src, count(*)::DOUBLE AS weight FROM part WHERE p_partkey % 3 <> 0 GROUP BY ALL")
def tagged_lines(spark, d):
    line = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws("|||", F.concat(F.lit(" "), "p_name"), F.concat("p_brand", F.lit(" ")), F.lit("such as 1")))
    rows = X.table(spark, d, "part").select(T.tagged_relation(line).alias("r")).filter("r is not null")
    return extract.edge_counts(rows.select(F.col("r.parent").alias("src"), F.col("r.child").alias("dst")))


# pruning ---------------------------------------------------------------------


@query(f"WITH {X.SUPPLY_EDGES}, r AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS k, count(*) OVER () AS n FROM supply_edges) SELECT src, dst, weight FROM r WHERE k > floor(0.3 * n)")
def prune_absolute(spark, d):
    return prune.prune_absolute(X.supply_edges(spark, d), 0.3)


_RELATIVE = """shares AS (
  SELECT *, sum(weight) OVER (PARTITION BY src ORDER BY weight DESC, dst ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY src) AS cum FROM {e}),
relative AS (SELECT *, max(CASE WHEN cum > {p} THEN weight END) OVER (PARTITION BY src) AS cut FROM shares)"""


@query(f"WITH {X.TRADE_EDGES}, {_RELATIVE.format(e='trade_edges', p=0.6)} SELECT src, dst, weight FROM relative WHERE weight > cut")
def prune_relative(spark, d):
    return prune.prune_relative(X.trade_edges(spark, d), 0.6)


@query(
    f"""WITH {X.TRADE_EDGES}, s AS (SELECT *, sum(weight) OVER (PARTITION BY src ORDER BY weight, dst DESC ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY src) AS c FROM trade_edges)
    SELECT src, dst, weight FROM s WHERE c > 0.4"""
)
def prune_relative_inclusive(spark, d):
    return prune.prune_relative_inclusive(X.trade_edges(spark, d), 0.4)


@query(f"WITH {X.TRADE_EDGES} SELECT a.src, a.dst, a.weight FROM trade_edges a LEFT JOIN trade_edges b ON a.src = b.dst AND a.dst = b.src WHERE b.weight IS NULL OR b.weight <= a.weight")
def prune_inverse(spark, d):
    return prune.prune_inverse(X.trade_edges(spark, d))


@query(f"WITH {X.TRADE_EDGES} SELECT * FROM trade_edges WHERE src <> dst")
def prune_self_loops(spark, d):
    return prune.prune_self_loops(X.trade_edges(spark, d))


_POST = """ranked AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS k, count(*) OVER () AS n FROM relative),
kept AS (
  SELECT a.src, a.dst, a.weight FROM ranked a LEFT JOIN {e} b ON a.src = b.dst AND a.dst = b.src
  WHERE a.k > floor({a} * a.n) AND a.weight > a.cut AND a.src <> a.dst AND (b.weight IS NULL OR b.weight <= a.weight)),
rooted AS (
  SELECT * FROM kept UNION ALL SELECT 'Main topic classifications', id, 1.0
  FROM (SELECT src AS id FROM kept UNION SELECT dst FROM kept) WHERE id NOT IN (SELECT dst FROM kept))"""

SETTINGS = prune.Settings(absolute_percentile=0.25, relative_percentile=0.8)


@query(f"WITH {X.TRADE_EDGES}, {_RELATIVE.format(e='trade_edges', p=0.8)}, {_POST.format(e='trade_edges', a=0.25)} SELECT src, dst, weight FROM rooted")
def post_process(spark, d):
    return prune.post_process(Graph.of(X.trade_edges(spark, d)), SETTINGS).edges


@query(f"WITH {X.EVENT_EDGES}, {_RELATIVE.format(e='event_edges', p=0.8)}, {_POST.format(e='event_edges', a=0.25)} SELECT src, dst, weight FROM rooted")
def flagship(spark, d):
    """Event sequences to weighted edges, with all four pruning rules and a root."""
    return prune.post_process(Graph.of(X.event_edges(spark, d)), SETTINGS).edges


@query(f"WITH {X.SUPPLY_EDGES} SELECT * FROM supply_edges UNION ALL SELECT '{T.ROOT}', src, 1.0 FROM (SELECT DISTINCT src FROM supply_edges)")
def add_root(spark, d):
    return prune.add_root(Graph.of(X.supply_edges(spark, d))).edges


# traversal --------------------------------------------------------------------


@query(f"WITH {X.TAXONOMY}, {X.DEPTHS} SELECT id, depth::INT AS depth FROM tax_d")
def bfs_depth(spark, d):
    return traverse.depths(X.taxonomy(spark, d))


@query(f"WITH {X.TAXONOMY} SELECT src, dst FROM tax_e WHERE src NOT LIKE 'n:%'")
def depth_cut(spark, d):
    return traverse.depth_cut(X.taxonomy(spark, d), 2).edges.select("src", "dst")


@query(
    f"""WITH {X.TAXONOMY}, paged AS (SELECT 's:' || s_suppkey AS id FROM supplier WHERE s_acctbal > 5000),
    up AS (SELECT id FROM paged UNION SELECT src FROM tax_e WHERE dst IN (SELECT id FROM paged)), up2 AS (SELECT id FROM up UNION SELECT src FROM tax_e WHERE dst IN (SELECT id FROM up)),
    up3 AS (SELECT id FROM up2 UNION SELECT src FROM tax_e WHERE dst IN (SELECT id FROM up2)) SELECT id FROM up3"""
)
def cleanup(spark, d):
    paged = X.table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"))
    return traverse.clean_up(X.taxonomy(spark, d), paged).vertices.select("id")


_SPLIT = """dealt AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':0'), id) AS k, count(*) OVER () AS n FROM tax_d WHERE depth = 2),
one AS (SELECT id FROM dealt WHERE k <= floor(0.4 * n)), two AS (SELECT id FROM dealt WHERE k > floor(0.4 * n)),
sh AS (SELECT id FROM tax_d WHERE depth < 2),
g1 AS (SELECT id FROM one UNION SELECT dst FROM tax_e WHERE src IN (SELECT id FROM one) UNION SELECT id FROM sh),
g2 AS (SELECT id FROM two UNION SELECT dst FROM tax_e WHERE src IN (SELECT id FROM two) UNION SELECT id FROM sh)"""


@query(f"WITH {X.TAXONOMY}, {X.DEPTHS}, {_SPLIT} SELECT id, 1 AS part FROM g1 UNION ALL SELECT id, 2 FROM g2")
def split_nodes(spark, d):
    a, b = traverse.split(X.taxonomy(spark, d), 2, 0.4)
    return a.vertices.select("id", F.lit(1).alias("part")).unionByName(b.vertices.select("id", F.lit(2).alias("part")))


@query(
    f"""WITH {X.TAXONOMY}, {X.DEPTHS}, {_SPLIT}, x AS (
      SELECT 'node' AS kind, depth, id IN (SELECT id FROM g1) AS a, id IN (SELECT id FROM g2) AS b FROM tax_d
      UNION ALL SELECT 'edge', least(s.depth, t.depth), src IN (SELECT id FROM g1) AND dst IN (SELECT id FROM g1), src IN (SELECT id FROM g2) AND dst IN (SELECT id FROM g2)
      FROM tax_e JOIN tax_d s ON src = s.id JOIN tax_d t ON dst = t.id)
    SELECT kind, depth::INT AS depth, count(*) AS total, count_if(a)::BIGINT AS train, count_if(b)::BIGINT AS test, count_if(a AND b)::BIGINT AS shared, count_if(a OR b)::BIGINT AS covered
    FROM x GROUP BY GROUPING SETS ((kind, depth), (kind))"""
)
def split_report(spark, d):
    g = X.taxonomy(spark, d)
    return traverse.split_report(g, *traverse.split(g, 2, 0.4))


@query(
    f"""WITH {X.TRADE_EDGES}, top AS (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM trade_edges WHERE src <> dst) WHERE k <= 3),
    p AS (WITH RECURSIVE q(path) AS (SELECT ['FRANCE'] UNION ALL SELECT list_append(path, dst) FROM q JOIN top ON path[-1] = src WHERE NOT list_contains(path, dst) AND len(path) <= 4) SELECT path FROM q)
    SELECT array_to_string(path, '>') AS path, path[-1] AS "end" FROM p""".replace("FRANCE", "NATION_0")
)
def simple_paths(spark, d):
    return traverse.simple_paths(_top_trade(spark, d), "NATION_0", 4).select(F.array_join("path", ">").alias("path"), "end")


def _top_trade(spark, d):
    """The three strongest trade edges of each nation: sparse, with cycles."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return X.trade_edges(spark, d).filter("src <> dst").withColumn("k", F.row_number().over(w)).filter("k <= 3").drop("k")


_TOP_TRADE = "top AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM trade_edges WHERE src <> dst) WHERE k <= 3)"


@query(
    f"""WITH {X.TAXONOMY}, {X.PAGE_CATEGORY}, p AS (SELECT c.dst AS id, 'root>' || b.src || '>' || c.src || '>' || c.dst AS path FROM tax_e c JOIN tax_e b ON b.dst = c.src JOIN tax_e a ON a.dst = b.src)
    SELECT page_id, string_agg(path, '|' ORDER BY path) AS paths FROM page_category JOIN p ON node_id = id GROUP BY page_id"""
)
def page_paths(spark, d):
    found = traverse.page_paths(X.taxonomy(spark, d).edges, "root", X.page_category(spark, d), 5)
    return found.select("page_id", F.array_join(F.array_sort(F.transform("paths", lambda p: F.array_join(p, ">"))), "|").alias("paths"))


_PAGE_PATHS = f"""{X.TAXONOMY}, {X.PAGE_CATEGORY}, counts AS (SELECT page_id, count(*) AS n FROM page_category GROUP BY page_id)"""


@query(
    f"""WITH {_PAGE_PATHS} SELECT 'paths_per_document' AS what, list_transform(quantile_cont(n, [0.05, 0.25, 0.5, 0.75, 0.95]), lambda x: round(x, 6))::VARCHAR AS quantiles, round(avg(n), 6) AS mean FROM counts
    UNION ALL SELECT 'path_length', '[4.0, 4.0, 4.0, 4.0, 4.0]', 4.0"""
)
def path_quantiles(spark, d):
    found = tables.path_statistics(traverse.page_paths(X.taxonomy(spark, d).edges, "root", X.page_category(spark, d), 5))
    return found.select("what", F.concat(F.lit("["), F.array_join(F.transform("quantiles", lambda q: F.round(q, 6).cast("string")), ", "), F.lit("]")).alias("quantiles"), _six("mean"))


@query(
    f"""WITH {X.TAXONOMY}, {X.PAGE_CATEGORY}, s AS (SELECT DISTINCT node_id AS id FROM page_category), n AS (SELECT DISTINCT src AS id FROM tax_e WHERE dst IN (SELECT id FROM s)),
    r AS (SELECT DISTINCT src AS id FROM tax_e WHERE dst IN (SELECT id FROM n)), used AS (SELECT * FROM tax_e WHERE dst IN (SELECT id FROM s UNION SELECT id FROM n UNION SELECT id FROM r))
    SELECT (SELECT count(*) FROM tax_e) AS n_edges, (SELECT count(*) FROM tax_e) - (SELECT count(*) FROM used) AS n_unused, round(((SELECT count(*) FROM tax_e) - (SELECT count(*) FROM used))::DOUBLE / (SELECT count(*) FROM tax_e), 6) AS unused"""
)
def edge_coverage(spark, d):
    g = X.taxonomy(spark, d)
    return tables.edge_coverage(traverse.page_paths(g.edges, "root", X.page_category(spark, d), 5), g.edges).select("n_edges", "n_unused", _six("unused"))


@query(f"WITH {X.TAXONOMY}, {X.DEPTHS} SELECT src, dst FROM tax_e JOIN tax_d ON src = id WHERE depth = 1")
def level_edges(spark, d):
    g = X.taxonomy(spark, d)
    return traverse.edges_at(g, traverse.depths(g), 1)


@query(
    f"""WITH {X.TRADE_EDGES}, {_TOP_TRADE}, p AS (WITH RECURSIVE q(path) AS (SELECT ['NATION_0'] UNION ALL SELECT list_append(path, dst) FROM q JOIN top ON path[-1] = src
      WHERE NOT list_contains(path, dst) AND len(path) <= 5) SELECT path FROM q WHERE path[-1] = 'NATION_7') SELECT array_to_string(path, '>') AS path FROM p ORDER BY len(path), path LIMIT 5"""
)
def k_shortest_paths(spark, d):
    text = F.array_join("path", ">")  # the SQL's ORDER BY path is that of the joined text, where > stands behind digits
    return traverse.k_shortest_paths(_top_trade(spark, d), "NATION_0", "NATION_7", 5, 5, ties=text).select(text.alias("path"))


@query(
    f"""WITH {X.TAXONOMY} SELECT src, dst, CASE WHEN src = 'root' THEN 'neither' WHEN src LIKE 'r:%' THEN 'test' ELSE 'train' END AS "where" FROM tax_e
    WHERE src = 'n:3' OR dst = 'n:3' OR (src = 'root' AND dst IN (SELECT src FROM tax_e WHERE dst = 'n:3'))"""
)
def topic_subgraph(spark, d):
    g = X.taxonomy(spark, d)
    return traverse.topic_subgraph(g, "n:3", g.edges.filter("src like 'n:%'"), g.edges.filter("src like 'r:%'"))


# literal scores and statistics ------------------------------------------------


def _two_graphs(spark, d):
    """Trade as seen after pruning against trade between distinct nations in quantity."""
    edges = X.trade_edges(spark, d)
    return Graph.of(prune.prune_absolute(edges, 0.4)), Graph.of(prune.prune_relative(edges, 0.7).filter("src <> dst"))


_TWO = f"""{X.TRADE_EDGES}, {_RELATIVE.format(e="trade_edges", p=0.7)}, ra AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS k, count(*) OVER () AS n FROM trade_edges),
p AS (SELECT src, dst, weight FROM ra WHERE k > floor(0.4 * n)), t AS (SELECT src, dst, weight FROM relative WHERE weight > cut AND src <> dst)"""

_PRF = """, s AS (SELECT coalesce(h::DOUBLE / nullif(np, 0), 0) AS precision, coalesce(h::DOUBLE / nullif(nt, 0), 0) AS recall FROM c)
SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM s"""


@query(
    f"""WITH {_TWO}, a AS (SELECT src AS x FROM p UNION SELECT dst FROM p), b AS (SELECT src AS x FROM t UNION SELECT dst FROM t),
    c AS (SELECT (SELECT count(*) FROM a JOIN b USING (x)) AS h, (SELECT count(*) FROM a) AS np, (SELECT count(*) FROM b) AS nt){_PRF}"""
)
def prf1_nodes(spark, d):
    return metrics.node_scores(*_two_graphs(spark, d)).select(_six("precision"), _six("recall"), _six("f1"))


@query(f"WITH {_TWO}, c AS (SELECT (SELECT count(*) FROM p JOIN t USING (src, dst)) AS h, (SELECT count(*) FROM p) AS np, (SELECT count(*) FROM t) AS nt){_PRF}")
def prf1_edges(spark, d):
    return metrics.edge_scores(*_two_graphs(spark, d)).select(_six("precision"), _six("recall"), _six("f1"))


@query(
    f"""WITH {X.SUPPLY_EDGES}, v AS (SELECT src AS id FROM supply_edges UNION SELECT dst FROM supply_edges)
    SELECT id, (SELECT count(*) FROM supply_edges WHERE dst = id) AS in_degree, (SELECT count(*) FROM supply_edges WHERE src = id) AS out_degree FROM v"""
)
def degree_dist(spark, d):
    return structure.degrees(Graph.of(X.supply_edges(spark, d)))


@query(
    f"""WITH {X.TRADE_EDGES}, p AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS w FROM trade_edges GROUP BY 1, 2)
    SELECT id, sum(w) AS degree FROM (SELECT a AS id, w FROM p UNION ALL SELECT b, w FROM p) GROUP BY id"""
)
def weighted_degree(spark, d):
    return structure.weighted_degrees(X.trade_edges(spark, d))


@query(f"WITH {X.TAXONOMY} SELECT n AS num_nodes, m AS num_edges, round(m::DOUBLE / (n * (n - 1)), 9) AS density FROM (SELECT (SELECT count(*) FROM tax_v) AS n, (SELECT count(*) FROM tax_e) AS m)")
def density(spark, d):
    return structure.summary(X.taxonomy(spark, d)).select("num_nodes", "num_edges", F.round("density", 9).alias("density"))


@query("SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM customer GROUP BY c_nationkey, c_mktsegment) GROUP BY size")
def wcc_sizes(spark, d):
    return structure.component_sizes(structure.weak_components(X.customers(spark, d), X.chain_edges(spark, d)))


@query(
    """SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY c_nationkey
    UNION ALL SELECT 1 FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY size"""
)
def scc_sizes(spark, d):
    return structure.component_sizes(structure.strong_components(X.customers(spark, d), X.chain_edges(spark, d)))


@query("SELECT max(n) - 1 AS diameter FROM (SELECT count(*) AS n FROM supplier WHERE false UNION ALL SELECT 7)")
def diameter(spark, d):
    """The taxonomy's: supplier to supplier by way of the root."""
    return spark.range(1).select(F.lit(structure.diameter_estimate(X.taxonomy(spark, d))).cast("bigint").alias("diameter"))


_CENSUS = """nodes AS (SELECT src AS x FROM {e} UNION SELECT dst FROM {e}), adj AS (SELECT DISTINCT src, dst FROM {e} WHERE src <> dst),
tri AS (SELECT (ab.src IS NOT NULL)::INT AS ab, (ba.src IS NOT NULL)::INT AS ba, (ac.src IS NOT NULL)::INT AS ac, (ca.src IS NOT NULL)::INT AS ca, (bc.src IS NOT NULL)::INT AS bc, (cb.src IS NOT NULL)::INT AS cb
  FROM nodes a JOIN nodes b ON a.x < b.x JOIN nodes c ON b.x < c.x LEFT JOIN adj ab ON ab.src = a.x AND ab.dst = b.x LEFT JOIN adj ba ON ba.src = b.x AND ba.dst = a.x
  LEFT JOIN adj ac ON ac.src = a.x AND ac.dst = c.x LEFT JOIN adj ca ON ca.src = c.x AND ca.dst = a.x LEFT JOIN adj bc ON bc.src = b.x AND bc.dst = c.x LEFT JOIN adj cb ON cb.src = c.x AND cb.dst = b.x),
motifs AS (SELECT least(ab + 2*ba + 4*ac + 8*ca + 16*bc + 32*cb, ba + 2*ab + 4*bc + 8*cb + 16*ac + 32*ca, ac + 2*ca + 4*ab + 8*ba + 16*cb + 32*bc,
  ca + 2*ac + 4*cb + 8*bc + 16*ab + 32*ba, bc + 2*cb + 4*ba + 8*ab + 16*ca + 32*ac, cb + 2*bc + 4*ca + 8*ac + 16*ba + 32*ab) AS motif
  FROM tri WHERE (ab + ba > 0)::INT + (ac + ca > 0)::INT + (bc + cb > 0)::INT >= 2)"""


@query(f"WITH {X.TRADE_EDGES}, {_TOP_TRADE}, {_CENSUS.format(e='top')} SELECT motif::INT AS motif, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM motifs GROUP BY motif")
def motif_census(spark, d):
    return structure.motif_census(_top_trade(spark, d)).select("motif", "n", _six("share"))


@query(
    f"""WITH {X.TRADE_EDGES}, {_TOP_TRADE}, {_CENSUS.format(e="top")}, x AS (SELECT motif, count(*)::DOUBLE / sum(count(*)) OVER () AS s FROM motifs GROUP BY motif),
    y AS (SELECT count(*) AS n, sum(n * (n - 1) / 2) AS forks FROM (SELECT count(*) AS n FROM (SELECT 'root' AS src FROM region UNION ALL SELECT 'r' || n_regionkey FROM nation) GROUP BY src)),
    z AS (SELECT 5::DOUBLE AS motif, (10 + (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM nation GROUP BY n_regionkey)))::DOUBLE AS n UNION ALL SELECT {structure.triad_class(0b010001)}, (SELECT count(*) FROM nation)::DOUBLE),
    w AS (SELECT motif, n / sum(n) OVER () AS s FROM z)
    SELECT round(sum(abs(coalesce(x.s, 0) - coalesce(w.s, 0))) / 2, 6) AS distance FROM x FULL JOIN w ON x.motif = w.motif"""
)
def motif_distance(spark, d):
    tree = traverse.depth_cut(X.taxonomy(spark, d), 2).edges
    return structure.motif_distance(structure.motif_census(_top_trade(spark, d)), structure.motif_census(tree)).select(_six("distance"))


@query(
    """WITH f AS (SELECT 'fork' AS motif, (0 + 1 + 1) / 3.0 AS m FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey
      UNION ALL SELECT 'fork', 5 / 3.0 FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey UNION ALL SELECT 'chain', 1.0 FROM nation)
    SELECT motif, round(m, 6)::DOUBLE AS mean_depth, count(*) AS n FROM f GROUP BY ALL"""
)
def motif_depths(spark, d):
    g = traverse.depth_cut(X.taxonomy(spark, d), 2)
    return structure.motif_depths(g.edges, traverse.depths(g)).groupBy("motif", F.round("mean_depth", 6).alias("mean_depth")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {X.TRADE_EDGES}, {_TOP_TRADE}, p AS (WITH RECURSIVE q(path, done) AS (SELECT [src, dst], false FROM top WHERE src < dst
      UNION ALL SELECT CASE WHEN dst = path[1] THEN path ELSE list_append(path, dst) END, dst = path[1] FROM q JOIN top ON path[-1] = src
      WHERE NOT done AND (dst = path[1] OR (dst > path[1] AND NOT list_contains(path, dst) AND len(path) < 4))) SELECT path FROM q WHERE done) SELECT array_to_string(path, '>') AS path FROM p"""
)
def short_cycles(spark, d):
    return structure.short_cycles(_top_trade(spark, d), 4).select(F.array_join("path", ">").alias("path"))


# association and similarity ---------------------------------------------------


_CELLS = "cells AS (SELECT src AS row, dst AS col, weight AS v FROM trade_edges)"
_MARGINS = "m AS (SELECT *, sum(v) OVER (PARTITION BY row) AS row_sum, sum(v) OVER (PARTITION BY col) AS col_sum, sum(v) OVER () AS total FROM cells)"


def _cells(spark, d):
    """Written once, as what is made of them reads them many times and their joins read all line items."""
    return materialise(X.trade_edges(spark, d).select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("v")), "cells")


@query(f"WITH {X.TRADE_EDGES}, {_CELLS}, {_MARGINS} SELECT * FROM m")
def marginals(spark, d):
    return association.marginals(_cells(spark, d))


@query(f"WITH {X.TRADE_EDGES}, {_CELLS}, {_MARGINS} SELECT row, col, round(greatest(0, ln(total) + ln(v) - ln(row_sum) - ln(col_sum)), 6) AS v FROM m")
def ppmi(spark, d):
    return association.ppmi(_cells(spark, d)).select("row", "col", _six("v"))


@query(f"WITH {X.TRADE_EDGES} SELECT src AS row, dst AS col, weight AS score FROM trade_edges ORDER BY weight DESC, row, col LIMIT 250")
def topk_pairs(spark, d):
    nodes = endpoints(X.trade_edges(spark, d))
    n = nodes.count()
    return association.top_cells(_cells(spark, d), nodes, min(10 * n, n * n))


@query()
def svd_scores(spark, d):
    cells = _cells(spark, d)
    return association.svd_scores(association.ppmi(cells), cells.select("row", "col"), 5).select("row", "col", _six("score"))


@query()
def smoothed_graph(spark, d):
    cells = _cells(spark, d)
    return association.smoothed_graph(cells, cells.select("row"), 5).withColumn("weight", F.round("weight", 6))


def _vectors(spark, d):
    return X.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("embedding").alias("embed"), "label")


_COSINE = """u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
sims AS (SELECT a.id AS a, b.id AS b, a.label AS la, b.label AS lb, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS score FROM u a JOIN u b ON true)"""


@query(f"WITH {_COSINE}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS place FROM sims WHERE a <> b) SELECT a, b, round(score, 6) AS score, place::INT AS place FROM r WHERE place <= 6")
def cosine_topk(spark, d):
    v = _vectors(spark, d)
    return similarity.nearest(v, v, 6).select("a", "b", _six("score"), "place")


@query(f"WITH {_COSINE} SELECT a, b, round(score, 6) AS score FROM sims WHERE a % 2 = 0 AND b % 2 = 1 AND score >= 0.3")
def cosine_pairs(spark, d):
    v = _vectors(spark, d)
    return similarity.pairs_above(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"), 0.3).select("a", "b", _six("score"))


@query(
    f"""WITH {_COSINE}, n AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM u), c AS (SELECT a.id AS src, b.id AS dst, a.k FROM n a JOIN n b ON b.k = a.k + 1),
    p AS (SELECT src, dst FROM c WHERE k % 2 = 0), t AS (SELECT src, dst FROM c WHERE k % 3 = 0), hits AS (
      SELECT p.src AS ps, p.dst AS pd, t.src AS ts, t.dst AS td FROM p JOIN sims x ON x.a = p.src AND x.score >= 0.436 JOIN t ON t.src = x.b JOIN sims y ON y.a = p.dst AND y.b = t.dst AND y.score >= 0.436),
    c2 AS (SELECT (SELECT count(DISTINCT (ps, pd)) FROM hits) AS hp, (SELECT count(*) FROM p) AS np, (SELECT count(DISTINCT (ts, td)) FROM hits) AS ht, (SELECT count(*) FROM t) AS nt),
    s AS (SELECT hp::DOUBLE / np AS precision, ht::DOUBLE / nt AS recall FROM c2)
    SELECT round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM s"""
)
def fuzzy_prf1(spark, d):
    return similarity.edge_match(*_vector_graphs(spark, d), 0.436).select(_six("precision"), _six("recall"), _six("f1"))


def _vector_graphs(spark, d):
    """(pred, true, embeds): chains over the vectors, every second and every third link of which are edges."""
    v = _vectors(spark, d)
    k = tables.numbered(v.select("id"), "id").select("id", (F.col("at") + 1).alias("k"))
    links = k.join(k.select(F.col("id").alias("dst"), (F.col("k") - 1).alias("k")), "k").select(F.col("id").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "k")
    part = lambda n: Graph.of(links.filter(F.col("k") % n == 0).select("src", "dst"))
    return part(2), part(3), v.select(F.col("id").cast("string").alias("title"), "embed")


@query(
    f"""WITH {_COSINE}, x AS (SELECT a, max(score) AS s FROM sims WHERE a % 2 = 0 AND b % 2 = 1 GROUP BY a), y AS (SELECT b, max(score) AS s FROM sims WHERE a % 2 = 0 AND b % 2 = 1 GROUP BY b)
    SELECT round(((SELECT avg(s) FROM x) + (SELECT avg(s) FROM y)) / 2, 6) AS similarity"""
)
def best_match_similarity(spark, d):
    v = _vectors(spark, d)
    a, b = v.filter("id % 2 = 0"), v.filter("id % 2 = 1")
    one, two = similarity.best_matches(a, b).agg(F.avg("score").alias("x")), similarity.best_matches(b, a).agg(F.avg("score").alias("y"))
    return one.join(two).select(F.round((F.col("x") + F.col("y")) / 2, 6).alias("similarity"))


def _embedded_chain(spark, d):
    v = _vectors(spark, d)
    pred, _, embeds = _vector_graphs(spark, d)
    return Graph(v.select(F.col("id").cast("string").alias("id"), F.col("id").cast("string").alias("title"), "embed"), pred.edges, None)


@query(
    """WITH n AS (SELECT vec_id::VARCHAR AS id, embedding AS e, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
    pairs AS (SELECT a.id AS src, b.id AS dst FROM n a JOIN n b ON b.k = a.k + 1 WHERE a.k % 2 = 0 UNION ALL SELECT id, id FROM n),
    deg AS (SELECT dst AS id, 1 / sqrt(count(*)) AS d FROM pairs GROUP BY dst), x0 AS (SELECT id, unnest(range(64)) AS i, unnest(e)::DOUBLE AS v FROM n),
    co AS (SELECT src, dst, s.d * t.d AS c FROM pairs JOIN deg s ON src = s.id JOIN deg t ON dst = t.id),
    x1 AS (SELECT dst AS id, i, sum(c * v) AS v FROM co JOIN x0 ON src = x0.id GROUP BY dst, i), x2 AS (SELECT dst AS id, i, sum(c * v) AS v FROM co JOIN x1 ON src = x1.id GROUP BY dst, i)
    SELECT id, i::INT AS i, round(v, 5) AS v FROM x2"""
)
def sgconv_embed(spark, d):
    return similarity.convolved(_embedded_chain(spark, d), 2).select("id", F.posexplode("embed").alias("i", "v")).select("id", "i", F.round("v", 5).alias("v"))


@query()
def graph_similarity(spark, d):
    g = _embedded_chain(spark, d)
    half = g.induced(g.vertices.filter(F.col("id").cast("long") % 2 == 0))
    return similarity.graph_similarity(g, half, 2, "undirected").select(_six("similarity"))


@query()
def soft_edge_f1(spark, d):
    return similarity.soft_edge_match(*_vector_graphs(spark, d)).select(_six("precision"), _six("recall"), _six("f1"))


@query()
def graph_f1(spark, d):
    g = _embedded_chain(spark, d)
    half = g.induced(g.vertices.filter(F.col("id").cast("long") % 2 == 0))
    return similarity.graph_match(g, half, 2, "undirected").select(_six("precision"), _six("recall"), _six("f1"))


@query(
    f"""WITH {X.TRADE_EDGES}, v AS (SELECT src AS id FROM trade_edges UNION SELECT dst FROM trade_edges), n AS (SELECT count(*) AS n FROM v),
    a AS (SELECT src AS x, dst AS y FROM trade_edges WHERE src <> dst UNION SELECT dst, src FROM trade_edges WHERE src <> dst),
    two AS (SELECT p.x AS i, p.y AS m, q.y AS j FROM a p JOIN a q ON p.y = q.x AND p.x < q.y WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.x = p.x AND a.y = q.y)),
    ways AS (SELECT i, j, count(*) AS c FROM two GROUP BY i, j), s AS (SELECT m AS id, sum(1.0 / c) AS s FROM two JOIN ways USING (i, j) GROUP BY m)
    SELECT id, id AS title, round(coalesce(s, 0) * 2 / ((n - 1) * (n - 2)), 6)::DOUBLE AS score FROM v LEFT JOIN s USING (id) JOIN n ON true"""
)
def betweenness(spark, d):
    """No nation is more than two steps from another, so the SQL need not go further."""
    return structure.betweenness(Graph.of(X.trade_edges(spark, d))).select("id", "title", _six("score"))


@query()
def laplacian_spectrum(spark, d):
    return structure.laplacian_spectrum(Graph.of(X.trade_edges(spark, d))).select("at", _six("value"))


@query()
def feedback_edges(spark, d):
    return structure.feedback_edges(_top_trade(spark, d), 4)


@query(
    f"""WITH {X.TAXONOMY}, sizes AS (SELECT id, 1 + (SELECT count(*) FROM tax_e WHERE src = id) AS n FROM tax_v), pick AS (SELECT id FROM sizes WHERE n BETWEEN 3 AND 30 ORDER BY md5(id || ':0'), id LIMIT 1)
    SELECT src, dst, 1.0::DOUBLE AS weight FROM tax_e WHERE src IN (SELECT id FROM pick)"""
)
def random_neighbourhood(spark, d):
    return traverse.random_neighbourhood(X.taxonomy(spark, d), 1, 3, 30).edges


# sweep and evaluation -----------------------------------------------------------


def _sweep_inputs(spark, d):
    pred = Graph.of(X.event_edges(spark, d))
    true = Graph.of(prune.prune_absolute(pred.edges, 0.5).filter("src <> dst"))
    return pred, true, similarity.embed(pred.vertices.unionByName(spark.range(1).select(F.lit(T.ROOT).alias("id"), F.lit(T.ROOT).alias("title"))))


@query()
def hp_sweep(spark, d):
    pred, true, embeds = _sweep_inputs(spark, d)
    out = S.sweep(pred, true, embeds, S.grid(pred.edges.count(), 5))
    return out.select("setting", _six("absolute"), _six("relative"), *[_six(c) for c in out.columns if c.startswith("edge_")])


@query()
def test_evaluation(spark, d):
    pred, true, embeds = _sweep_inputs(spark, d)
    found = S.sweep(pred, true, embeds, S.grid(pred.edges.count(), 3))
    out = S.evaluate("transitions", pred, true, embeds, S.best_settings(found, "edge_soft_f1"))
    return out.select("name", "num_nodes", "num_edges", *[_six(c) for c in out.columns if c.split("_")[-1] in ("precision", "recall", "f1", "distance")])


_KEPT_SQL = ", ".join(f"({i}, {a!r}, {r!r})" for i, (a, r) in enumerate([(0.0, 1.0), (0.2, 0.9), (0.5, 0.5), (0.9, 0.7)]))


@query(
    f"""WITH {X.TRADE_EDGES}, settings(setting, absolute, relative) AS (VALUES {_KEPT_SQL}),
    m AS (SELECT *, row_number() OVER (ORDER BY weight, src, dst) AS k, count(*) OVER () AS n, sum(weight) OVER (PARTITION BY src ORDER BY weight DESC, dst ROWS UNBOUNDED PRECEDING) / sum(weight) OVER (PARTITION BY src) AS cum FROM trade_edges),
    x AS (SELECT s.setting, s.absolute, s.relative, m.*, max(CASE WHEN cum > s.relative THEN m.weight END) OVER (PARTITION BY s.setting, m.src) AS cut FROM m JOIN settings s ON true)
    SELECT x.setting, count(*) AS n, sum(x.weight) AS weight FROM x LEFT JOIN trade_edges b ON x.src = b.dst AND x.dst = b.src
    WHERE x.k > floor(x.absolute * x.n) AND (x.relative = 1 OR x.weight > x.cut) AND x.src <> x.dst AND (b.weight IS NULL OR b.weight <= x.weight) GROUP BY x.setting"""
)
def hp_pruning(spark, d):
    kept = S.pruned_by_setting(Graph.of(X.trade_edges(spark, d)), [(0.0, 1.0), (0.2, 0.9), (0.5, 0.5), (0.9, 0.7)])
    return kept.groupBy("setting").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("SELECT row_idx, metric FROM (SELECT o_orderkey AS row_idx, CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice, -3) END AS metric FROM orders) WHERE metric IS NOT NULL ORDER BY metric DESC, row_idx LIMIT 1")
def best_setting(spark, d):
    rows = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_idx"), F.when(F.col("o_orderkey") % 3 != 0, F.round("o_totalprice", -3)).alias("metric"))
    return metrics.best_setting(rows, "metric")


_PR = """scored AS (SELECT l_quantity AS score, (l_returnflag = 'R')::INT AS hit FROM lineitem), g AS (SELECT score, count(*) AS n, sum(hit) AS h FROM scored GROUP BY score),
curve AS (SELECT score, sum(h) OVER w / sum(n) OVER w AS precision, sum(h) OVER w / (SELECT sum(hit) FROM scored) AS recall FROM g WINDOW w AS (ORDER BY score DESC))"""


def _curve(spark, d):
    scored = X.table(spark, d, "lineitem").select(F.col("l_quantity").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("hit"))
    return metrics.precision_recall_curve(scored, scored.agg(F.sum("hit")).first()[0])


@query(f"WITH {_PR} SELECT score, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall FROM curve")
def pr_curve(spark, d):
    return _curve(spark, d).select("score", _six("precision"), _six("recall"))


@query(
    f"""WITH {_PR}, s AS (SELECT (recall - lag(recall, 1, 0) OVER w) * (precision + coalesce(lag(precision) OVER w, precision)) / 2 AS area, 2 * precision * recall / (precision + recall) AS f1 FROM curve WINDOW w AS (ORDER BY recall, precision DESC))
    SELECT round(sum(area), 6)::DOUBLE AS ap, round(max(f1), 6)::DOUBLE AS best_f1 FROM s"""
)
def pr_curve_ap(spark, d):
    return metrics.average_precision(_curve(spark, d)).select(_six("ap"), _six("best_f1"))


# tables ---------------------------------------------------------------------------


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti(spark, d):
    return tables.remaining(X.table(spark, d, "documents").select("doc_id", "n_chars"), X.table(spark, d, "labels"), "doc_id")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def first_wins(spark, d):
    return tables.first_wins(X.table(spark, d, "documents").select("text", "doc_id"), "text", "doc_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def last_wins(spark, d):
    return tables.last_wins(X.table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id || ':7'), doc_id LIMIT 100")
def hash_sample(spark, d):
    return tables.dealt_sample(X.table(spark, d, "documents").select("doc_id"), 100, "doc_id", 7)


@query(
    """WITH r AS (SELECT c_custkey AS id, n_nationkey AS e, row_number() OVER (PARTITION BY c_custkey ORDER BY md5(c_custkey || ':' || n_nationkey || ':0'), n_nationkey) AS k FROM customer JOIN nation ON true)
    SELECT id, string_agg(e::VARCHAR, ',' ORDER BY k) AS example_ids FROM r WHERE k <= 3 GROUP BY id"""
)
def few_shot(spark, d):
    rows = X.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return tables.few_shot(rows, X.table(spark, d, "nation").select(F.col("n_nationkey").alias("example_id")), 3).select("id", F.array_join(F.transform("example_ids", lambda e: e.cast("string")), ",").alias("example_ids"))


@query(
    f"""WITH {X.TAXONOMY}, t AS (SELECT DISTINCT title FROM tax_v), e AS (SELECT a.title AS src, b.title AS dst FROM tax_e JOIN tax_v a ON src = a.id JOIN tax_v b ON dst = b.id)
    SELECT a.title AS src, b.title AS dst FROM t a JOIN t b ON true WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.title AND e.dst = b.title) ORDER BY md5(a.title || ':' || b.title || ':0'), 1, 2 LIMIT 200"""
)
def negatives(spark, d):
    g = traverse.depth_cut(X.taxonomy(spark, d), 3)
    return tables.negative_pairs(g.vertices, g.titled_edges(), 200)


@query(
    """WITH f AS (SELECT p_brand AS k, 1 AS a, 0 AS b, 0 AS c FROM part WHERE p_size < 20 UNION ALL SELECT p_brand, 0, 1, 0 FROM part WHERE p_type LIKE 'S%' UNION ALL SELECT p_brand, 0, 0, 1 FROM part WHERE p_retailprice > 1500),
    g AS (SELECT k, max(a) AS in_small, max(b) AS in_s, max(c) AS in_dear FROM f GROUP BY k) SELECT in_small, in_s, in_dear, count(*) AS n FROM g GROUP BY ALL"""
)
def venn_regions(spark, d):
    p = X.table(spark, d, "part")
    return metrics.venn({"small": p.filter("p_size < 20"), "s": p.filter("p_type like 'S%'"), "dear": p.filter("p_retailprice > 1500")}, ["p_brand"])


@query("SELECT p_partkey AS id, strftime(TIMESTAMP '2007-04-02 19:18:42' + to_days((p_partkey % 28)::INT), '%Y-%m-%d %H:%M:%S') AS date FROM part")
def version_min_date(spark, d):
    first = F.date_format(F.to_timestamp(F.lit("2007-04-02 19:18:42")) + F.make_dt_interval((F.col("p_partkey") % 28).cast("int")), "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    version = lambda n, c: F.struct(F.lit(n).alias("version"), c.alias("created"))
    versions = F.array(version("v10", F.lit("Mon, 1 Jan 2001 00:00:00 GMT")), version("v2", first), version("v3", F.lit("Tue, 2 Jan 2001 00:00:00 GMT")))
    date = T.http_date(T.first_version(versions))
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.date_format(date, "yyyy-MM-dd HH:mm:ss").alias("date"))


@query("SELECT shard, string_agg(p_name, chr(10) ORDER BY p_partkey) AS text FROM (SELECT p_partkey, p_name, ((row_number() OVER (ORDER BY p_partkey) - 1) // 100)::BIGINT AS shard FROM part) GROUP BY shard")
def text_shards(spark, d):
    return tables.shards(X.table(spark, d, "part").select("p_partkey", "p_name"), F.col("p_name"), 100, "p_partkey")


@query(
    f"""WITH {X.PAGE_CATEGORY}, s AS (SELECT p_partkey AS page_id, length(p_name || p_type) AS n FROM part)
    SELECT (SELECT count(*) FROM s) AS n_pages, (SELECT sum(n) FROM s)::BIGINT AS n_chars, round((SELECT avg(n) FROM s), 6) AS chars_per_page, round((SELECT avg(n) FROM (SELECT sum(n) AS n FROM page_category JOIN s USING (page_id) GROUP BY node_id)), 6) AS chars_per_node, (SELECT sum(n) FROM s) / 4 AS n_tokens"""
)
def corpus_statistics(spark, d):
    pages = X.table(spark, d, "part").select(F.col("p_partkey").alias("page_id"), F.concat("p_name", "p_type").alias("abstract"))
    return tables.corpus_statistics(pages, X.page_category(spark, d)).select("n_pages", "n_chars", _six("chars_per_page"), _six("chars_per_node"), "n_tokens")


@query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_titles(spark, d):
    return tables.repeated(X.table(spark, d, "documents"), "text")


@query("SELECT user_id, event_type, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY user_id), 6) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def group_shares(spark, d):
    counted = X.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return tables.shares(counted, "user_id", "n").select("user_id", "event_type", "n", _six("share"))


@query(
    """WITH o AS (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS "at" FROM events), f AS (SELECT min("at") AS "at" FROM o GROUP BY user_id) SELECT "at", count(*) OVER (ORDER BY "at") AS n FROM f"""
)
def coverage_growth(spark, d):
    return tables.growth(X.table(spark, d, "events").select("event_id", "user_id"), "user_id", "event_id")


@query("SELECT l_partkey AS page_id, min(l_suppkey) AS head, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS items FROM lineitem GROUP BY l_partkey")
def page_members(spark, d):
    rows = X.table(spark, d, "lineitem").select(F.col("l_partkey").alias("page_id"), F.col("l_suppkey").alias("head"), F.col("l_suppkey").cast("string").alias("item"), "l_suppkey")
    out = tables.members(rows, "page_id", ["head"], "l_suppkey")
    return out.select("page_id", "head", F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",").alias("items"))


@query("SELECT d.doc_id, l.quality, (l.doc_id IS NULL) AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join(spark, d):
    labels = X.table(spark, d, "labels").select("doc_id", "quality", F.lit(False).alias("known"))
    return X.table(spark, d, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", F.col("known").isNull().alias("missing"))


@query(
    """WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey % 3 = 0 GROUP BY 1)
    SELECT coalesce(a.k, b.k) AS k, a.n AS n_a, b.n AS n_b FROM a FULL JOIN b ON a.k = b.k"""
)
def full_outer(spark, d):
    count = lambda t, c, m: X.table(spark, d, t).filter(F.col(c) % m == 0).groupBy(F.col(c).alias("k")).agg(F.count("*").alias("n"))
    return tables.full_outer(count("customer", "c_nationkey", 2), count("supplier", "s_nationkey", 3), "k")


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def unpivot(spark, d):
    return tables.long_form(X.table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query(
    """WITH k AS (SELECT l.doc_id, quality AS label, (n_chars > 1000)::INT AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
    c AS (SELECT avg((label = predicted)::INT) AS accuracy, sum(label * predicted)::DOUBLE AS h, sum(predicted) AS p, sum(label) AS t FROM k)
    SELECT round(accuracy, 6) AS accuracy, round(h / p, 6) AS precision, round(h / t, 6) AS recall, round(2 * (h / p) * (h / t) / (h / p + h / t), 6) AS f1 FROM c"""
)
def classification_scores(spark, d):
    rows = X.table(spark, d, "labels").join(X.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").alias("label"), (F.col("n_chars") > 1000).cast("int").alias("predicted"))
    return metrics.classification_scores(rows).select(_six("accuracy"), _six("precision"), _six("recall"), _six("f1"))


@query("SELECT p_partkey AS id, 'Title: ' || p_name || chr(10) || p_type AS prompt, length(p_name) + length(p_type) + length('### ARTICLE ###### END ARTICLE ###Title: ') + 4 AS framed FROM part")
def prompt_text(spark, d):
    a, b = F.col("p_name"), F.col("p_type")
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), prompts.article(a, b).alias("prompt"), F.length(prompts.framed(a, b)).alias("framed"))


@query(
    """SELECT conv_id, '<s>' || string_agg(CASE role WHEN 'user' THEN '[INST] ' || text || ' [/INST]' ELSE text || '</s>' END, '' ORDER BY turn) AS chat
    FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count_if(role <> CASE WHEN turn % 2 = 0 THEN 'user' ELSE 'assistant' END) > 0 OR count(*) <> max(turn) + 1 OR count(DISTINCT turn) <> count(*) OR min(turn) <> 0) GROUP BY conv_id"""
)
def instruct_chat(spark, d):
    c = X.table(spark, d, "conversations")
    sound = c.groupBy("conv_id").agg(F.count_if(F.col("role") != F.when(F.col("turn") % 2 == 0, "user").otherwise("assistant")).alias("odd"), F.count("*").alias("n"), F.max("turn").alias("last"), F.count_distinct("turn").alias("turns"), F.min("turn").alias("first"), F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return sound.filter("odd = 0 and n = last + 1 and turns = n and first = 0").select("conv_id", prompts.instruct_chat(F.col("m")).alias("chat"))


@query("SELECT CASE x WHEN 'cs.IT' THEN 'math.IT' WHEN 'grp_math' THEN 'math' ELSE x END AS category, count(*) AS n FROM (SELECT ['cs.IT', 'grp_math', 'cs.AI', 'math'][(p_partkey % 4)::INT + 1] AS x FROM part) GROUP BY 1")
def category_aliases(spark, d):
    x = F.element_at(F.array(*[F.lit(c) for c in ("cs.IT", "grp_math", "cs.AI", "math")]), (F.col("p_partkey") % 4).cast("int") + 1)
    return X.table(spark, d, "part").groupBy(papers.category_of(x).alias("category")).agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), x AS (SELECT doc_id, unnest(range(len(w))) AS "at", unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b FROM t),
    h AS (SELECT doc_id, "at", CASE WHEN a = 'in' THEN 1 ELSE 2 END AS n, CASE WHEN a = 'in' THEN 'in' ELSE a || ' ' || b END AS concept FROM x WHERE a = 'in' OR (a = 'of' AND b = 'the'))
    SELECT doc_id, "at"::INT AS "at", n::INT AS length, concept FROM h"""
)
def concept_tags(spark, d):
    """Spans of concepts in documents; none of these overlap, so every start is kept."""
    concepts = spark.range(1).select(F.explode(F.array(F.lit("in"), F.lit("of the"), F.lit("in the"))).alias("concept"))
    docs = X.table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("tokens"))
    return extract.tag_concepts(docs, concepts)


@query("SELECT event_type, count(*) AS size FROM events GROUP BY event_type")
def group_sizes(spark, d):
    return X.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("size"))


@query(
    f"""WITH {X.TAXONOMY}, a AS (SELECT * FROM tax_e WHERE src NOT LIKE 'n:%' OR hash(dst) IS NOT NULL AND dst LIKE '%1'), ids AS (SELECT src AS id FROM a UNION SELECT dst FROM a)
    SELECT round((SELECT count(*) FROM ids)::DOUBLE / (SELECT count(*) FROM tax_v), 6) AS node_coverage, round((SELECT count(*) FROM a)::DOUBLE / (SELECT count(*) FROM tax_e), 6) AS edge_coverage"""
)
def graph_coverage(spark, d):
    g = X.taxonomy(spark, d)
    return structure.coverage(Graph.of(g.edges.filter("src not like 'n:%' or dst like '%1'")), g).select(_six("node_coverage"), _six("edge_coverage"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-01-01' AND o_totalprice >= 1000")
def date_range(spark, d):
    """The inclusive date range and the threshold reach the scan."""
    o = X.table(spark, d, "orders")
    return o.filter(F.col("o_orderdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp")) & (F.col("o_totalprice") >= 1000)).select("o_orderkey", "o_totalprice")
