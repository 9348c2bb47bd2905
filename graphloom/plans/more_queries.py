"""Further registered queries: sources and sinks read back, text functions and analyses, with equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom import schemas
from graphloom.functions import hearst
from graphloom.functions import text as T
from graphloom.operators import analysis, extract, structure, tables, traverse
from graphloom.plans import fixtures as X
from graphloom.plans.queries import _COSINE, _six, _vectors, query
from graphloom.runtime import shared_folder
from graphloom.sources import files, papers
from graphloom.streaming import incremental


def _place(spark, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_folder(spark)}/graphloom-tables/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


# sources and sinks ---------------------------------------------------------------


@query(f"WITH {X.TAXONOMY} SELECT src, dst, 1.0::DOUBLE AS weight FROM tax_e")
def graph_tables(spark, d):
    """A graph written as tables and read again."""
    path = _place(spark, "graph")
    files.write_graph(X.taxonomy(spark, d), path)
    return files.read_tables(spark, path).edges


@query(f"WITH {X.TAXONOMY} SELECT src, dst, 1.0::DOUBLE AS weight FROM tax_e WHERE src NOT LIKE 'n:%'")
def graph_document(spark, d):
    """A graph written as one node-link document and read again, cut to depth 2."""
    path = _place(spark, "document") + ".json"
    files.graph_json(X.taxonomy(spark, d)).write.text(path)
    return files.read_graph(spark, path, 2).edges


@query(f"WITH {X.TAXONOMY}, e AS (SELECT src, dst, CASE WHEN src = 'root' THEN 1 WHEN src LIKE 'r:%' THEN 2 ELSE 3 END AS d FROM tax_e) SELECT max_depth, count(*) AS n FROM e JOIN (SELECT unnest([1, 2, 3])::INT AS max_depth) ON d <= max_depth GROUP BY max_depth")
def graph_depths(spark, d):
    """One edge table for three depths, read by partition."""
    path = _place(spark, "depths")
    files.write_depths(X.taxonomy(spark, d), path)
    return spark.read.parquet(path).groupBy(F.col("max_depth").cast("int").alias("max_depth")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey::VARCHAR AS id, s_name AS title, s_name || ' of ' || s_nationkey AS abstract FROM supplier")
def json_lines(spark, d):
    """Records appended to JSON lines in two goes and read with the declared schema."""
    rows = X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.concat("s_name", F.lit(" of "), F.col("s_nationkey").cast("string")).alias("abstract"), F.lit("x").alias("hierarchy"), "s_suppkey")
    path = _place(spark, "lines")
    for part in (0, 1):
        files.append_lines(rows.filter(F.col("s_suppkey") % 2 == part).drop("s_suppkey"), path)
    return files.read_lines(spark, schemas.PATH_OUTPUTS, path).select("id", "title", "abstract")


@query("SELECT DISTINCT p_name AS child, p_brand AS parent, 'such as 1' AS rule FROM part WHERE p_partkey % 3 <> 0")
def tagged_files(spark, d):
    """Relation lines in text files among lines that are none."""
    line = F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat_ws("|||", F.concat(F.lit(" "), "p_name"), F.concat("p_brand", F.lit(" ")), F.lit("such as 1")))
    path = _place(spark, "tagged")
    X.table(spark, d, "part").select(line.alias("value")).write.text(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    system = hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in system.listStatus(hadoop.Path(path)):
        if (name := status.getPath().toString()).endswith(".txt"):
            system.rename(status.getPath(), hadoop.Path(f"{name}.conll"))
    return files.read_tagged(spark, path).distinct()


@query("SELECT p_type AS concept, count(*) AS n FROM part GROUP BY p_type")
def concept_map(spark, d):
    """Concept counts as one JSON object, read again."""
    path = _place(spark, "concepts")
    files.concepts_json(X.table(spark, d, "part").groupBy(F.col("p_type").alias("concept")).agg(F.count("*").alias("n"))).write.text(path)
    return files.read_concepts(spark, path)


@query("SELECT p_name AS hypo, p_brand AS hyper, p_size / 64.0::DOUBLE AS sim FROM part WHERE p_partkey % 4 <> 0")
def scored_pairs(spark, d):
    """Scored pairs in a tab-separated file, without those flagged as unknown."""
    path = _place(spark, "pairs")
    flag = F.when(F.col("p_partkey") % 4 == 0, F.when(F.col("p_partkey") % 8 == 0, "True").otherwise("1")).otherwise("False")
    X.table(spark, d, "part").select(F.col("p_name").alias("hypo"), F.col("p_brand").alias("hyper"), (F.col("p_size") / 64.0).alias("sim"), flag.alias("is_oov")).write.csv(path, sep="\t", header=True)
    return files.read_scored_pairs(spark, path)


def _papers(spark, d):
    """Parts as papers: categories by type, a first version's date by size."""
    p = X.table(spark, d, "part")
    created = F.date_format(F.to_timestamp(F.lit("2020-01-01 00:00:00")) + F.make_dt_interval(F.col("p_size")), "EEE, d MMM yyyy HH:mm:ss 'GMT'")
    versions = F.array(F.struct(F.lit("v2").alias("version"), F.lit("Mon, 1 Jan 2001 00:00:00 GMT").alias("created")), F.struct(F.lit("v1").alias("version"), created.alias("created")))
    categories = F.concat(F.element_at(F.array(*[F.lit(c) for c in ("cs.IT", "math-ph", "cs.AI")]), (F.col("p_partkey") % 3).cast("int") + 1), F.lit(" x.Unknown"))
    return p.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("  "), "p_name", F.lit("\n  by\n")).alias("title"), F.col("p_type").alias("abstract"), categories.alias("categories"), versions.alias("versions"))


@query("SELECT p_partkey::VARCHAR AS id, p_name || ' by' AS title, strftime(TIMESTAMP '2020-01-01' + to_days(p_size), '%Y-%m-%d') AS date FROM part WHERE p_size BETWEEN 9 AND 31")
def paper_snapshot(spark, d):
    """A snapshot file read between two dates, titles on one line."""
    path = _place(spark, "snapshot")
    _papers(spark, d).write.json(path)
    return papers.load_papers(spark, path, "2020-01-10", "2020-02-01").select("id", "title", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("SELECT p_partkey::VARCHAR AS id, p_size AS citation_count FROM part WHERE p_partkey % 5 <> 0 AND p_size >= 10")
def cited_papers(spark, d):
    """Papers with a known citation count of ten or more."""
    counts = X.table(spark, d, "part").filter(F.col("p_partkey") % 5 != 0).select(F.col("p_partkey").cast("string").alias("id"), F.col("p_size").alias("citation_count"))
    return papers.with_citations(papers.papers_of(_papers(spark, d)), counts, 10).select("id", "citation_count")


@query(
    """WITH c AS (SELECT p_partkey::VARCHAR AS page_id, ['math.IT', 'math.MP', 'cs.AI'][(p_partkey % 3)::INT + 1] AS node_id FROM part)
    SELECT page_id, node_id, true AS known FROM c WHERE node_id <> 'cs.AI' UNION ALL SELECT 'n=' || count(*), node_id, false FROM c WHERE node_id = 'cs.AI' GROUP BY node_id UNION ALL SELECT 'n=' || count(*), 'x.Unknown', false FROM part"""
)
def paper_categories(spark, d):
    """Papers by the categories of a taxonomy under their ids in use, and the unknown ones with how often."""
    rows = lambda *r: spark.createDataFrame(r, "id string, name string, up string, is_test boolean")
    g = papers.taxonomy(
        spark,
        rows(("grp_math", "Maths", None, False), ("test", "T", None, True)).drop("up"),
        rows(("math", "Maths", "grp_math", False)).withColumnRenamed("up", "in_group"),
        rows(("cs.IT", "Information", "math", None), ("math-ph", "Physics", "math", None)).drop("is_test").withColumnRenamed("up", "in_archive"),
    )
    known, unknown = papers.paper_graph(papers.papers_of(_papers(spark, d)), g)
    return known.select("page_id", "node_id", F.lit(True).alias("known")).unionByName(unknown.select(F.concat(F.lit("n="), F.col("n").cast("string")).alias("page_id"), "node_id", F.lit(False).alias("known")))


@query(
    """SELECT 'r' || n_regionkey AS src, n_nationkey::VARCHAR AS dst FROM nation WHERE n_nationkey % 4 <> 0"""
)
def crawled_categories(spark, d):
    """Subcategory edges of crawled records whose ends are both known, titles without their prefix."""
    n = X.table(spark, d, "nation")
    own = n.filter(F.col("n_nationkey") % 4 != 0).select(F.col("n_nationkey").cast("bigint").alias("id"), F.concat(F.lit("Category:"), F.col("n_nationkey").cast("string")).alias("title"), F.array().cast("array<bigint>").alias("pages"), F.array().cast("array<struct<id:bigint,title:string>>").alias("sub_categories"))
    up = n.groupBy((F.col("n_regionkey") + 1000).cast("bigint").alias("id"), F.concat(F.lit("Category:r"), F.col("n_regionkey").cast("string")).alias("title")).agg(F.collect_list(F.struct(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("title"))).alias("sub_categories"))
    records = own.unionByName(up.withColumn("pages", F.array().cast("array<bigint>")))
    g, _, _ = papers.category_graph(records, spark.createDataFrame([], schemas.PAGES), "1000")
    return g.titled_edges().select("src", "dst")


# texts ---------------------------------------------------------------------------


@query("SELECT doc_id, length(regexp_replace(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> ''), ' '), '\\s', '', 'g')) AS n_points, length(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r]+|[ \\t\\r]+$', '', 'g')), lambda x: x <> ''), ' ')) AS n_chars FROM documents")
def one_line(spark, d):
    """Whole texts on one line."""
    line = T.one_line(F.col("text"))
    return X.table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(line, r"\s", "")).cast("bigint").alias("n_points"), F.length(line).cast("bigint").alias("n_chars"))


@query(f"WITH {X.PATH_ROWS} SELECT node, count(*) AS n FROM (SELECT unnest(['{T.ROOT}', '{T.ROOT}', r_name, r_name, n_name, n_name, s_name, s_name]) AS node FROM path_rows) GROUP BY node")
def node_occurrences(spark, d):
    texts = X.path_texts(spark, d).select(F.substring_index("hierarchy", "\n", 3).alias("text"))
    return analysis.node_occurrences(texts, "text")


@query(
    """WITH l AS (SELECT len(string_split('a->b' || repeat('->x', (s_suppkey % 9)::INT), '->')) AS n FROM supplier)
    SELECT quantile_cont(n, 0.5)::DOUBLE AS median, (quantile_cont(n, 0.75) - quantile_cont(n, 0.25))::DOUBLE AS iqr FROM l"""
)
def response_lengths(spark, d):
    response = F.concat(F.lit("a->b"), F.repeat(F.lit("->x"), (F.col("s_suppkey") % 9).cast("int")))
    return analysis.spread(X.table(spark, d, "supplier"), T.response_length(response))


@query(
    """WITH w AS (SELECT p_partkey AS id, string_split(p_type, ' ') AS w FROM part) SELECT id, CASE WHEN len(w) >= 2 THEN len(w) - 2 END::INT AS "at", NOT list_contains(list_transform(w, lambda x: lower(x)), 'small') AS plain FROM w"""
)
def sublists(spark, d):
    """Where the last two words of a type begin, and whether none of its words is a stop word."""
    words = F.split("p_type", " ")
    part = F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2)
    at = F.when(F.size(words) >= 2, T.find_sublist(words, part))
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("id"), at.cast("int").alias("at"), (~T.has_stop_word(F.col("p_type"), ("small",))).alias("plain"))


@query("SELECT s_suppkey AS id, s_suppkey::INT AS run, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE 'x:' || s_name END AS title FROM supplier")
def run_names(spark, d):
    """Numbers at the end of run names; titles without a prefix that some have."""
    name = F.concat(F.lit("sunny-field-"), F.col("s_suppkey").cast("string"))
    title = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Category:"), "s_name")).otherwise(F.concat(F.lit("x:"), "s_name"))
    return X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), T.run_number(name).alias("run"), T.without_prefix(title).alias("title"))


@query(
    """SELECT p_brand AS src, p_name AS dst, count(*)::DOUBLE AS weight, (SELECT count(*) FROM part WHERE p_partkey % 5 = 0) AS malformed FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 2 = 0 GROUP BY ALL"""
)
def triplet_records(spark, d):
    """Edges of whole triplets with a relation that counts; how many lack a part."""
    triplet = F.struct(F.col("p_name").alias("head"), F.when(F.col("p_partkey") % 2 == 0, "part of").otherwise("country").alias("type"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_brand")).alias("tail"))
    rows = X.table(spark, d, "part").select(F.array(triplet).alias("triplets"))
    bad = rows.agg(F.sum(T.malformed_triplets(F.col("triplets"))).cast("bigint").alias("malformed"))
    return extract.edges_per_document(rows, T.triplet_edges(F.col("triplets"))).join(F.broadcast(bad))  # one row


@query("SELECT concept, n FROM (SELECT p_type AS concept, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY p_type ORDER BY n DESC, first LIMIT 20)")
def most_common(spark, d):
    """The most frequent concepts, ties by first occurrence."""
    rows = X.table(spark, d, "part").select("p_partkey", F.concat(F.lit('"'), "p_type", F.lit('"')).alias("concepts")).repartitionByRange(3, "p_partkey").sortWithinPartitions("p_partkey")
    return extract.most_common(extract.concept_counts(rows), 20)


def _tagged(spark, d):
    """A sentence for each nation: 'Some rich regions such as NATION , OTHER and Oslo .' in tokens."""
    t = lambda w, m, g: F.struct(w.alias("word"), m.alias("lemma"), F.lit(g).alias("tag"))
    lit = lambda w, g: t(F.lit(w), F.lit(w), g)
    n = X.table(spark, d, "nation")
    region = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    tokens = F.array(lit("rich", "JJ"), t(region, F.lower(region), "NNS"), lit("such", "JJ"), lit("as", "IN"), t(F.col("n_name"), F.lower("n_name"), "NNP"), lit(",", ","), t(F.concat(F.lit("X"), region), F.lower(region), "NN"), lit("of", "IN"), lit("Asia", "NNP"), lit("and", "CC"), lit("Oslo", "NNP"), lit(".", "."))
    other = F.array(lit("The", "DT"), t(F.col("n_name"), F.lower("n_name"), "NNP"), t(F.lit("is"), F.lit("be"), "VBZ"), lit("a", "DT"), lit("old", "JJ"), t(region, F.lower(region), "NN"), lit(".", "."))
    return n.select(F.explode(F.array(tokens, other)).alias("tokens"))


@query(
    """WITH n AS (SELECT n_name, 'R' || n_regionkey AS r FROM nation), p AS (
      SELECT 'rich ' || r AS src, 'Oslo' AS dst, 'such as &' AS rule FROM n UNION ALL SELECT 'rich ' || r, 'X' || r || ' of Asia', 'such as 1' FROM n UNION ALL SELECT r, n_name, 'is a [!part]' FROM n)
    SELECT src, dst, rule, count(*)::DOUBLE AS weight FROM p GROUP BY ALL"""
)
def tagged_patterns(spark, d):
    """Pattern families over tagged tokens."""
    rows = _tagged(spark, d).select(F.inline(hearst.tagged_pairs(F.col("tokens"))))
    return rows.groupBy("src", "dst", "rule").agg(F.count("*").cast("double").alias("weight"))


@query(
    """SELECT s_suppkey AS id, 0 AS depth, 'r' AS src, 'n' || s_nationkey AS dst FROM supplier WHERE s_suppkey % 6 <> 0
    UNION ALL SELECT s_suppkey, 1, 'n' || s_nationkey, s_name FROM supplier WHERE s_suppkey % 6 <> 0 UNION ALL SELECT s_suppkey, -1, 'bad', NULL FROM supplier WHERE s_suppkey % 6 = 0"""
)
def nested_objects(spark, d):
    """Edges of nested objects, and the texts that are none."""
    good = F.concat(F.lit('{"r": {"n'), F.col("s_nationkey").cast("string"), F.lit('": {"'), "s_name", F.lit('": {}}}}'))
    text = F.when(F.col("s_suppkey") % 12 == 0, F.lit("no json {")).when(F.col("s_suppkey") % 6 == 0, F.lit("[1]")).otherwise(good)
    edges, bad = analysis.nested_edges(X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("text")), "text")
    return edges.unionByName(bad.select("id", F.lit(-1).alias("depth"), F.lit("bad").alias("src"), F.lit(None).cast("string").alias("dst")))


@query("SELECT s_suppkey::VARCHAR AS id, 'Title: ' || s_name AS prompt, upper('Title: ' || s_name) AS response FROM supplier")
def generated_texts(spark, d):
    """Answers of a generator (here capitals) in two runs, the second of which goes on after the first."""
    path, rows = _place(spark, "answers"), X.table(spark, d, "supplier")
    prompt = F.concat(F.lit("Title: "), "s_name")
    answer = lambda prompts: [p.upper() for p in prompts]
    analysis.generated(rows.filter(F.col("s_suppkey") % 3 == 0), answer, prompt, path, "s_suppkey")
    return analysis.generated(rows, answer, prompt, path, "s_suppkey", 7)


# graphs --------------------------------------------------------------------------


@query(f"WITH {X.SUPPLY_EDGES} SELECT * FROM supply_edges WHERE weight >= 2 AND src NOT IN ('s:1', 's:2') AND dst NOT IN ('s:1', 's:2')")
def frequent_edges(spark, d):
    return analysis.frequent_edges(X.supply_edges(spark, d), 2, ("s:1", "s:2"))


@query(
    f"""WITH {X.TAXONOMY}, {X.DEPTHS}, e AS (SELECT src, dst, 1.0 / (SELECT count(*) FROM tax_e) AS share FROM tax_e)
    SELECT depth::INT AS level, src LIKE 'r:%' AND dst LIKE '%1' AS in_domain, count(*) AS n, round(avg(share), 9)::DOUBLE AS mean FROM e JOIN tax_d ON src = id GROUP BY 1, 2"""
)
def level_weights(spark, d):
    g = X.taxonomy(spark, d)
    inside = g.edges.filter("src like 'r:%' and dst like '%1'")
    return analysis.level_weights(g.edges, traverse.depths(g), inside).select("level", "in_domain", "n", F.round("mean", 9).alias("mean"))


@query(
    f"""WITH {X.SUPPLY_EDGES}, ids AS (SELECT src AS id FROM supply_edges UNION SELECT dst FROM supply_edges), k AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':0'), id) AS k, count(*) OVER () AS n FROM ids),
    c AS (SELECT id FROM k WHERE k <= floor(0.02 * n)), gone AS (SELECT id FROM c UNION SELECT dst FROM supply_edges WHERE src IN (SELECT id FROM c) UNION SELECT src FROM supply_edges WHERE dst IN (SELECT id FROM c))
    SELECT src, dst, weight FROM supply_edges WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)"""
)
def without_neighbourhoods(spark, d):
    return analysis.without_neighbourhoods(X.supply_edges(spark, d), 0.02)


@query(f"WITH {X.SUPPLY_EDGES}, k AS (SELECT *, row_number() OVER (ORDER BY md5(src || ':' || dst || ':3'), src, dst) AS k, count(*) OVER () AS n FROM supply_edges) SELECT src, dst, weight FROM k WHERE k > floor(0.2 * n)")
def without_edges(spark, d):
    """A fifth of the edges taken away by hash order."""
    return tables.without_share(X.supply_edges(spark, d), 0.2, "src", "dst", seed=3)


@query(
    f"""WITH {X.TAXONOMY}, t AS (SELECT DISTINCT title FROM tax_v), e AS (SELECT DISTINCT a.title AS src, b.title AS dst FROM tax_e JOIN tax_v a ON src = a.id JOIN tax_v b ON dst = b.id),
    f AS (SELECT a.title AS src, b.title AS dst FROM t a JOIN t b ON true WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.title AND e.dst = b.title) ORDER BY md5(a.title || ':' || b.title || ':0'), 1, 2 LIMIT 100),
    p AS (SELECT src, dst, row_number() OVER (ORDER BY md5(src || ':' || dst || ':0'), src, dst) AS k FROM e), g AS (SELECT src, dst, row_number() OVER (ORDER BY md5(src || ':' || dst || ':0'), src, dst) AS k FROM f)
    SELECT src, dst, 1 AS label FROM p WHERE k <= 16 UNION ALL SELECT src, dst, 0 FROM g WHERE k <= 16"""
)
def balanced_batch(spark, d):
    g = X.taxonomy(spark, d)
    return tables.balanced_batch(g.titled_edges(), tables.negative_pairs(g.vertices, g.titled_edges(), 100), 32)


@query(
    """WITH x AS (SELECT 1 + count(*) AS a FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey), f AS (
      SELECT 1.0 + (SELECT count(*) FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey) + (SELECT count(*) FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey) AS fork, 1.0 + (SELECT count(*) FROM nation) AS chain, 1.0 + (SELECT count(*) FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey) AS fork1),
    p AS (SELECT fork / (fork + chain) AS p1, chain / (fork + chain) AS p2, fork1 / (fork1 + 1.0) AS q1, 1.0 / (fork1 + 1.0) AS q2 FROM f) SELECT round(p1 * ln(p1 / q1) + p2 * ln(p2 / q2), 6)::DOUBLE AS divergence FROM p"""
)
def motif_divergence(spark, d):
    """Motifs of the taxonomy's two upper levels against those of the first."""
    g = X.taxonomy(spark, d)
    census = lambda depth: structure.motif_census(traverse.depth_cut(g, depth).edges)
    return structure.motif_divergence(census(2), census(1)).select(_six("divergence"))


# embeddings ----------------------------------------------------------------------


@query(
    f"WITH {_COSINE} SELECT la AS label, count(*) AS n, round(quantile_cont(score, 0.25), 6) AS low, round(quantile_cont(score, 0.5), 6) AS median FROM sims WHERE la = lb AND a < b GROUP BY la"
)
def synonym_similarities(spark, d):
    """Similarities within each label."""
    out = analysis.similarity_quantiles(_vectors(spark, d), (0.25, 0.5))
    return out.select(F.col("group").alias("label"), "n", F.round(F.get("quantiles", F.lit(0)), 6).alias("low"), F.round(F.get("quantiles", F.lit(1)), 6).alias("median"))


@query(
    f"""WITH {_COSINE}, n AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM u), c AS (SELECT a.id AS src, b.id AS dst, a.k FROM n a JOIN n b ON b.k = a.k + 1),
    m AS (SELECT p.src, p.dst, t.src AS ts, t.dst AS td, x.score * y.score AS score FROM c p JOIN sims x ON x.a = p.src AND x.score >= 0.2 JOIN c t ON t.src = x.b AND t.k % 3 = 0 JOIN sims y ON y.a = p.dst AND y.b = t.dst AND y.score >= 0.2 WHERE p.k % 2 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY score DESC, ts::VARCHAR, td::VARCHAR) AS place FROM m)
    SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, ts::VARCHAR AS near_src, td::VARCHAR AS near_dst, round(score, 6) AS score, place::INT AS place FROM r WHERE place <= 6"""
)
def nearest_edges(spark, d):
    """For each edge the six nearest of another graph, by the product of both ends' similarities."""
    from graphloom.plans.queries import _vector_graphs

    pred, true, embeds = _vector_graphs(spark, d)
    return analysis.nearest_edges_above(pred.edges, true.edges, embeds, 0.2).select("src", "dst", "near_src", "near_dst", _six("score"), "place")


@query()
def ward_clusters(spark, d):
    """Ten clusters of the vectors, against a brute-force version in the tests."""
    return analysis.ward_clusters(_vectors(spark, d), 10)


# streams -------------------------------------------------------------------------


@query("SELECT s_suppkey::VARCHAR AS id, upper(s_name) AS name FROM supplier")
def resumed_stream(spark, d):
    """New files of a folder, each id once, in two runs of which the second goes on after the first."""
    folder, out, checkpoint = (_place(spark, x) for x in ("inbox", "outbox", "marks"))
    rows = X.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), "s_suppkey")
    for part in (0, 1):
        rows.filter(F.col("s_suppkey") % 2 <= part).drop("s_suppkey").write.mode("append").json(folder)
        incremental.resume(incremental.new_rows(spark, "id string, name string", folder), lambda f: f.select("id", F.upper("name").alias("name")), out, checkpoint)
    return spark.read.schema("id string, name string").json(out).select("id", "name")


@query(
    """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents), x AS (SELECT doc_id, unnest(w) AS a, unnest(list_append(w[2:], NULL)) AS b, unnest(list_prepend(NULL, w[:-2])) AS z FROM t)
    SELECT doc_id, count_if(a = 'in' OR (a = 'of' AND coalesce(b = 'the', false)))::BIGINT AS n_b, count_if(a = 'the' AND coalesce(z = 'of', false))::BIGINT AS n_i, count(*) AS n FROM x GROUP BY doc_id"""
)
def concept_bio_tags(spark, d):
    """Begin, inside and outside tags of the concepts in each document, counted."""
    concepts = spark.range(1).select(F.explode(F.array(F.lit("in"), F.lit("of the"))).alias("concept"))
    docs = X.table(spark, d, "documents").select("doc_id", F.split("text", " ", -1).alias("tokens"))
    tags = extract.bio_tags(docs, extract.tag_concepts(docs, concepts))
    count = lambda t: F.size(F.filter("tags", lambda x: x == t)).cast("bigint")
    return tags.select("doc_id", count("B").alias("n_b"), count("I").alias("n_i"), F.size("tags").cast("bigint").alias("n"))
