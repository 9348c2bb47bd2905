"""Queries over whole tables: concepts of any length, drawn pairs, the pair classifier and searches over vectors, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import hearst
from graphloom.functions import text as T
from graphloom.graph import Graph
from graphloom.operators import association, centrality, concepts, metrics, pairs, sampling, structure, traverse, vectors
from graphloom.plans import fixtures as X
from graphloom.plans.queries import _CENSUS, _cells, _COSINE, _six, _vectors, query
from graphloom.runtime import materialise, spread

# concepts ------------------------------------------------------------------------

#: Every 37th place of a text begins a concept of 2 to 10 words.
EVERY, SHORTEST, LENGTHS = 37, 2, 9

_GRAMS = f"""words AS (SELECT doc_id, unnest(range(len(w))) AS "at", unnest(w) AS word FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)),
    wins AS (SELECT doc_id, "at", list(word) OVER (PARTITION BY doc_id ORDER BY "at" ROWS BETWEEN CURRENT ROW AND {SHORTEST + LENGTHS - 2} FOLLOWING) AS win FROM words),
    known AS (SELECT DISTINCT array_to_string(win[1:{SHORTEST} + (doc_id + "at") % {LENGTHS}], ' ') AS concept FROM wins WHERE "at" % {EVERY} = 0 AND len(win) >= {SHORTEST} + (doc_id + "at") % {LENGTHS}),
    grams AS (SELECT doc_id, "at", n AS length, array_to_string(win[1:n], ' ') AS concept FROM wins, (SELECT unnest(range({SHORTEST}, {SHORTEST + LENGTHS})) AS n) WHERE n <= len(win)),
    spans AS (SELECT doc_id, "at"::INT AS "at", min(length)::INT AS length, arg_min(concept, length) AS concept FROM grams JOIN known USING (concept) GROUP BY doc_id, "at")"""


def _lemmas(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.split(F.lower("text"), " ", -1).alias("lemmas"))


def _known(docs):
    """Concepts from the texts themselves."""
    n = F.lit(SHORTEST) + F.pmod(F.col("doc_id") + F.col("at"), F.lit(LENGTHS))
    starts = docs.filter("size(lemmas) > 0").select("doc_id", "lemmas", F.explode(F.sequence(F.lit(0), F.size("lemmas") - 1, F.lit(EVERY))).alias("at"))
    return starts.filter(F.col("at") + n <= F.size("lemmas")).select(F.array_join(F.slice("lemmas", F.col("at") + 1, n.cast("int")), " ").alias("concept")).distinct()


@query(f"WITH {_GRAMS} SELECT * FROM spans")
def concept_spans(spark, d):
    """The shortest concept at each place of each text; concepts have up to ten words, and there are as many as the texts give."""
    docs = _lemmas(spark, d)
    return concepts.concept_spans(docs, _known(docs), tokens="lemmas")


@query(f"WITH {_GRAMS} SELECT * FROM spans")
def concept_spans_dealt(spark, d):
    """The same beyond the bound of what is broadcast: a filter of the concepts' prefixes, then a join."""
    docs = _lemmas(spark, d)
    return concepts.concept_spans(docs, _known(docs), tokens="lemmas", most_tokens=0)


@query(
    f"""WITH RECURSIVE {_GRAMS}, row_spans AS (SELECT doc_id, "at", length, row_number() OVER (PARTITION BY doc_id ORDER BY "at") AS k FROM spans),
    kept AS (SELECT doc_id, k, "at", length FROM row_spans WHERE k = 1 UNION ALL SELECT s.doc_id, s.k, s."at", s.length FROM kept c, LATERAL (SELECT * FROM row_spans r WHERE r.doc_id = c.doc_id AND r.k > c.k AND r."at" >= c."at" + c.length ORDER BY r.k LIMIT 1) s)
    SELECT doc_id, count(*) AS spans, sum(length)::BIGINT AS words FROM kept GROUP BY doc_id"""
)
def concepts_in_turn(spark, d):
    """Spans that overlap no earlier one, by document."""
    docs = _lemmas(spark, d)
    spans = concepts.concept_spans(docs, _known(docs), tokens="lemmas", overlaps="first")
    return spans.groupBy("doc_id").agg(F.count("*").alias("spans"), F.sum("length").alias("words"))


# pairs that are no edge, and a classifier of pairs ---------------------------------

_DEALT = "(('0x' || md5('{seed}:{k}:' || {x}::VARCHAR)[1:8])::BIGINT & (1::BIGINT << b) - 1)"


def _feistel(seed: int = 0) -> str:
    """The permutation of :func:`graphloom.operators.sampling.dealt` as common table expressions, from ``numbers`` (draw, b)."""
    steps = ["r0 AS (SELECT draw, b, draw >> b AS l, draw & ((1::BIGINT << b) - 1) AS r FROM numbers)"]
    steps += [f"r{k + 1} AS (SELECT draw, b, r AS l, xor(l, {_DEALT.format(seed=seed, k=k, x='r')}) AS r FROM r{k})" for k in range(sampling.ROUNDS)]
    return ", ".join(steps) + f", dealt AS (SELECT draw, (l << b) | r AS pair FROM r{sampling.ROUNDS})"


@query(
    f"""WITH {X.TAXONOMY}, t AS (SELECT title, row_number() OVER (ORDER BY title) - 1 AS "at" FROM (SELECT DISTINCT title FROM tax_v)), size AS (SELECT count(*) AS n, greatest(1, ceil(log2(count(*))))::INT AS b FROM t),
    e AS (SELECT DISTINCT a.title AS src, b.title AS dst FROM tax_e JOIN tax_v a ON src = a.id JOIN tax_v b ON dst = b.id),
    numbers AS (SELECT unnest(range((1::BIGINT << 2 * (SELECT b FROM size))))::BIGINT AS draw, (SELECT b FROM size) AS b), {_feistel()},
    pairs AS (SELECT a.title AS src, b.title AS dst, draw FROM dealt, size s, t a, t b WHERE pair < s.n * s.n AND a."at" = pair // s.n AND b."at" = pair % s.n)
    SELECT src, dst, draw FROM pairs WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = pairs.src AND e.dst = pairs.dst) ORDER BY draw LIMIT 10 * (SELECT count(*) FROM e)"""
)
def sampled_non_edges(spark, d):
    """Ten times as many pairs that are no edge as there are edges, in the order in which they are drawn."""
    g = X.taxonomy(spark, d)
    known = g.titled_edges()
    return sampling.non_edges(g.vertices, known, 10 * known.count())


def product_taxonomy(spark, d) -> Graph:
    """Kinds of things, things, and things of a brand; titles are their words."""
    parts = X.table(spark, d, "part").select(F.substring_index("p_name", " ", -1).alias("kind"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand").alias("branded")).distinct()
    edges = parts.select(F.col("kind").alias("src"), F.col("name").alias("dst")).unionByName(parts.select(F.col("name").alias("src"), F.col("branded").alias("dst"))).distinct()
    return Graph.of(edges.withColumn("weight", F.lit(1.0)))


def _share(seed: int):
    """A number from 0 to 9 for each pair."""
    return F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(10))


def classified(spark, d):
    """(model, held-out pairs with label and score)."""
    g = product_taxonomy(spark, d)
    known = materialise(sampling.labelled_pairs(g.vertices, g.edges).withColumn("share", _share(7)), "labelled")
    model = pairs.train(known.filter("share > 3"), known.filter("share = 3"))
    return model, known.filter("share < 3").withColumn("score", model.scorer(spark)("src", "dst"))


@query()
def pair_classifier(spark, d):
    """Scores on held-out edges and non-edges; tests/test_pairs.py holds the gradient against numpy and the scores against the majority."""
    _, scored = classified(spark, d)
    return metrics.classification_scores(scored.select("label", (F.col("score") >= 0.5).cast("int").alias("predicted")), "label", "predicted")


# searches over vectors -----------------------------------------------------------


@query(f"WITH {_COSINE} SELECT a, b, round(score, 6) AS score FROM sims WHERE score >= 0.3")
def cosine_pairs_all(spark, d):
    """All pairs of all vectors above the threshold."""
    v = _vectors(spark, d)
    return vectors.pairs_above(v, v, 0.3).select("a", "b", _six("score"))


@query(f"WITH {_COSINE}, x AS (SELECT a, max(score) AS s FROM sims WHERE a <> b GROUP BY a) SELECT a, round(s, 6) AS score FROM x")
def best_matches_all(spark, d):
    """The best cosine that each vector has to another."""
    v = _vectors(spark, d)
    return vectors.nearest(v, v, 1).select("a", _six("score"))


_WIDE = """w AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE * (1 + vec_id % 7)) AS e FROM embeddings),
    p AS (SELECT a.id AS a, b.id AS b, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])) AS score FROM w a JOIN w b ON true)"""


@query(f"WITH {_WIDE} SELECT a, b, round(score, 5) AS score FROM p ORDER BY p.score DESC, a, b LIMIT 5000")
def top_products(spark, d):
    """The 5000 pairs of vectors of seven lengths with the greatest products."""
    v = _vectors(spark, d).withColumn("embed", F.transform("embedding", lambda x: x.cast("double") * (1 + F.col("id") % 7)))
    return vectors.top_products(v, v, 5000).select("a", "b", F.round("score", 5).alias("score"))


@query()
def svd_scores_dealt(spark, d):
    """Scores by factors that are tables, as beyond the driver's bound; tests/test_factors.py holds them against numpy."""
    cells = _cells(spark, d)
    return association.svd_scores(association.ppmi(cells), cells.select("row", "col"), 5, most_nodes=0).select("row", "col", _six("score"))


# motifs --------------------------------------------------------------------------


@query(f"WITH {X.TRADE_EDGES}, {_CENSUS.format(e='trade_edges')} SELECT motif::INT AS motif, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM motifs GROUP BY motif")
def motif_census_all(spark, d):
    """Connected triples of all trade edges."""
    return structure.motif_census(X.trade_edges(spark, d)).select("motif", "n", _six("share"))


@query(
    f"""WITH RECURSIVE {X.TRADE_EDGES}, q(path) AS (SELECT ['NATION_0'] UNION ALL SELECT list_append(path, dst) FROM q JOIN trade_edges ON path[-1] = src WHERE NOT list_contains(path, dst) AND len(path) <= 3 AND path[-1] <> 'NATION_7')
    SELECT array_to_string(path, '>') AS path FROM (SELECT path FROM q WHERE path[-1] = 'NATION_7' ORDER BY len(path), path LIMIT 100)"""
)
def k_shortest_paths_all(spark, d):
    """The hundred shortest ways between two nations over all trade edges."""
    return traverse.k_shortest_paths(X.trade_edges(spark, d), "NATION_0", "NATION_7", 100, 24).select(F.array_join("path", ">").alias("path"))


@query(
    f"""WITH {X.SUPPLY_EDGES}, s AS (SELECT count(*) AS k FROM supply_edges GROUP BY src), p AS (SELECT count(*) AS k FROM supply_edges GROUP BY dst)
    SELECT * FROM (SELECT {structure.triad_class(0b000101)} AS motif, sum(k * (k - 1) // 2)::BIGINT AS n FROM s UNION ALL SELECT {structure.triad_class(0b001010)}, sum(k * (k - 1) // 2)::BIGINT FROM p) WHERE n > 0"""
)
def supply_census(spark, d):
    """Triples of the supply graph, whose suppliers are hubs: none is listed, as there are no triangles."""
    return structure.motif_census(X.supply_edges(spark, d)).select("motif", "n")


# centrality ----------------------------------------------------------------------


def _levels(depth: int) -> str:
    """Common table expressions for the shares of shortest paths of up to ``depth`` links from ``sources`` (id) over ``links`` (x, y), level by level."""
    parts = ["f0 AS (SELECT id AS s, id, 1.0::DOUBLE AS ways FROM sources)"]
    for k in range(1, depth + 1):
        seen = "".join(f" AND (s, y) NOT IN (SELECT (s, id) FROM f{j})" for j in range(max(k - 2, 0), k))
        parts.append(f"f{k} AS MATERIALIZED (SELECT s, y AS id, sum(ways)::DOUBLE AS ways FROM f{k - 1} JOIN links ON x = id WHERE true{seen} GROUP BY s, y)")
    parts.append(f"b{depth} AS (SELECT s, id, ways, 0.0::DOUBLE AS owed FROM f{depth})")
    for k in range(depth - 1, 0, -1):
        back = f"SELECT s, y AS id, sum((1 + owed) / ways) AS x FROM b{k + 1} JOIN links ON x = id GROUP BY s, y"
        parts.append(f"b{k} AS MATERIALIZED (SELECT f.s, f.id, f.ways, coalesce(t.x, 0) * f.ways AS owed FROM f{k} f LEFT JOIN ({back}) t ON t.s = f.s AND t.id = f.id)")
    return ", ".join(parts)


_MOST_LINKS = 10


@query(
    f"""WITH {X.TAXONOMY}, {X.SUPPLY_EDGES}, e AS (SELECT src AS x, dst AS y FROM tax_e UNION SELECT src, dst FROM supply_edges), links AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
    sources AS (SELECT id FROM tax_v WHERE id NOT LIKE 's:%'), {_levels(_MOST_LINKS)}
    SELECT id, round(sum(owed), 6)::DOUBLE AS owed FROM ({" UNION ALL ".join(f"SELECT id, owed FROM b{k}" for k in range(1, _MOST_LINKS + 1))}) GROUP BY id"""
)
def path_shares(spark, d):
    """Shares of the shortest paths from the root, regions and nations through each vertex down to all parts, on five levels.

    Nations meet over the root after four links and parts lie two below any of them, so no path has more than ten.
    """
    tree = X.taxonomy(spark, d)
    edges = tree.edges.select("src", "dst").unionByName(X.supply_edges(spark, d).select("src", "dst"))
    return centrality.path_shares(edges, tree.vertices.filter("id NOT LIKE 's:%'")).select("id", _six("owed"))


# patterns ------------------------------------------------------------------------

_THINGS = ("tools", "rings", "bolts", "gears", "wires", "pumps", "belts")
_OTHER = {",": ",", "which": "WDT", "is": "VBZ", "was": "VBD", "a": "DT", "an": "DT", "the": "DT", "any": "DT", "good": "JJ", "old": "JJ", "rare": "JJ", "cheap": "JJ", "special": "JJ", "such": "JJ", "other": "JJ", "few": "JJ", "most": "JJS", "biggest": "JJS", "bigger": "JJR"}
_OTHER |= {"of": "IN", "as": "IN", "in": "IN", "Like": "IN", "that": "IN", "and": "CC", "or": "CC", "nor": "CC", "called": "VBN", "named": "VBD", "including": "VBG", "included": "VBN"}


def _sentences() -> list[tuple[str, list[tuple[str, str, str]]]]:
    """Sentences about a supplier (S) with the (parent, child, rule) in them: each of the rules, and for each a near miss."""
    m, s = "machines", "S"
    out = [
        ("S , which is a good example of machines", [(m, s, "example of")]),
        ("S , which is good example of machines", []),
        ("S or any other machines", [(m, s, "and other 0")]),
        ("S nor any other machines", []),
        ("S , which is called machines", [(m, s, "which is called")]),
        ("S , which was named machines", []),
        ("S is biggest machines", [(m, s, "is JJS")]),
        ("S is bigger machines", []),
        ("S is a special case of the machines", [(m, s, "special case of")]),
        ("S is a rare case of the machines", []),
        ("S is an old machines that", [("old machines", s, "is an X that")]),
        ("S is an old machines which", []),
        ("the S is a cheap machines", [(m, s, "is a [!part]")]),
        ("the S is a member machines", []),
        ("in most machines such as S", [(m, s, "!features such as")]),
        ("features in machines such as S", []),
        ("most of machines such as S", []),
        ("Like most machines , the S", [(m, s, "like most")]),
        ("Like few machines , the S", []),
        ("machines , including S", [(m, s, "including 0")]),
        ("machines , included S", []),
        ("machines such as tools , rings and S", [(m, s, "such as &"), (m, "rings", "such as 1")]),
        ("machines such as tools and S", []),
        ("machines including tools , rings and S", [(m, s, "including &"), (m, "tools", "including 0"), (m, "rings", "including 1")]),
        ("machines including tools , rings or S", [(m, "tools", "including 0"), (m, "rings", "including 1")]),
    ]
    for n in range(7):  # a list of one less is the near miss of each length
        things = [*_THINGS[:n], s]
        out.append((f"machines such as {' , '.join(things)}", [(m, t, f"such as {k}") for k, t in enumerate(things) if k]))
        out.append((f"machines including {' , '.join(things)}", [(m, t, f"including {k}") for k, t in enumerate(things) if k < 6]))
        out.append((f"{' , '.join(reversed(things))} and other machines", [(m, t, f"and other {k}") for k, t in enumerate(things) if k < 6]))
    return out


def _token(word: str):
    name = F.col("s_name") if word == "S" else F.lit(word)
    lemma = {"is": "be", "was": "be"}.get(word, word)
    return F.struct(name.alias("word"), (F.lower(name) if word == "S" else F.lit(lemma)).alias("lemma"), F.lit(_OTHER.get(word, "NNS")).alias("tag"))


_RULE_ROWS = ", ".join(f"({k}, '{a}', '{b}', '{rule}')" for k, (_, found) in enumerate(_sentences()) for a, b, rule in found)


@query(f"SELECT s_suppkey, k AS sentence, a AS src, CASE WHEN b = 'S' THEN s_name ELSE b END AS dst, rule FROM supplier, (VALUES {_RULE_ROWS}) v(k, a, b, rule)")
def tagged_rules(spark, d):
    """Every rule over tagged tokens, each with near misses beside it."""
    rows = F.array(*[F.struct(F.lit(k).alias("sentence"), F.array(*map(_token, text.split())).alias("tokens")) for k, (text, _) in enumerate(_sentences())])
    sentences = spread(X.table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey").select("s_suppkey", F.inline(rows))
    return sentences.select("s_suppkey", "sentence", F.inline(hearst.tagged_pairs(F.col("tokens"))))


@query(
    """WITH t AS (SELECT p_brand, list(p_name ORDER BY p_partkey) AS names FROM part GROUP BY p_brand), r AS (SELECT unnest(['such as', 'and other']) AS rule)
    SELECT p_brand, rule, len(names) AS n, 'NP_' || p_brand AS src, 'NP_' || replace(names[1], ' ', '_') AS first, 'NP_' || replace(names[-1], ' ', '_') AS last FROM t, r"""
)
def long_lists(spark, d):
    """One sentence a brand with all its parts, before and behind the brand's name."""
    names = X.table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("parts"))
    listed = F.array_join(F.transform("parts", lambda p: T.marked_phrase(p["p_name"])), ", ")
    brand = F.concat(F.lit("NP_"), F.regexp_replace("p_brand", "#", "x"))
    text = F.concat(brand, F.lit(" such as "), listed, F.lit("; "), listed, F.lit(" and other "), brand)
    found = names.select("p_brand", F.posexplode(T.hearst_pairs(text)).alias("at", "pair"))
    ends = [F.min_by("pair.dst", "at").alias("first"), F.max_by("pair.dst", "at").alias("last")]
    return found.groupBy("p_brand", F.col("pair.rule").alias("rule")).agg(F.count("*").alias("n"), F.first(F.regexp_replace("pair.src", "x", "#")).alias("src"), *ends)
