import hashlib
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import association, metrics, prune, similarity, structure, tables, traverse
from graphloom.operators.assignment import assign, too_costly
from graphloom.plans import sweep
from graphloom.sources import papers, web


def edges(spark, *rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "src string, dst string, weight double")


def pairs(frame):
    return {(r["src"], r["dst"]) for r in frame.collect()}


def test_relative_rule(spark):
    e = edges(spark, ("a", "b", 5), ("a", "c", 3), ("a", "d", 2))
    assert pairs(prune.prune_relative(e, 0.5)) == {("a", "b")}
    assert pairs(prune.prune_relative(e, 1)) == pairs(e)
    assert pairs(prune.prune_relative(edges(spark, ("a", "b", 7)), 0.9)) == set()


def test_absolute_rule(spark):
    e = edges(spark, ("a", "b", 1), ("a", "c", 2), ("b", "c", 3), ("c", "d", 4))
    assert pairs(prune.prune_absolute(e, 0.5)) == {("b", "c"), ("c", "d")}
    assert pairs(prune.prune_absolute(e, 1)) == set()


def test_inverse_rule(spark):
    assert pairs(prune.prune_inverse(edges(spark, ("a", "b", 3), ("b", "a", 1)))) == {("a", "b")}
    assert len(pairs(prune.prune_inverse(edges(spark, ("a", "b", 2), ("b", "a", 2))))) == 2


def test_add_root(spark):
    g = prune.add_root(Graph.of(edges(spark, ("a", "b", 1), ("c", "b", 1))))
    assert g.root == "Main topic classifications"
    assert {("Main topic classifications", "a"), ("Main topic classifications", "c")} <= pairs(g.edges)
    kept = prune.add_root(Graph.of(edges(spark, ("a", "b", 1)), root="a"))
    assert kept.root == "a"


def test_clean_up(spark):
    g = Graph.of(edges(spark, ("r", "a", 1), ("a", "b", 1), ("r", "c", 1), ("x", "a", 1)), root="r")
    out = traverse.clean_up(g, spark.createDataFrame([("b",)], "id string"))
    assert {r["id"] for r in out.vertices.collect()} == {"r", "a", "b"}


def test_shortest_paths(spark):
    e = edges(spark, ("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1))
    assert [r["id"] for r in traverse.shortest_path(e, "a", "d").orderBy("at").collect()] == ["a", "c", "d"]
    assert [len(r["path"]) for r in traverse.k_shortest_paths(e, "a", "d", 2, 4).collect()] == [3, 4]
    assert traverse.shortest_path(e, "d", "a").count() == 0


def test_strong_components(spark):
    e = edges(spark, ("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "d", 1), ("d", "c", 1), ("d", "e", 1))
    v = Graph.of(e).vertices
    assert {r["id"]: r["component"] for r in structure.strong_components(v, e).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


def test_betweenness_and_spectrum(spark):
    g = Graph.of(edges(spark, ("a", "b", 1), ("b", "c", 1)))
    assert {r["id"]: r["score"] for r in structure.betweenness(g).collect()} == {"a": 0.0, "b": 1.0, "c": 0.0}
    values = sorted(r["value"] for r in structure.laplacian_spectrum(g).collect())
    assert np.allclose(values, [0, 1, 2])


@pytest.mark.parametrize(("n", "m"), [(9, 12), (14, 40), (14, 150)])
def test_census_against_all_triples(spark, n, m):
    rng = np.random.default_rng(n + m)
    held = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2))}
    want = {}
    for t in itertools.combinations(range(n), 3):
        bits = sum(1 << k for k, (x, y) in enumerate(((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))) if (t[x], t[y]) in held)
        if sum(bits >> k & 3 > 0 for k in (0, 2, 4)) >= 2:
            want[structure.triad_class(bits)] = want.get(structure.triad_class(bits), 0) + 1
    frame = edges(spark, *[(f"v{a:02d}", f"v{b:02d}", 1) for a, b in [*held, *held]])
    got = structure.motif_census(frame).collect()
    assert {r["motif"]: r["n"] for r in got} == want and np.isclose(sum(r["share"] for r in got), 1)
    assert {r["motif"]: r["n"] for r in structure.motif_triples(frame).groupBy("motif").agg(F.count("*").alias("n")).collect()} == want


def test_two_sided_graphs_pair_no_links(spark, monkeypatch):
    """20 leaves under each of 30 hubs: 600 links, no triangle, and none of 20 x 435 pairs of links is listed."""
    listed, plain = [], structure._wedges
    monkeypatch.setattr(structure, "_wedges", lambda out: listed.append(plain(out).count()) or plain(out))
    frame = edges(spark, *((f"h{i:02}", f"leaf{j:02}", 1) for i in range(30) for j in range(20)), *((f"h{i:02}", f"own{i:02}_{j}", 1) for i in range(30) for j in range(20)))
    assert sum(r["n"] for r in structure.motif_census(frame).collect()) == 20 * 435 + 30 * 780
    assert listed == [0]


def test_census_of_a_hub(spark):
    """Two hundred thousand leaves have 2e10 pairs, of which none is listed; one pair of leaves closes a triangle."""
    leaves = spark.range(200_000).select(F.lit("hub").alias("src"), F.concat(F.lit("v"), "id").alias("dst"), F.lit(1.0).alias("weight"))
    got = {r["motif"]: r["n"] for r in structure.motif_census(leaves.unionByName(edges(spark, ("v0", "v1", 1)))).collect()}
    assert got == {structure.triad_class(0b000101): 200_000 * 199_999 // 2 - 1, structure.triad_class(0b010101): 1}
    assert structure.motif_census(leaves.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_paths_against_all_orders(spark, seed):
    """Cyclic graphs with loops; the shortest simple paths, and those to some targets."""
    rng = np.random.default_rng(seed)
    n = 7
    held = {(int(a), int(b)) for a, b in rng.integers(0, n, (14 + 6 * seed, 2))}
    frame = edges(spark, *[(str(a), str(b), 1) for a, b in held])
    every = [p for size in range(1, n + 1) for p in itertools.permutations(range(n), size) if p[0] == 0 and all((a, b) in held for a, b in itertools.pairwise(p))]
    for target, k, most in ((n - 1, 1, 6), (n - 1, 6, 6), (n - 1, 1000, 5), (3, 4, 2), (0, 3, 3)):
        want = sorted((p for p in every if p[-1] == target and len(p) <= most + 1), key=lambda p: (len(p), [str(x) for x in p]))[:k]
        got = [tuple(map(int, r["path"])) for r in traverse.k_shortest_paths(frame, "0", str(target), k, most).collect()]
        assert sorted(got, key=lambda p: (len(p), p)) == want
    targets = spark.createDataFrame([("2",), ("5",), ("absent",)], "id string")
    got = sorted(tuple(map(int, r["path"])) for r in traverse.simple_paths(frame, "0", 4, targets).collect())
    assert got == sorted(p for p in every if p[-1] in (2, 5) and len(p) <= 5)


def test_the_graph_score_goes_along_edges(spark):
    """Along edges and both ways differ here, and the evaluation takes the former."""
    one = edges(spark, ("a", "b", 1), ("b", "c", 1), ("a", "d", 1))
    two = edges(spark, ("b", "a", 1), ("c", "b", 1), ("d", "c", 1))
    embeds = spark.createDataFrame([(t, [float(t == x) for x in "abcd"]) for t in "abcd"], "title string, embed array<double>")
    p, t = Graph.of(one), Graph.of(two)
    got = sweep.METRICS["graph"](p, t, embeds).first()["f1"]
    along, around = (similarity.graph_match(sweep._embedded(p, embeds), sweep._embedded(t, embeds), 2, way).first()["f1"] for way in ("forward", "undirected"))
    assert np.isclose(got, along) and not np.isclose(along, around)


def test_motif_distance_to_itself(spark):
    census = structure.motif_census(edges(spark, ("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1)))
    assert structure.motif_distance(census, census).first()["distance"] == 0
    assert structure.motif_divergence(census, census).first()["divergence"] == 0


def test_feedback_edges(spark):
    e = edges(spark, ("a", "b", 1), ("b", "a", 1), ("b", "c", 1), ("c", "a", 1), ("c", "d", 1))
    assert pairs(structure.feedback_edges(e, 3)) == {("a", "b")}


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 5), st.integers(1, 6), st.integers(0, 10_000))
def test_assignment_is_best(n, m, seed):
    w = np.random.default_rng(seed).normal(size=(n, m)).round(2)
    rows, columns = assign(w)
    assert len(set(rows)) == len(set(columns)) == min(n, m)
    small, large = (w, m) if n <= m else (w.T, n)
    best = max(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), len(small)))
    assert np.isclose(w[rows, columns].sum(), best)


def test_cost_bound(spark):
    assert too_costly(5000, 5000) and not too_costly(100, 100)


def test_scores(spark):
    p, t = Graph.of(edges(spark, ("a", "b", 1), ("a", "c", 1))), Graph.of(edges(spark, ("a", "b", 1), ("b", "d", 1), ("b", "e", 1)))
    r = metrics.edge_scores(p, t).first()
    assert np.allclose([r["precision"], r["recall"], r["f1"]], [0.5, 1 / 3, 0.4])
    empty = Graph.of(edges(spark, ("a", "b", 1)).limit(0))
    assert tuple(metrics.edge_scores(empty, t).first()) == (0.0, 0.0, 0.0)
    e = similarity.embed(t.vertices)
    assert np.isclose(similarity.edge_match(t, t, e, 0.9).first()["f1"], 1.0)
    assert np.isclose(similarity.soft_edge_match(t, t, e).first()["f1"], 1.0)


def test_best_setting(spark):
    rows = spark.createDataFrame([(0, None), (1, 0.3), (2, 0.3)], "row_idx int, m double")
    assert metrics.best_setting(rows, "m").first()["row_idx"] == 1
    with pytest.raises(ValueError):
        metrics.best_setting(rows.filter("m is null"), "m")


def test_ppmi_single_cell(spark):
    cells = spark.createDataFrame([("x", "y", 2.0)], "row string, col string, v double")
    assert association.ppmi(cells).first()["v"] == 0.0


def test_svd_restores_low_rank(spark):
    a = np.outer([1.0, 2, 3], [2.0, 1, 0.5, 3])
    cells = spark.createDataFrame([(f"r{i}", f"c{j}", float(a[i, j])) for i in range(3) for j in range(4)], "row string, col string, v double")
    got = association.svd_scores(cells, cells.select("row", "col"), 1)
    assert all(abs(r["score"] - a[int(r["row"][1]), int(r["col"][1])]) < 1e-6 for r in got.collect())


def test_grid_and_sweep(spark):
    g = sweep.grid(25, 5)
    assert len(g) == 25 and g[0][0] == 0.0 and all(0 <= a <= 1 and 0 <= r <= 1 for a, r in g)
    e = edges(spark, ("a", "b", 5), ("a", "c", 3), ("b", "a", 1), ("c", "c", 1))
    kept = sweep.pruned_by_setting(Graph.of(e), [(0.0, 1.0), (0.0, 0.5)])
    by = {i: pairs(kept.filter(F.col("setting") == i)) for i in (0, 1)}
    for i, (a, r) in enumerate([(0.0, 1.0), (0.0, 0.5)]):
        assert by[i] == pairs(prune.post_process(Graph.of(e), prune.Settings(a, r, add_root=False)).edges)


def test_tables(spark):
    rows = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, "z", 3)], "id int, v string, at int")
    assert {r["v"] for r in tables.first_wins(rows, "id", "at").collect()} == {"y", "z"}
    assert {r["v"] for r in tables.last_wins(rows, "id", "at").collect()} == {"x", "z"}
    assert tables.query_one(rows, id=2)["v"] == "z"
    with pytest.raises(ValueError):
        tables.query_one(rows, id=3)
    assert sorted(r["at"] for r in tables.numbered(spark.range(100), "id").collect()) == list(range(100))
    assert tables.without_share(rows, 0.5, "id", "v").count() == 2


def test_papers(spark):
    rows = spark.createDataFrame([("1", " A \n b", "x", "math-ph cs.AI", [("v10", "Mon, 2 Apr 2007 19:18:42 GMT"), ("v2", "Sun, 1 Apr 2007 10:00:00 GMT")])], "id string, title string, abstract string, categories string, versions array<struct<version:string,created:string>>")
    p = papers.papers_of(rows).first()
    assert p["title"] == "A b" and str(p["date"]) == "2007-04-01 10:00:00"
    assert rows.select(papers.category_of(F.lit("math-ph")).alias("c")).first()["c"] == "math.MP"


def test_crawl_and_retry():
    tree = {1: ([11], [2, 3]), 2: ([12], [3]), 3: ([], [1])}
    calls = []

    def transport(asked):
        calls.append(asked["pageids"])
        if len(calls) == 1:
            return 429, {}
        pages, below = tree[asked["pageids"]]
        members = {str(p): {"pageid": p, "ns": 0, "title": f"P{p}"} for p in pages} | {str(b): {"pageid": b, "ns": 14, "title": f"Category:C{b}"} for b in below}
        return 200, {"title": f"Category:C{asked['pageids']}", "query": {"pages": members}}

    waited = []
    first = web.request(transport, {"pageids": 1}, sleep=waited.append)
    assert waited == [1] and first["title"] == "Category:C1"
    found = list(web.crawl(transport, 1, 2))
    assert [r["id"] for r in found] == [1, 2, 3] and found[0]["sub_categories"][0] == {"id": 2, "title": "C2"}
    assert [r["id"] for r in web.crawl(transport, 1, 1, known={1: found[0]})] == [2, 3]
    limit = web.RateLimit(1.0, 2, clock=lambda: sum(waited[1:]), sleep=waited.append)
    for _ in range(3):
        limit()
    assert waited[1:] == [1.0]


@pytest.mark.parametrize("seed", range(4))
def test_strong_components_against_reachability(spark, seed):
    rng = np.random.default_rng(seed)
    n = 24
    held = {(int(a), int(b)) for a, b in rng.integers(0, n - 2, (16 + 6 * seed, 2))} | ({(i, i + 1) for i in range(5)} | {(5, 0)} if seed else {(0, 1), (1, 0)})
    reach = np.eye(n, dtype=bool)
    for a, b in held:
        reach[a, b] = True
    for _ in range(5):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    want = {f"{i:02d}": f"{min(j for j in range(n) if reach[i, j] and reach[j, i]):02d}" for i in range(n)}
    vertices = spark.createDataFrame([(f"{i:02d}",) for i in range(n)], "id string")
    got = structure.strong_components(vertices, edges(spark, *[(f"{a:02d}", f"{b:02d}", 1) for a, b in held])).collect()
    assert {r["id"]: r["component"] for r in got} == want and len(got) == n


def test_long_rings_and_paths_fold(spark, monkeypatch):
    """A ring and a path of 300 take few tables, not one for each vertex."""
    written, write = [], structure.materialise
    monkeypatch.setattr(structure, "materialise", lambda f, name="table": written.append(name) or write(f, name))
    ids = spark.range(600).select(F.format_string("%03d", "id").alias("id"))
    ring = spark.range(599).select(F.format_string("%03d", "id").alias("src"), F.format_string("%03d", F.when(F.col("id") == 299, 0).otherwise(F.col("id") + 1)).alias("dst"))
    sizes = structure.strong_components(ids, ring).groupBy("component").count().groupBy("count").agg(F.count("*").alias("n")).collect()
    assert {(r["count"], r["n"]) for r in sizes} == {(300, 1), (1, 300)}
    assert len(written) < 100


def test_shares_are_taken_away_without_a_single_sort(spark):
    rows = spark.createDataFrame([(f"v{i % 50}", f"v{i // 50}") for i in range(1000)] * 2, "src string, dst string")
    out = tables.without_share(rows.distinct(), 0.2, "src", "dst", seed=3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    order = sorted({tuple(r) for r in rows.collect()}, key=lambda r: (hashlib.md5(f"{r[0]}:{r[1]}:3".encode()).hexdigest(), r))
    assert {tuple(r) for r in out.collect()} == set(order[200:])


def test_small_tables_with_much_work_are_dealt(spark):
    """The sentences of a supplier table of one small file are more than one task."""
    from helpers import SMALL

    from graphloom.plans import whole_queries

    assert whole_queries.tagged_rules(spark, SMALL).rdd.getNumPartitions() >= 32
