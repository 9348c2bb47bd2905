"""Betweenness as tables against the form that holds the links in memory, and by hand."""

import random

import pytest

from graphloom.graph import Graph
from graphloom.operators import centrality, structure


def graph(spark, pairs, more=()):
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src string, dst string, weight double")
    ids = sorted({v for p in pairs for v in p} | set(more))
    return Graph(spark.createDataFrame([(v, v.upper()) for v in ids], "id string, title string"), edges)


def scores(frame):
    return {r["id"]: r["score"] for r in frame.collect()}


@pytest.fixture(scope="module")
def layered(spark):
    """Five levels, each vertex under one to three of the level above, and some links within levels; loops, both ways and repeats beside them."""
    rng = random.Random(5)
    sizes = (1, 3, 6, 10, 14)
    names = [[f"v{d}_{i}" for i in range(n)] for d, n in enumerate(sizes)]
    pairs = [(rng.choice(above), v) for above, level in zip(names, names[1:], strict=False) for v in level for _ in range(rng.randint(1, 3))]
    pairs += [tuple(rng.sample(level, 2)) for level in names[2:] for _ in range(3)]
    pairs += [("v2_0", "v2_0"), pairs[0], pairs[1][::-1]]
    return graph(spark, pairs, more=["alone"])


def test_equals_the_form_in_memory(layered):
    want = scores(structure.betweenness(layered))
    assert max(want.values()) > 0.1 and want["alone"] == 0.0
    for got in (centrality.betweenness(layered), centrality.betweenness(layered, batch=20, hub=3)):
        rows = got.collect()
        assert {r["error"] for r in rows} == {0.0}
        assert {r["id"]: r["score"] for r in rows} == pytest.approx(want, abs=1e-12)


def test_larger_graphs_go_through_tables(layered):
    assert scores(structure.betweenness(layered, most_edges=5)) == pytest.approx(scores(structure.betweenness(layered)), abs=1e-12)


def test_pivots_stay_within_their_error(layered):
    want = scores(centrality.betweenness(layered))
    rows = centrality.betweenness(layered, pivots=12).collect()
    assert 0 < rows[0]["error"] < 1
    assert any(abs(r["score"] - want[r["id"]]) > 1e-9 for r in rows)
    assert all(abs(r["score"] - want[r["id"]]) <= r["error"] for r in rows)


def test_sources_and_empty_tables(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("b", "e"), ("e", "d")])
    some = spark.createDataFrame([("a",), ("a",), ("unknown",)], "id string")
    got = {r["id"]: r["owed"] for r in centrality.path_shares(g.edges, some).collect()}
    assert got == pytest.approx({"b": 3.0, "c": 0.5, "e": 0.5, "d": 0.0})
    assert centrality.path_shares(g.edges.limit(0), some).count() == 0
    assert centrality.path_shares(g.edges, some.limit(0)).count() == 0
    assert centrality.betweenness(Graph(g.vertices.limit(0), g.edges.limit(0))).count() == 0
    with pytest.raises(RuntimeError):
        centrality.path_shares(g.edges, some, most_depth=1).count()


def test_state_is_a_row_a_vertex_for_many_sources(spark, monkeypatch):
    """A hub over 60 leaves, all of them sources: rows are those of two turns of sources, not of each source."""
    g = graph(spark, [("hub", f"l{i:02}") for i in range(60)])
    rows, plain = [], centrality.materialise

    def counted(frame, name="table"):
        out = plain(frame, name)
        if name == "level":
            rows.append(out.count())
        return out

    monkeypatch.setattr(centrality, "materialise", counted)
    got = {r["id"]: r["owed"] for r in centrality.path_shares(g.edges, g.vertices.filter("id <> 'hub'").select("id")).collect()}
    assert got == pytest.approx({"hub": 60.0 * 59, **{f"l{i:02}": 0.0 for i in range(60)}})
    assert sum(rows) <= 2 * 2 * 61 + 60  # before: 60 sources x 61 vertices
