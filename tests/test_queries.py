"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest
from helpers import SMALL, same

import __spark_entry__
from graphloom.plans import queries as Q

LOOPS = {"split_report", "split_nodes", "scc_sizes", "diameter", "cleanup", "fuzzy_prf1"}


@pytest.mark.parametrize("name", sorted(set(Q.SQL) - LOOPS))
def test_matches_sql(spark, duck, name):
    same(Q.QUERIES[name](spark, SMALL), duck, Q.SQL[name])


@pytest.mark.parametrize("name", sorted(LOOPS))
def test_loops_match_sql(spark, duck, name):
    same(Q.QUERIES[name](spark, SMALL), duck, Q.SQL[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_spectrum_and_betweenness_take_all_trade_edges(spark):
    import numpy as np

    from graphloom.plans import fixtures as X

    rows = X.trade_edges(spark, SMALL).collect()
    names = sorted({r[c] for r in rows for c in ("src", "dst")})
    a = np.zeros((len(names), len(names)))
    for r in rows:
        i, j = names.index(r["src"]), names.index(r["dst"])
        a[i, j] = a[j, i] = 1.0
    scale = 1 / np.sqrt(a.sum(axis=1))
    want = np.linalg.eigvalsh(np.eye(len(names)) - scale[:, None] * a * scale[None, :])
    got = [r["value"] for r in Q.QUERIES["laplacian_spectrum"](spark, SMALL).orderBy("at").collect()]
    assert np.allclose(got, want, atol=1e-5)

    np.fill_diagonal(a, 0)
    n, between = len(names), np.zeros(len(names))
    two = a @ a  # ways of two steps between nations without a link; no nation is further away
    assert ((two > 0) | (a > 0) | np.eye(n, dtype=bool)).all()
    for i in range(n):
        for j in range(i):
            if not a[i, j]:
                between += a[i] * a[j] / two[i, j]
    got = {r["id"]: r["score"] for r in Q.QUERIES["betweenness"](spark, SMALL).collect()}
    assert np.allclose([got[v] for v in names], between / ((n - 1) * (n - 2) / 2), atol=1e-5)


def test_equal_paths_go_by_their_joined_text(spark, tmp_path):
    """In the SQL's ORDER BY path is the joined text, so NATION_111> comes before NATION_11> and NATION_1>."""
    trades = [(a, b) for a in (0, 1, 11, 111) for b in (1, 11, 111) if a != b] + [(a, 7) for a in (1, 11, 111)]
    rows = {
        "nation": ([(k, f"NATION_{k}") for k in (0, 1, 7, 11, 111)], "n_nationkey int, n_name string"),
        "supplier": ([(k, k) for k in (0, 1, 11, 111)], "s_suppkey long, s_nationkey int"),
        "customer": ([(k, k) for k in (1, 7, 11, 111)], "c_custkey long, c_nationkey int"),
        "orders": ([(i, b) for i, (_, b) in enumerate(trades)], "o_orderkey long, o_custkey long"),
        "lineitem": ([(i, a) for i, (a, _) in enumerate(trades)], "l_orderkey long, l_suppkey long"),
    }
    con = duckdb.connect()
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [r["path"] for r in Q.QUERIES["k_shortest_paths"](spark, str(tmp_path)).collect()]
    assert got == [r[0] for r in con.execute(Q.SQL["k_shortest_paths"]).fetchall()]
    assert got[0] == "NATION_0>NATION_111>NATION_7" and len(got) == 5
