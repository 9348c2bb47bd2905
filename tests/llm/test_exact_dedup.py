import hashlib
import random

from helpers import SMALL, same

from graphloom.llm import exact_dedup as E
from graphloom.llm.exact_dedup import CuckooIndex


def key(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_inserts_deletes_and_grows():
    index, live = CuckooIndex(2), {}
    rng = random.Random(1)
    for step in range(6000):
        k = key(rng.randrange(1500))
        if rng.random() < 0.4:
            assert index.delete(k) == (k in live)
            live.pop(k, None)
        else:
            index.insert(k, step)
            live[k] = step
    assert dict(index.items()) == live and len(index) == len(live)
    assert all((key(i) in index) == (key(i) in live) for i in range(1500))


def test_fingerprint_hits_are_verified():
    index = CuckooIndex(2)
    a = b"a" * 24 + (5 << 48 | 1).to_bytes(8, "little")
    b = b"b" * 24 + (5 << 48 | 1).to_bytes(8, "little")
    index.insert(a)
    assert a in index and b not in index and not index.delete(b)


def test_matches_sql(spark, duck):
    same(E.op1_exact_dedup(spark, SMALL), duck, E.OP1_SQL)


def test_edge_cases(spark, docs):
    frame = docs((1, "a b"), (2, "ab"), (3, "a  b"), (4, None), (5, ""), (6, " \t\n\v\f\r"), (None, "ab "), (7, "x"), (7, "x"), (8, "é x" * 50_000))
    out = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in E.exact_duplicates(spark, frame.withColumnRenamed("source", "digest")).collect()}
    assert {(1, 3, 4, False), (2, 3, 4, False), (3, 3, 4, True), (None, 3, 4, False)} <= out
    assert {(4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 2, True), (8, 8, 1, True)} <= out
    assert E.exact_duplicates(spark, frame.limit(0)).count() == 0


def test_update(spark, docs):
    index = E.build_index(E.digests(docs((1, "a"), (2, "b"), (3, "b"))))
    gone = E.digests(docs((1, "a"), (2, "b")))
    new = E.digests(docs((9, "c"), (8, "b")))
    rows = {r["doc_id"]: r["copies"] for r in E.update_index(index, new, gone).collect()}
    assert rows == {2: 2, 9: 1}


def test_update_names_a_live_document(spark, docs):
    index = E.build_index(E.digests(docs((1, "a"), (2, "b"), (3, "b"))))
    gone = E.digests(docs((1, "a"), (2, "b")))
    new = E.digests(docs((9, "c"), (8, "b"), (7, "a a")))
    live = E.digests(docs((3, "b"), (9, "c"), (8, "b"), (7, "a a")))
    rows = {r["doc_id"]: r["copies"] for r in E.update_index(index, new, gone, live).collect()}
    assert rows == {3: 2, 9: 1, 7: 1}


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a", 1, 1, 1), (2, "a ", 2, 2, 2)], "doc_id long, text string, keep_id int, copies int, n_points int")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in E.exact_duplicates(spark, frame).collect()) == [(1, 2, 2), (2, 2, 2)]
