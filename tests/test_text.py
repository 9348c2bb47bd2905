from pyspark.sql import functions as F

from graphloom.functions import prompts
from graphloom.functions import text as T


def one(spark, column, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_paths(spark):
    text = "Main topic classifications -> A -> B\n\nMain topic classifications\nMain topic classifications -> A -> B"
    p = one(spark, T.parse_paths(F.col("v0")), text)
    assert {(r["src"], r["dst"]) for r in p["relations"]} == {("Main topic classifications", "A"), ("A", "B")}
    assert (p["total"], p["invalid"]) == (3, 1)
    assert one(spark, T.parse_paths(F.col("v0")), "Main topic classifications -> A->B")["invalid"] == 1
    assert one(spark, T.parse_paths(F.col("v0")), None)["total"] == 0


def test_concepts(spark):
    assert one(spark, T.parse_concepts(F.col("v0")), ' "a". , b,') == ["a", "b", ""]


def test_triplets(spark):
    found = one(spark, T.parse_triplets(F.col("v0")), "<s><triplet> cat <subj> animal <obj> subclass of <subj> pet <obj> instance of</s>")
    assert [tuple(t) for t in found] == [("cat", "subclass of", "animal"), ("cat", "instance of", "pet")]
    assert one(spark, T.parse_triplets(F.col("v0")), "<triplet> cat <subj> animal") == []
    edges = one(spark, T.triplet_edges(T.parse_triplets(F.col("v0"))), "<triplet> cat <subj> animal <obj> subclass of <subj> home <obj> country")
    assert [tuple(e) for e in edges] == [("animal", "cat")]


def test_small_functions(spark):
    assert one(spark, T.one_line(F.col("v0")), "  a \n\n b") == "a b"
    assert one(spark, T.without_prefix(F.col("v0")), "Category:Art") == "Art"
    assert str(one(spark, T.http_date(F.col("v0")), "Mon, 2 Apr 2007 19:18:42 GMT")) == "2007-04-02 19:18:42"
    assert one(spark, T.adjacent_pairs(F.split("v0", ",")), "a") == []
    assert one(spark, T.find_sublist(F.split("v0", ","), F.split("v1", ",")), "a,b,c,b,c", "b,c") == 1
    assert one(spark, T.find_sublist(F.split("v0", ","), F.split("v1", ",")), "a", "b,c") is None
    assert one(spark, T.response_length(F.col("v0")), "a -> b -> c") == 3
    assert one(spark, T.run_number(F.col("v0")), "fine-run-17") == 17
    assert one(spark, T.plain_phrase(F.col("v0")), "NP_Big_cats") == "big cats"
    assert one(spark, T.has_stop_word(F.col("v0"), ("by",)), "Works by year") is True


def test_tagged_and_hearst(spark):
    r = one(spark, T.tagged_relation(F.col("v0")), "big cat ||| animal|||such as 1")
    assert tuple(r) == ("big cat", "animal", "such as 1")
    assert one(spark, T.tagged_relation(F.col("v0")), "no relation") is None
    found = one(spark, T.hearst_pairs(F.col("v0")), "NP_animals such as NP_cats, NP_dogs and NP_cows; NP_oak and other NP_trees")
    assert {(p["src"], p["dst"]) for p in found} == {("NP_animals", "NP_cats"), ("NP_animals", "NP_dogs"), ("NP_animals", "NP_cows"), ("NP_trees", "NP_oak")}


def test_prompts(spark):
    rows = spark.sql("select 'T' as t, 'A' as a, array(array('Main topic classifications', 'X')) as p")
    text = rows.select(prompts.response(F.col("p")).alias("r"), prompts.paths_prompt(F.col("t"), F.col("a")).alias("z"), prompts.paths_prompt(F.col("t"), F.col("a"), F.array(F.struct(F.col("t").alias("title"), F.col("a").alias("abstract"), F.col("p").alias("paths")))).alias("f")).first()
    assert text["r"] == "Main topic classifications -> X\n"
    assert "You must answer in the format of" in text["z"] and "### EXAMPLE 1 ###" in text["f"]
    assert rows.select(prompts.is_response(prompts.response(F.col("p"))).alias("x")).first()["x"]


def test_long_texts_are_read_once(spark):
    """A hundred thousand phrases, paths and concepts: no deep match, no phrase read again for each of the others."""
    n = 100_000
    phrases = ", ".join(f"NP_{i}" for i in range(n))
    one = spark.createDataFrame([("\n".join([T.ROOT + " -> a -> b"] * n), T.ROOT + " -> a" * n, f"NP_p such as {phrases}", f"{phrases} and other NP_z", phrases)], "a string, b string, c string, d string, e string")
    pairs = [F.size(T.hearst_pairs(F.col(c))).alias(c) for c in "cde"]
    assert tuple(one.select(prompts.is_response(F.col("a")).alias("a"), prompts.is_response(F.col("b")).alias("b"), *pairs).first()) == (True, True, n, n, 0)


def test_responses(spark):
    good = [T.ROOT + " -> a", T.ROOT + " -> a\n", T.ROOT + " -> a -> b, (c)\n" + T.ROOT + " -> Caf\u00e9 3"]
    bad = ["", T.ROOT, T.ROOT + "\n", T.ROOT + " -> ", T.ROOT + " -> a -> ", T.ROOT + " -> a\n\n" + T.ROOT + " -> b", T.ROOT + "->a", "x\n" + T.ROOT + " -> a", T.ROOT + " -> a>b", T.ROOT + " -> a\r", "\n" + T.ROOT + " -> a", " " + T.ROOT + " -> a"]
    rows = spark.createDataFrame([(x,) for x in good + bad], "x string")
    assert [r[0] for r in rows.select(prompts.is_response(F.col("x"))).collect()] == [True] * len(good) + [False] * len(bad)


def test_triplets_out_of_order(spark):
    """A tail takes the relation of the one before it, and a relation without a tail the tail before the head."""
    cases = {
        "<triplet> a <subj> b <obj> r <subj> c <triplet> d": [("a", "r", "b"), ("a", "r", "c")],
        "<triplet> a <subj> b <obj> r <triplet> c <obj> q <triplet>": [("a", "r", "b"), ("c", "q", "b")],
        "<subj> b <obj> r <subj> c": [("", "r", "b")],
        "<triplet> a <subj> b <obj> r <obj> q s <subj>": [("a", "q s", "b")],
        "x <triplet><subj> a <subj> b <obj>": [],
        "<triplet> <subj> b <obj> r": [],
    }
    rows = spark.createDataFrame([(x,) for x in cases], "x string").select(T.parse_triplets(F.col("x")).alias("t")).collect()
    assert [[tuple(t) for t in r["t"]] for r in rows] == list(cases.values())
