import numpy as np
from helpers import SMALL
from pyspark.sql import functions as F

from graphloom.llm import langid, quality, toxicity


def test_language_held_out(spark):
    found = langid.op8_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("a")).first()
    assert r["a"] >= 0.95


def test_language_edge_cases(spark, docs):
    model = langid.fit(docs((1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, None, "de"), (4, "x", None)))
    assert model[0] == ["en", "fr"]
    out = {r["doc_id"]: r for r in langid.classify(docs((1, None), (2, ""), (3, "12 !? 3"), (4, "the dog"), (5, "le chien " * 80_000)), model).collect()}
    assert [out[i]["lang_pred"] for i in range(1, 6)] == ["und", "und", "und", "en", "fr"] and out[1]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in out.values())
    nothing = langid.fit(docs((1, None)))
    assert langid.classify(docs((1, "abc")), nothing).first()["lang_pred"] == "und"


def test_slices_lose_no_grams():
    symbols = langid.letters("abc déf " * 40)
    whole = np.concatenate(list(langid.columns_of(symbols)))
    size, langid.SLICE = langid.SLICE, 7
    try:
        parts = np.concatenate(list(langid.columns_of(symbols)))
    finally:
        langid.SLICE = size
    assert np.array_equal(np.sort(whole), np.sort(parts))


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = quality.op7_quality(spark, SMALL).filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.85


def test_isotonic_is_best_rising_fit():
    at, values = quality.isotonic(np.array([1.0, 1, 1, 1]), np.array([0.0, 1, 0, 1]), np.arange(4.0))
    assert list(values) == [0.0, 0.5, 1.0] and list(at) == [0.0, 1.5, 3.0]


def test_quality_edge_cases(spark, docs):
    assert quality.statistics("") == [0.0] * len(quality.STATISTICS)
    stats = quality.document_statistics(docs((1, None), (2, "a fine text."), (3, "A!! " * 100_000)))
    one = quality.fit(stats.withColumn("y", F.lit(1)).withColumn("part", F.col("doc_id")))
    assert {r["score"] for r in quality.score(stats, one).collect()} == {1.0}
    none = quality.fit(stats.withColumn("y", F.lit(None).cast("int")).withColumn("part", F.col("doc_id")))
    assert {r["score"] for r in quality.score(stats, none).collect()} == {0.5}


def test_toxicity_learns_from_positives_and_unlabelled(spark, docs):
    rng = np.random.default_rng(0)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = [(i, " ".join(rng.choice(words, 30)) + (" rotten" if i % 6 == 0 else "")) for i in range(600)]
    frame = docs(*rows)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(400)] + [(500, None)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(frame, toxicity.fit(frame, labels)).collect()}
    right = [(out[i]["predicted"] == 1) == (i % 6 == 0) for i in range(400, 600)]
    assert np.mean(right) >= 0.98
    odd = {r["doc_id"]: r["score"] for r in toxicity.score(docs((1, None), (2, "")), toxicity.fit(frame, labels)).collect()}
    assert odd[1] == odd[2] < 0.5
    assert toxicity.score(frame, toxicity.fit(frame, labels.filter("toxic = 0"))).filter("score <> 0").count() == 0


def test_risk_stays_non_negative():
    rng = np.random.default_rng(1)
    p, u = rng.random((40, 200)) < 0.5, rng.random((60, 200)) < 0.5  # noise that a free fit would memorise
    model = toxicity.PULinear(0.3, steps=300).fit(p.astype(float), u.astype(float))
    loss = lambda z: 1 / (1 + np.exp(z))
    g = lambda x: x @ model.w + model.b
    assert loss(-g(u.astype(float))).mean() - 0.3 * loss(-g(p.astype(float))).mean() > -0.1


def test_language_tables_of_all_kinds(spark, docs):
    model = langid.fit(docs((1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")))
    twice = langid.classify(docs((7, "the dog"), (7, "the dog"), (None, "le chien")), model).collect()
    assert sorted((r["doc_id"] is None, r["lang_pred"]) for r in twice) == [(False, "en"), (False, "en"), (True, "fr")]
    assert langid.classify(docs((1, "a")).limit(0), model).count() == 0 and langid.fit(docs((1, "a")).limit(0))[0] == []


def test_quality_tables_of_all_kinds(spark, docs):
    stats = quality.document_statistics(docs((1, "a fine text."), (1, "a fine text."), (None, "a fine text.")))
    one = quality.fit(stats.withColumn("y", F.lit(1)).withColumn("part", F.lit(1)))
    assert [r["score"] for r in quality.score(stats, one).collect()] == [1.0] * 3
    empty = quality.document_statistics(docs((1, "a")).limit(0))
    assert quality.score(empty, one).count() == 0
    none = quality.fit(empty.withColumn("y", F.lit(1)).withColumn("part", F.lit(1)))
    assert {r["score"] for r in quality.score(stats, none).collect()} == {0.5}


def _words(rng):
    return [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]


def test_toxicity_reads_no_negative_labels(spark, docs):
    rng = np.random.default_rng(5)
    words = _words(rng)
    frame = docs(*[(i, " ".join(rng.choice(words, 30)) + (" rotten" if i % 6 == 0 else "")) for i in range(900)])
    rows = [(i, int(i % 6 == 0)) for i in range(300)]
    labels = spark.createDataFrame(rows, "doc_id long, toxic int")
    turned = spark.createDataFrame([(i, y if y else None) for i, y in rows] + rows[:50], "doc_id long, toxic int")
    a, b = (toxicity.score(frame, toxicity.fit(frame, x)).orderBy("doc_id").collect() for x in (labels, turned))
    assert a == b and np.mean([(r["predicted"] == 1) == (r["doc_id"] % 6 == 0) for r in a]) >= 0.98


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(6)
    for prior in (0.05, 0.3):
        positive = rng.random((1500, 12)) < 0.5
        unlabelled = np.where((rng.random(3000) < prior)[:, None], rng.random((3000, 12)) < 0.5, rng.random((3000, 12)) < 0.03)
        assert abs(toxicity.prior_of(positive.astype(float), unlabelled.astype(float)) - prior) < 0.04


def test_toxicity_tables_of_all_kinds(spark, docs):
    labels = spark.createDataFrame([(0, 1), (None, 1), (2, None)], "doc_id long, toxic int")
    nothing = toxicity.fit(docs((1, "a")).limit(0), labels)
    frame = docs((1, "x " * 300_000), (1, "bad"), (1, "bad"), (None, None), (2, "")).withColumnRenamed("source", "score").withColumnRenamed("lang", "predicted")
    rows = toxicity.score(frame, nothing).collect()
    assert len(rows) == 5 and {r["score"] for r in rows} == {0.0}
    assert toxicity.score(frame.limit(0), nothing).count() == 0


def test_toxicity_query_on_held_out_labels(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = toxicity.op2_toxicity(spark, SMALL).join(labels, "doc_id").filter("held_out").collect()
    assert rows and np.mean([r["predicted"] == r["toxic"] for r in rows]) >= 0.9


def _auc(rows):
    """The share of (one, zero) pairs that the score has in order; a constant has a half."""
    ones, zeros = ([s for s, y in rows if y == k] for k in (1, 0))
    assert len(ones) > 4 and len(zeros) > 4
    return sum((a > b) + (a == b) / 2 for a in ones for b in zeros) / (len(ones) * len(zeros))


def test_held_out_documents_are_ranked(spark):
    """On held-out labels of a table with enough of both kinds, which a constant score would rank at 0.5."""
    from graphloom.llm import quality, toxicity

    larger = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    for query, label, least in ((toxicity.op2_toxicity, "toxic", 0.75), (quality.op7_quality, "quality", 0.8)):
        rows = [(r["score"], labels[r["doc_id"]][label]) for r in query(spark, larger).filter("held_out").select("doc_id", "score").collect() if r["doc_id"] in labels]
        assert _auc([x for x in rows if x[1] is not None]) >= least, label


def test_language_sums_of_many_texts_at_once():
    """Equal to a text by itself, n-gram by n-gram, in batches of any size."""
    table = np.random.default_rng(4).normal(size=(langid.COLUMNS, 3)).astype(np.float32)
    texts = ["the dog", None, "", "le chien et le chat " * 9, "12", "x", "déjà vu" * 30]
    want = np.zeros((len(texts), 3))
    for i, text in enumerate(texts):
        for at in langid.columns_of(langid.letters(text or "")):
            want[i] += table[at].sum(axis=0, dtype=np.float64)
    size = langid.SLICE
    try:
        for langid.SLICE in (size, 11):
            total, lettered = langid.sums(texts, table)
            assert np.allclose(total, want) and lettered.tolist() == [True, False, False, True, False, True, True]
    finally:
        langid.SLICE = size


def test_language_keeps_columns_of_clashing_names(spark, docs):
    model = langid.fit(docs((1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr")))
    rows = [(None, "the dog", 7, "q", "own"), (3, "le chien", 8, "r", "own"), (3, "le chien", 8, "r", "own")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int, lang_pred string, _text string")
    found = langid.classify(frame, model, ("doc_id", "text", "score", "lang_pred", "_text"))
    assert found.columns == ["doc_id", "text", "kept_score", "kept_lang_pred", "_text", "lang_pred", "score"]
    got = sorted((r["doc_id"] or 0, r["text"], r["kept_score"], r["kept_lang_pred"], r["_text"], r["lang_pred"]) for r in found.collect())
    assert got == [(0, "the dog", 7, "q", "own", "en")] + [(3, "le chien", 8, "r", "own", "fr")] * 2
    assert langid.classify(frame.limit(0), model, ("doc_id", "score")).count() == 0
