from helpers import SMALL

import corpus_pipeline as C
from graphloom.llm import decontaminate, jaccard_join, langid


def test_stages_against_their_decisions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = set(texts)
    first = C.language_id(spark, docs, SMALL)
    assert first.columns == columns and {r["doc_id"] for r in first.collect()} == kept  # all have a language here

    second = C.exact(spark, first, SMALL)
    groups = {}
    for d, t in texts.items():
        groups.setdefault(t.translate({ord(c): None for c in " \t\n\v\f\r"}), []).append((-len(t), d))
    kept = {min(g)[1] for g in groups.values()}
    assert second.columns == columns and sorted(r["doc_id"] for r in second.collect()) == sorted(kept)

    third = C.near(spark, second, SMALL)
    found = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark, second).collect()}
    kept = set(found.values())
    assert third.columns == columns and {r["doc_id"] for r in third.collect()} == kept

    fourth = C.clean_of_benchmarks(spark, third, SMALL)
    items = [decontaminate.normalised(r["text"].encode()).tobytes() for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {r["doc_id"] for r in fourth.collect()}
    for d in kept:
        hit = any(decontaminate.edits_within(i, decontaminate.normalised(texts[d].encode()).tobytes(), int(0.1 * len(i))) for i in items)
        assert (d in left) != hit
    packed = C.packed(spark, fourth, SMALL)
    assert {r["doc_id"] for r in packed.collect()} == left


def test_rejects_what_has_no_language(spark, docs):
    frame = docs((1, "the cat and the dog"), (2, "123 !!"), (3, None), (4, "le chat et le chien", "fr"), (5, "the dog and the cat"))
    assert {r["doc_id"] for r in C.language_id(spark, frame, SMALL).collect()} == {1, 4, 5}
    assert langid.UNKNOWN == "und" and [n for n, _ in C.STAGES][0] == "language_id" and C.ORACLE_SQL is None
