"""Sinks that are stopped in the middle and go on."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from graphloom.operators import analysis
from graphloom.streaming import incremental


def test_generated_keeps_the_parts_of_a_stopped_run(spark, tmp_path):
    docs = spark.range(300).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("p"), "id").alias("text"))
    out, asked = str(tmp_path / "answers"), tmp_path / "asked"
    asked.mkdir()

    def generator(fails):
        folder = str(asked)

        def answer(prompts):
            from uuid import uuid4

            if fails and any(p in fails for p in prompts):
                raise RuntimeError("stopped")
            Path(folder, uuid4().hex).write_text("\n".join(prompts))
            return [f"re {p}" for p in prompts]

        return answer

    # the document in the fourth of six parts
    last = docs.filter(F.pmod(F.xxhash64("id"), F.lit(6)) == 3).first()["text"]
    with pytest.raises(Exception, match="stopped"):
        analysis.generated(docs, generator({last}), F.col("text"), out, part_rows=50)
    kept = {r["id"] for r in spark.read.parquet(out).collect()}
    assert kept == {r["id"] for r in docs.filter(F.pmod(F.xxhash64("id"), F.lit(6)) < 3).collect()} and 100 < len(kept) < 200
    shutil.rmtree(asked)
    asked.mkdir()
    rows = analysis.generated(docs, generator(set()), F.col("text"), out, part_rows=50).collect()
    assert sorted(r["id"] for r in rows) == sorted(str(i) for i in range(300)) and all(r["response"] == f"re p{r['id']}" for r in rows)
    again = {p[1:] for f in asked.iterdir() for p in f.read_text().split("\n")}
    assert not again & kept and again | kept == {str(i) for i in range(300)}


def test_generated_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(None, "a"), (None, "a"), ("1", None), ("1", None)], "id string, text string")
    out = str(tmp_path / "odd")
    for _ in range(2):
        rows = analysis.generated(docs, lambda ps: [str(p) for p in ps], F.col("text"), out).collect()
        assert sorted((r["id"] or "", r["response"]) for r in rows) == [("", "a"), ("1", "None")]
    assert analysis.generated(docs.limit(0), lambda ps: ps, F.col("text"), str(tmp_path / "none")).collect() == []


def test_a_batch_that_comes_again_replaces_itself(spark, tmp_path):
    """A run that stops behind the write leaves no mark of the batch's end."""
    folder, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    read = lambda: sorted(int(r["id"]) for r in spark.read.schema("id string").json(out).collect())
    work = lambda f: f.select("id")
    for k in range(3):
        spark.range(10 * k, 10 * k + 12).select(F.col("id").cast("string").alias("id")).coalesce(1).write.mode("append").json(folder)
        for _ in range(2):
            incremental.resume(incremental.new_rows(spark, "id string", folder), work, out, marks)
            assert read() == list(range(10 * k + 12))
            done = sorted(Path(marks, "commits").iterdir(), key=lambda p: p.name.strip(".").split(".")[0])
            for p in done:
                if p.name.strip(".").split(".")[0] == str(k):
                    p.unlink()
        incremental.resume(incremental.new_rows(spark, "id string", folder), work, out, marks)
        assert read() == list(range(10 * k + 12))


def test_a_failing_batch_is_written_once(spark, tmp_path):
    folder, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    spark.range(10).select(F.col("id").cast("string").alias("id")).write.json(folder)
    tries = []

    def work(frame):
        tries.append(1)
        if len(tries) == 1:
            frame.select("id").write.mode("overwrite").json(f"{out}/batch=0")
            raise RuntimeError("behind the write")
        return frame.select("id")

    with pytest.raises(Exception, match="behind the write"):
        incremental.resume(incremental.new_rows(spark, "id string", folder), work, out, marks)
    incremental.resume(incremental.new_rows(spark, "id string", folder), work, out, marks)
    assert spark.read.schema("id string").json(out).count() == 10 and len(tries) == 2
