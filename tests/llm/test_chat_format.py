from helpers import SMALL, same
from pyspark.sql import functions as F

from graphloom.llm import chat_format as C

TYPE = f"conv_id long, turn long, role string, parts array<{C.PART}>"


def test_matches_sql(spark, duck):
    same(C.op3_chat_format(spark, SMALL), duck, C.OP3_SQL)


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def test_parts_and_round_trip(spark):
    rows = [
        (1, 0, "user", [part("text", "see <|end|> &lt; "), part("image", ref="a.png", width=56, height=29), part("audio", ref="b.wav", seconds=2.0)]),
        (1, 1, "assistant", [part("text", "ok <|text|>")]),
        (1, 2, "user", [part("document", ref="c.pdf", pages=3), part("text", None)]),
        (2, None, None, None),
    ]
    out = {r["conv_id"]: r for r in C.format_chat(spark.createDataFrame(rows, TYPE)).withColumn("turns", C.read_back(F.col("formatted"))).collect()}
    one = out[1]
    assert [(t["role"], t["text"]) for t in one["turns"]] == [("user", "see <|end|> &lt; <|image:0|><|audio:1|>"), ("assistant", "ok <|text|>"), ("user", "<|document:2|>")]
    assert [(a["turn"], a["kind"], a["ref"], a["ordinal"], a["tokens"]) for a in one["attachments"]] == [(0, "image", "a.png", 0, 4), (0, "audio", "b.wav", 1, 25), (2, "document", "c.pdf", 2, 1536)]
    (start, length), = [tuple(s) for s in one["loss_spans"]]
    assert one["formatted"][start : start + length] == "ok &lt;|text|>"
    assert [(t["role"], t["text"]) for t in out[2]["turns"]] == [("", "")]


def test_ties_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    out = C.format_chat(rows.withColumn("parts", C.text_part(F.col("text")))).withColumn("turns", C.read_back(F.col("formatted")))
    assert {r["conv_id"]: [t["text"] for t in r["turns"]] for r in out.collect()} == {1: ["a", "a", "b"], None: [""]}
    assert C.format_chat(rows.withColumn("parts", C.text_part(F.col("text"))).limit(0)).count() == 0


def test_equal_turns_go_by_text(spark):
    rows = spark.createDataFrame([(1, 0, "user", 'a"', "x"), (1, 0, "user", "a#", "y"), (1, 0, "user", "a", "z")], "conv_id long, turn long, role string, text string, formatted string")
    done = C.format_chat(rows.withColumn("parts", C.text_part(F.col("text"))))
    assert [t["text"] for t in done.select(C.read_back(F.col("formatted")).alias("t")).first()["t"]] == ["a", 'a"', "a#"]
