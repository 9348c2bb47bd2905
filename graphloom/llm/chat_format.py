"""Chat formatting: typed content parts become one marked text for each conversation.

A message's content is a list of typed parts. A visitor (one column builder
for each type) flattens them: text is escaped, an image, audio clip or
document becomes a numbered placeholder. What each placeholder stands for, and
how many tokens it expands to, is recorded beside the text. Built-in functions
only: one shuffle by conversation, whose sort serves both running sums and the
final gathering.

Defined results: a null text or role counts as empty; a null content list as
no parts; a part of unknown type as its text; turns sort by number, nulls
first, then role and content, and repeated rows all stay; rows with a null
conversation id form one conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read

#: Marks of the template. All begin with "<", which an escaped text never holds.
ROLE, BODY, END = "<|role|>", "<|text|>", "<|end|>"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    """Takes every "<" out of a text, reversibly."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_part(text: Column) -> Column:
    """A plain text as a list with one part."""
    fields = {"type": F.lit("text"), "text": F.coalesce(text, F.lit(""))}
    names = ("type", "text", "ref", "width", "height", "seconds", "pages")
    kinds = ("string", "string", "string", "int", "int", "double", "int")
    return F.array(F.struct(*[fields.get(n, F.lit(None)).cast(k).alias(n) for n, k in zip(names, kinds, strict=True)]))


class PartVisitor:
    """Column builders by part type; subclass it to add a type or other token rules."""

    def __init__(self, patch: int = 28, audio_rate: float = 12.5, page_tokens: int = 512, chars_per_token: int = 4):
        self.patch, self.audio_rate, self.page_tokens, self.chars_per_token = patch, audio_rate, page_tokens, chars_per_token

    attachments = ("image", "audio", "document")

    def is_attachment(self, part: Column) -> Column:
        return F.coalesce(part["type"].isin(*self.attachments), F.lit(False))

    def placeholder(self, part: Column, ordinal: Column) -> Column:
        return F.concat(F.lit("<|"), part["type"], F.lit(":"), ordinal.cast("string"), F.lit("|>"))

    def visit(self, part: Column, ordinal: Column) -> Column:
        return F.when(self.is_attachment(part), self.placeholder(part, ordinal)).otherwise(escape(F.coalesce(part["text"], F.lit(""))))

    def tokens(self, part: Column) -> Column:
        """Tokens that the part expands to; unknown sizes count as one unit."""
        tiles = F.ceil(F.coalesce(part["width"], F.lit(1)) / self.patch) * F.ceil(F.coalesce(part["height"], F.lit(1)) / self.patch)
        clip = F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * self.audio_rate)
        return (
            F.when(part["type"] == "image", F.greatest(tiles, F.lit(1)))
            .when(part["type"] == "audio", F.greatest(clip, F.lit(1)))
            .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * self.page_tokens)
            .otherwise(F.ceil(F.length(F.coalesce(part["text"], F.lit(""))) / self.chars_per_token))
            .cast("long")
        )


def format_chat(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = ("assistant",), visitor: PartVisitor | None = None) -> DataFrame:
    """One row for each conversation: id, formatted, loss_spans, attachments, n_tokens.

    ``loss_spans`` are (start, length) in code points of ``formatted``: the
    bodies of turns whose role is trained on. ``attachments`` lists (turn, kind,
    ref, ordinal, tokens) in the order of their placeholders. ``n_tokens``
    counts every part as expanded.
    """
    visit = visitor or PartVisitor()
    known = F.coalesce(F.col("_parts"), F.array().cast(f"array<{PART}>"))
    rows = messages.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"), F.col(parts).alias("_parts"))
    rows = rows.withColumn("_parts", known)
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", F.array_join(F.transform("_parts", lambda p: F.coalesce(p["text"], F.lit(""))), ""), F.to_json("_parts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_held", F.filter("_parts", visit.is_attachment))
    rows = rows.withColumn("_pos", F.row_number().over(order)).withColumn("_base", F.coalesce(F.sum(F.size("_held")).over(before), F.lit(0)))
    # the ordinal of a part: those of earlier turns, then its place among this turn's attachments
    place = F.filter(F.sequence(F.lit(1), F.greatest(F.size("_parts"), F.lit(1))), lambda i: F.coalesce(visit.is_attachment(F.get(F.col("_parts"), i - 1)), F.lit(False)))
    rows = rows.withColumn("_places", place)
    body = F.array_join(F.transform("_parts", lambda p, i: visit.visit(p, F.col("_base") + F.array_position(F.col("_places"), i + 1) - 1)), "")
    head = F.concat(F.lit(ROLE), escape(F.col("_role")), F.lit(BODY))
    rows = rows.withColumn("_body", body).withColumn("_head", head)
    whole = F.length("_head") + F.length("_body") + len(END)
    rows = rows.withColumn("_from", F.coalesce(F.sum(whole).over(before), F.lit(0)) + F.length("_head"))
    recorded = F.transform("_held", lambda p, i: F.struct(F.col("_turn").alias("turn"), p["type"].alias("kind"), p["ref"].alias("ref"), (F.col("_base") + i).alias("ordinal"), visit.tokens(p).alias("tokens")))
    spent = F.aggregate(F.transform("_parts", visit.tokens), F.lit(0).cast("long"), lambda a, x: a + x)
    segment = F.struct("_pos", F.concat("_head", "_body", F.lit(END)).alias("s"), F.col("_role").isin(*trained).alias("loss"), F.struct(F.col("_from").alias("start"), F.length("_body").cast("long").alias("length")).alias("span"), recorded.alias("held"))
    grouped = rows.groupBy("_conv").agg(F.sort_array(F.collect_list(segment)).alias("_all"), F.sum(spent).alias("n_tokens"))
    return grouped.select(
        F.col("_conv").alias(conv),
        F.array_join(F.transform("_all", lambda x: x["s"]), "").alias("formatted"),
        F.transform(F.filter("_all", lambda x: x["loss"]), lambda x: x["span"]).alias("loss_spans"),
        F.flatten(F.transform("_all", lambda x: x["held"])).alias("attachments"),
        "n_tokens",
    )


def read_back(formatted: Column) -> Column:
    """The turns in a formatted text, as array<struct<role, text>>, unescaped; placeholders stay as they are."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    turns = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    halves = F.transform(turns, lambda t: F.split(F.substr(t, F.lit(len(ROLE) + 1)), r"<\|text\|>", 2))
    return F.transform(halves, lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -7, formatted and read back."""
    said = F.lit("\\### Assistant: </turn> ok")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    table = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)
    done = format_chat(table.withColumn("parts", text_part(F.col("text"))))
    turns = read_back(F.col("formatted"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return done.withColumn("_turns", turns).withColumn("_loss", loss).select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, length(replace(replace(role, '&', '&amp;'), '<', '&lt;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))
            + length('<|role|><|text|><|end|>') AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
