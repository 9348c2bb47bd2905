"""Line deduplication by a deletion-neighbourhood join over words and characters.

Two lines count as the same when they are equal or one edit apart, an edit being a unit
put in, left out or replaced. Units are words where both lines have ``min_words`` words or
more, and characters where both have fewer words but ``min_chars`` characters or more; in
both cases that is a tenth of the line at most. Lines with fewer characters must be equal.
The earliest line (by document id, then line number) stays, and every later line that has
an earlier one within the bound goes; which, is reported. Built-in functions only:

1. Equal lines become one, by a 128-bit hash, with their earliest place; pre-aggregation
   leaves one row for a task and line however often it occurs.
2. Of the blocks that a line is cut into (two, or one for each 32 units of long lines), an
   edit leaves all but one whole. Lines are cut by the shorter line's length, so a longer
   line is cut for both lengths, and a key is hashed for all but each block in turn. Lines
   with a key that nobody shares are done.
3. For the others, the block that may differ is emitted with each of its units deleted in
   turn, as hashed keys: two lines within the bound share a key. Equal keys are not
   paired up: the earliest of each is found by aggregation and compared with the rest.
4. What shares a key is verified, and the earliest that holds is kept.

Lines that make up a thousandth of all or more are joined with their decision by broadcast
(there are a thousand at most), blank ones not at all, so no task gets all copies of one.

Defined results: a null text has no lines; an empty one has one blank line; blank
lines always stay; a null id comes before all others; lines of rows that repeat an id and
a line number and are equal stay or go together, and unlike ones do not displace each
other; an empty table gives an empty result. Only the id and the text are read, so
further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import read, scratch

MIN_WORDS = 10
MIN_CHARS = 10
#: Units of a block, and the most blocks of a line.
BLOCK, MOST_BLOCKS = 32, 64
#: Lines that make up this share of all, or more, are joined by broadcast.
HOT = 1000


def lines_of(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line."""
    return documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def _blocks(cut: Column) -> Column:
    """Into how many blocks a pair of lines is cut whose shorter one has ``cut`` units."""
    return F.greatest(F.lit(2), F.least(F.lit(MOST_BLOCKS), F.ceil(cut / BLOCK).cast("int")))


def _around(cut: Column, block: Column, blocks: Column) -> tuple[Column, Column]:
    """How many units stand before a block, and after it."""
    before = F.floor(block.cast("long") * cut / blocks).cast("int")
    return before, cut - F.floor((block.cast("long") + 1) * cut / blocks).cast("int")


def _head(line: Column, by_word: Column, n: Column) -> Column:
    return F.when(by_word, F.call_function("substring_index", line, F.lit(" "), n)).otherwise(F.substr(line, F.lit(1), n))


def _tail(line: Column, by_word: Column, count: Column, n: Column) -> Column:
    return F.when(by_word, F.call_function("substring_index", line, F.lit(" "), -n)).otherwise(F.substr(line, count - n + 1, n))


def _key(line: Column, by_word: Column, count: Column, cut: Column, block: Column, blocks: Column) -> Column:
    """The hash of all but one block."""
    before, after = _around(cut, block, blocks)
    return F.xxhash64(by_word, cut, block, _head(line, by_word, before), _tail(line, by_word, count, after))


def _keys(line: Column, by_word: Column, count: Column, least: Column) -> Column:
    """The keys of a line for its own length, then for that less one; null where the shorter line would be too short."""

    def short(less: int, block: int) -> Column:
        cut = count - less
        return F.when(cut >= least, _key(line, by_word, count, cut, F.lit(block), F.lit(2)))

    def long(cut: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), _blocks(cut) - 1), lambda block: _key(line, by_word, count, cut, block, _blocks(cut)))

    two = F.array(*[short(less, block) for less in (0, 1) for block in (0, 1)])
    return F.when(count <= 2 * BLOCK, two).otherwise(F.concat(long(count), long(count - 1)))


def one_edit_apart(a: Column, b: Column) -> Column:
    """Whether two word sequences are one edit apart at most: their common start and end cover the shorter one."""
    shorter = F.least(F.size(a), F.size(b))

    def common(x: Column, y: Column) -> Column:
        unlike = F.array_position(F.zip_with(F.slice(x, F.lit(1), shorter), F.slice(y, F.lit(1), shorter), lambda p, q: p != q), True)
        return F.when(unlike == 0, shorter).otherwise((unlike - 1).cast("int"))

    covered = common(a, b) + common(F.reverse(a), F.reverse(b))
    return F.when(F.size(a) == F.size(b), covered >= shorter - 1).otherwise((F.abs(F.size(a) - F.size(b)) == 1) & (covered >= shorter))


def verified(a: Column, b: Column, by_word: Column) -> Column:
    """Whether two lines are one edit apart at most."""
    return F.when(by_word, one_edit_apart(F.split(a, " ", -1), F.split(b, " ", -1))).otherwise(F.levenshtein(a, b, 1) >= 0)


def _hashed(lines: DataFrame, min_words: int, min_chars: int) -> DataFrame:
    """doc_id, line_no, blank, h1, h2, by_word, count (units; null where lines must be equal), keys."""
    line, by_word, count = F.col("line"), F.col("by_word"), F.col("count")
    out = lines.withColumn("blank", F.btrim(line, F.lit(" \t\r")) == "")
    out = out.withColumn("words", F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).withColumn("by_word", F.col("words") >= min_words)
    chars = F.char_length(line)
    out = out.withColumn("count", F.when(F.col("blank"), None).when(by_word, F.col("words")).when(chars >= min_chars, chars).cast("int"))
    least = F.when(by_word, min_words).otherwise(min_chars)
    keys = F.when(count.isNotNull(), _keys(line, by_word, count, least))
    return out.select("doc_id", "line_no", "blank", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "by_word", "count", keys.alias("keys"))


def _variants(near: DataFrame) -> DataFrame:
    """rank, short, replaced, variant: the block that may differ, with each unit left out, and whole."""
    line, by_word, count, cut = (F.col(c) for c in ("line", "by_word", "count", "cut"))
    before, after = _around(cut, F.col("block"), _blocks(cut))
    upto = count - after
    middle = F.when(by_word, F.call_function("substring_index", F.call_function("substring_index", line, F.lit(" "), upto), F.lit(" "), -(upto - before))).otherwise(F.substr(line, before + 1, upto - before))
    units = F.when(by_word, F.split(middle, " ", -1)).otherwise(F.split(middle, "", -1))
    rest = near.select("rank", "key", (count == cut).alias("short"), units.alias("units"))
    size = F.size("units")

    def without(p: Column) -> Column:
        left = F.concat(F.slice("units", F.lit(1), p), F.slice("units", p + 2, F.greatest(size - p - 1, F.lit(0))))
        # lines of one length match where the same unit is left out, a longer line where it equals a shorter one
        at = F.when(F.col("short"), p).otherwise(F.lit(-1))
        return F.struct(F.col("short").alias("replaced"), F.xxhash64("key", at, left).alias("variant"))

    nothing = F.array().cast("array<struct<replaced:boolean,variant:bigint>>")
    whole = F.when(F.col("short"), F.array(F.struct(F.lit(False).alias("replaced"), F.xxhash64("key", F.lit(-1), "units").alias("variant")))).otherwise(nothing)
    return rest.select("rank", "short", F.inline(F.array_distinct(F.concat(whole, F.transform(F.sequence(F.lit(0), size - 1), without)))))


def _nearest(spark: SparkSession, lines: DataFrame, distinct: DataFrame) -> DataFrame:
    """first, h1, nearest: the earliest line within the bound, for lines that have one."""
    # lines with all but one block in common with another, once for each such block
    count = F.col("count")
    blocks = distinct.filter("count is not null").select("first", "h1", "by_word", "count", F.posexplode("keys").alias("i", "key")).filter("key is not null")
    common = blocks.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    own = _blocks(count)
    near = blocks.join(common, "key", "left_semi").select("first", "h1", "by_word", "count", "key", F.when(F.col("i") < own, count).otherwise(count - 1).alias("cut"), F.when(F.col("i") < own, F.col("i")).otherwise(F.col("i") - own).alias("block"))
    near = scratch(spark, near, "near_lines")

    sought = near.select("first", "by_word", F.col("h1").alias("_h1"), F.col("first.doc_id").alias("_doc"), F.col("first.line_no").alias("_line")).distinct()
    at = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("line_no") == F.col("_line")) & (F.col("h1") == F.col("_h1"))
    texts = lines.withColumn("h1", F.xxhash64("line")).join(sought, at).select("first", "h1", "by_word", "line").dropDuplicates(["first", "h1"])
    # a number in the order of places: ranges of places go to partitions in that order, and each is sorted
    texts = texts.repartitionByRange("first", "h1").sortWithinPartitions("first", "h1").select(F.monotonically_increasing_id().alias("rank"), "first", "h1", "by_word", "line")
    texts = scratch(spark, texts, "near_texts")

    variants = scratch(spark, _variants(near.drop("by_word").join(texts, ["first", "h1"])), "variants")
    met = variants.groupBy("variant").agg(F.min(F.when(F.col("short"), F.col("rank"))).alias("shorter"), F.min(F.when(~F.col("short"), F.col("rank"))).alias("longer"), F.max("rank").alias("last"))
    met = met.filter(F.col("last") > F.least("shorter", "longer")).drop("last")
    other = F.when(F.col("replaced") | ~F.col("short"), F.col("shorter")).otherwise(F.col("longer"))
    pairs = variants.join(met, "variant").select("rank", other.alias("other")).filter("other < rank").distinct()
    earlier = texts.select(F.col("rank").alias("other"), F.col("first").alias("_first"), F.col("line").alias("_line"))
    checked = pairs.join(texts, "rank").join(earlier, "other").filter("_first < first")
    return checked.filter(verified(F.col("line"), F.col("_line"), F.col("by_word"))).groupBy("first", "h1").agg(F.min("_first").alias("nearest"))


def duplicate_lines(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row for each line: doc_id, line_no, kept, keep_doc_id, keep_line_no (the earliest line within the bound, or itself)."""
    lines = lines_of(documents, doc_id, text)
    hashed = scratch(spark, _hashed(lines, min_words, min_chars), "lines")
    full = hashed.filter("not blank")
    distinct = full.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("by_word", "count", "keys")])
    distinct = scratch(spark, distinct, "distinct_lines")
    nearest = scratch(spark, _nearest(spark, lines, distinct), "nearest_lines")

    total = distinct.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") * HOT >= total
    stays = F.coalesce("nearest", "first").alias("stays")
    decided = distinct.select("h1", "h2", "first", "n").join(nearest, ["first", "h1"], "left").select("h1", "h2", "n", stays)
    # at most a thousand lines make up a thousandth each
    often = F.broadcast(distinct.filter(hot).select("h1", "h2", "first").join(nearest, ["first", "h1"], "left").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), stays))
    of_often = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    places = ["doc_id", "line_no", "stays"]
    rare = full.select("doc_id", "line_no", "h1", "h2").join(often, of_often, "left_anti").join(decided.filter(~hot), ["h1", "h2"]).select(*places)
    blank = hashed.filter("blank").select("doc_id", "line_no", F.struct("doc_id", "line_no").alias("stays"))
    out = rare.unionByName(full.join(often, of_often).select(*places)).unionByName(blank)
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("line_no") == F.col("stays.line_no"))
    return out.select("doc_id", "line_no", kept.alias("kept"), F.col("stays.doc_id").alias("keep_doc_id"), F.col("stays.line_no").alias("keep_line_no"))


def without_duplicates(documents: DataFrame, decisions: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the lines that went taken out of ``text``; other columns stay as they are."""
    gone = decisions.filter("not kept").groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_set("line_no").alias("_gone"))
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains(F.col("_gone"), i)), "\n")
    return documents.join(gone, F.col(doc_id).eqNullSafe(F.col("_doc")), "left").withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(left)).drop("_doc", "_gone")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(spark, read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
d0 AS (SELECT line, min((doc_id, line_no)) AS first, string_split(line, ' ') AS words FROM l WHERE trim(replace(replace(line, chr(9), ' '), chr(13), ' ')) <> '' GROUP BY line),
f AS (SELECT line, first, len(words) >= 10 AS by_word, CASE WHEN len(words) >= 10 THEN words WHEN length(line) >= 10 THEN list_transform(range(1, length(line) + 1), lambda i: substr(line, i, 1)) END AS w FROM d0),
v AS (
  SELECT line, first, by_word, -1 AS at, w AS var, true AS whole FROM f WHERE w IS NOT NULL
  UNION ALL
  SELECT line, first, by_word, p, list_concat(w[1:p], w[p + 2:len(w)]), false FROM (SELECT *, unnest(range(len(w))) AS p FROM f WHERE w IS NOT NULL)),
pairs AS (
  SELECT DISTINCT a.first AS first, b.first AS other FROM v a JOIN v b ON a.var = b.var AND a.by_word = b.by_word AND a.first > b.first
  WHERE (a.at = b.at AND NOT a.whole AND NOT b.whole) OR (a.whole <> b.whole)),
n AS (SELECT first, min(other) AS nearest FROM pairs GROUP BY first),
d AS (SELECT d0.line, coalesce(n.nearest, d0.first) AS stays FROM d0 LEFT JOIN n ON d0.first = n.first)
SELECT l.doc_id, l.line_no::INTEGER AS line_no, coalesce((l.doc_id, l.line_no) = d.stays, true) AS kept,
  coalesce(d.stays[1], l.doc_id) AS keep_doc_id, coalesce(d.stays[2], l.line_no)::INTEGER AS keep_line_no
FROM l LEFT JOIN d ON l.line = d.line
"""
