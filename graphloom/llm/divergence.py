"""How far the wording of each source of a language is from the others, by sketch-prefiltered counting.

A language keeps the terms that at least ``least`` of its documents hold. Most distinct terms
are rarer than that, and counting them exactly would mean shuffling them all:

1. Each task counts, in a count-min sketch, the documents that hold a term of a language. Cells
   stop at 255, so a task's sketch is a bounded number of bytes; sketches are merged by
   adding cells slice by slice, one row at a time.
2. The merged sketch is broadcast (its size is a parameter, not the data's). A cell is never less than
   the number of documents of any term in it, so a term with a cell below ``least`` cannot be
   kept and goes before the shuffle. A sketch that fills up lets more terms through and changes no result.
3. What is left is counted exactly, by language, source and term; terms of too few documents go.
4. Shares are integers, ``1 + floor(SCALE (count + 1) / (N + V))``. How far a source's share p of a term is
   from another's share q is ``floor((p - q)^2 / q)``. Its sum over all kept terms is made of sparse parts: the terms
   of one source against the other's share of an absent term (by a histogram of the source's
   counts), likewise the other way round, the terms of both (a join of the term rows that occur), and a
   constant times the number of terms of neither.

All arithmetic is exact. Defined results: null texts, languages and sources are read as empty
ones, a value like any other; a document without terms still makes its source occur; repeated rows
are documents of their own; a language without kept terms has pairs of value 0 and no
terms; a source alone in its language has no pairs; ties go by the item's bytes; an empty table gives an
empty result. Texts are read whole, whatever their length; only text, lang and source are read, so further
columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read, scratch, small_batches

#: Cells of a row of the sketch; each term has one in each of two rows.
CELLS = 1 << 21
SLICE = 1 << 16
#: Entries that a task holds before it hands them on, and rows that it hands on at once.
HELD, ROWS = 2_000_000, 50_000
SCALE = 1_000_000_000
#: How many terms of a source are reported.
RANKS = 200
#: Documents of its language that a kept term needs.
LEAST = 3

#: Bytes as terms see them: A-Z lower-cased, other ASCII but a-z a gap, bytes of longer characters as they are.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in order: runs of letters a-z and of all characters beyond ASCII, A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _cells(lang: bytes, terms: list[bytes], cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each term in the first and in the second row of the sketch."""
    from xxhash import xxh3_64_intdigest

    lead = lang + b"\n"
    h = np.fromiter((xxh3_64_intdigest(lead + t) for t in terms), np.uint64, len(terms))
    return (h & np.uint64(cells - 1)).astype(np.int64), (h >> np.uint64(32) & np.uint64(cells - 1)).astype(np.int64)


def _added(sketch: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
    total = np.bincount(at, counts, sketch.size)
    np.minimum(total + sketch, 255, out=total)
    sketch[:] = total.astype(np.uint8)


def sketch_of(rows: DataFrame, cells: int = CELLS) -> np.ndarray:
    """The merged sketch, two rows of ``cells`` bytes: at each cell, how many documents hold a term of it, 255 for more."""
    size = min(SLICE, cells)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((2, cells), np.uint8)
        held: dict[str, Counter] = {}

        def flush() -> None:
            for lang, seen in held.items():
                counts = np.fromiter(seen.values(), np.int64, len(seen))
                for row, at in zip(sketch, _cells(lang.encode(), list(seen), cells), strict=True):
                    _added(row, at, counts)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(set(terms_of(text)))
            if sum(map(len, held.values())) > HELD // 5:
                flush()
        flush()
        flat = sketch.ravel()
        for at in range(0, flat.size, size):
            if (part := flat[at : at + size]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at // size], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["slice", "cells"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for number, part in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                total[number] = np.minimum(total.get(number, 0) + np.frombuffer(part, np.uint8).astype(np.uint16), 255)
        for number, part in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([part.astype(np.uint8).tobytes()], pa.binary())], names=["slice", "cells"])

    kind = "slice int, cells binary"
    out = np.zeros(2 * cells, np.uint8)
    for r in rows.mapInArrow(task, kind).repartition("slice").mapInArrow(merge, kind).collect():  # two rows of cells in all
        out[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["cells"], np.uint8)
    return out.reshape(2, cells)


def _tallies(texts: list[str], group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of some texts; and for each group and term (by its number) that occurs, how often and in how many texts."""
    plain = pa.array([t.encode("utf-8", "surrogatepass").translate(_BYTES) for t in texts], pa.large_binary()).cast(pa.large_string())
    split = pc.ascii_split_whitespace(plain)
    found = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts)), np.diff(split.offsets.to_numpy()))
    size = max(1, len(found.dictionary))
    number = found.indices.to_numpy().astype(np.int64)
    real = pc.binary_length(found.dictionary).to_numpy()[number] > 0 if number.size else np.zeros(0, bool)  # white space at an end leaves an empty part
    held, times = np.unique(doc[real] * size + number[real], return_counts=True)
    key = group[held // size] * size + held % size
    order = np.argsort(key, kind="stable")
    key, times = key[order], times[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    counts = np.add.reduceat(times, first) if first.size else np.zeros(0, np.int64)
    return found.dictionary, key[first] // size, key[first] % size, counts, np.diff(first, append=key.size)


def _summed(rows: np.ndarray) -> np.ndarray:
    """Rows (language and term, source, count, docs), sorted, those of the same first two added up."""
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    first = np.flatnonzero((np.diff(rows[0], prepend=-1) != 0) | (np.diff(rows[1], prepend=-1) != 0))
    return np.stack([rows[0][first], rows[1][first], np.add.reduceat(rows[2], first), np.add.reduceat(rows[3], first)]) if first.size else rows


def counts_of(rows: DataFrame, sketch, least: int) -> DataFrame:
    """lang, term, sources (array of source, count, docs): partial sums of terms that the sketch (a broadcast) lets through."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sketch.value
        sources: dict[str, int] = {}
        terms: dict[tuple[str, str], int] = {}
        held: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            total = _summed(np.concatenate(held, axis=1))
            names = list(terms)
            open_ = np.zeros(len(names), bool)
            by_lang: dict[str, list[int]] = {}
            for k, (lang, _) in enumerate(names):
                by_lang.setdefault(lang, []).append(k)
            for lang, numbers in by_lang.items():
                first, second = _cells(lang.encode("utf-8", "surrogatepass"), [names[k][1].encode("utf-8", "surrogatepass") for k in numbers], cells.shape[1])
                open_[numbers] = np.minimum(cells[0][first], cells[1][second]) >= min(least, 255)
            total = total[:, open_[total[0]]]
            first = np.flatnonzero(np.diff(total[0], prepend=-1))
            kept = total[0][first].tolist()
            inner = pa.StructArray.from_arrays([pa.array(list(sources), pa.string()).take(pa.array(total[1])), pa.array(total[2]), pa.array(total[3])], ["source", "count", "docs"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(first, total.shape[1]).astype(np.int32)), inner)
            out = pa.RecordBatch.from_arrays([pa.array([names[k][0] for k in kept], pa.string()), pa.array([names[k][1] for k in kept], pa.string()), lists], names=["lang", "term", "sources"])
            held.clear()
            terms.clear()
            for at in range(0, out.num_rows, ROWS):
                yield out.slice(at, ROWS)

        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
            groups = {g: k for k, g in enumerate(dict.fromkeys(pairs))}
            words, group, number, count, docs = _tallies(batch.column("text").to_pylist(), np.array([groups[g] for g in pairs]))
            langs = {lang: k for k, lang in enumerate(dict.fromkeys(lang for lang, _ in groups))}
            lang_of, source_of = np.array([langs[g] for g, _ in groups]), np.array([sources.setdefault(s, len(sources)) for _, s in groups])
            size = max(1, len(words))
            own, back = np.unique(lang_of[group] * size + number, return_inverse=True)
            by_number, text = list(langs), words.to_pylist()
            at = np.fromiter((terms.setdefault((by_number[k // size], text[k % size]), len(terms)) for k in own.tolist()), np.int64, own.size)
            held.append(np.stack([at[back], source_of[group], count, docs]))
            if sum(x.shape[1] for x in held) > HELD:
                held[:] = [_summed(np.concatenate(held, axis=1))]
                if held[0].shape[1] > HELD // 2:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(task, "lang string, term string, sources array<struct<source: string, count: bigint, docs: bigint>>")


def _share(count: Column, n: Column, v: Column) -> Column:
    """``1 + floor(SCALE (count + 1) / (n + v))``; the product may be beyond 64 bits."""
    wide = "decimal(38,0)"
    return (1 + F.call_function("div", (count + 1).cast("decimal(19,0)").cast(wide) * F.lit(SCALE).cast("decimal(10,0)"), (n + v).cast(wide))).cast("long")


def _far(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``; shares are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def divergences(spark: SparkSession, documents: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, ranks: int = RANKS, cells: int = CELLS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank."""
    small_batches(spark)
    rows = documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(to) for c, to in ((text, "text"), (lang, "lang"), (source, "source"))])
    shared = spark.sparkContext.broadcast(sketch_of(rows.select("lang", "text"), cells))
    counted = counts_of(rows, shared, least).repartition("lang", "term").select("lang", "term", F.inline("sources"))
    # dealt by language and term, rows stay where they are for the sums by source and those over sources
    counted = counted.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counted.withColumn("in_lang", F.sum("count").over(of_term)).withColumn("docs", F.sum("docs").over(of_term)).filter(F.col("docs") >= least).drop("docs")
    kept = scratch(spark, kept, "kept")

    sources = rows.select("lang", "source").distinct()
    by_source = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("terms"))
    by_lang = kept.groupBy("lang", "term").agg(F.first("in_lang").alias("in_lang")).groupBy("lang").agg(F.sum("in_lang").alias("n_lang"), F.count("*").alias("v"))
    groups = sources.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n", "terms", "n_lang", "v"])
    absent = F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v")))
    groups = scratch(spark, groups.withColumn("p0", absent), "groups")  # one row a source

    totals = groups.select("lang", "source", "n", "v", "n_lang", "p0")
    shares = kept.join(totals, ["lang", "source"]).withColumn("p", _share(F.col("count"), F.col("n"), F.col("v")))
    value, item = F.col("value"), F.col("item")
    q = _share(F.col("in_lang"), F.col("n_lang"), F.col("v"))
    above = shares.withColumn("q", q).filter(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), _far(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(value.desc(), item)
    best = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)

    # pairs of sources: the terms of one against the other's absent share, by equal counts
    mine = groups.select("lang", "source", "terms", "v", "p0")
    other = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("other_terms"), F.col("p0").alias("q0"))
    pairs = mine.join(other, "lang").filter(F.col("source") != item)  # as many rows as the result has
    alike = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    one = alike.join(other, "lang").filter(F.col("source") != item).groupBy("lang", "source", "item").agg(F.sum(F.col("times") * _far(F.col("p"), F.col("q0"))).alias("one"))
    turned = alike.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "times").join(mine.select("lang", "source", "p0"), "lang").filter(F.col("source") != item)
    two = turned.groupBy("lang", "source", "item").agg(F.sum(F.col("times") * _far(F.col("p0"), F.col("q"))).alias("two"))
    left = shares.select("lang", "term", "source", "p", "p0")
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).filter(F.col("source") != item)
    more = _far(F.col("p"), F.col("q")) - _far(F.col("p"), F.col("q0")) - _far(F.col("p0"), F.col("q"))
    both = both.groupBy("lang", "source", "item").agg(F.count("*").alias("common"), F.sum(more).alias("more"))
    on = ["lang", "source", "item"]
    pairs = pairs.join(one, on, "left").join(two, on, "left").join(both, on, "left").na.fill(0, ["one", "two", "common", "more"])
    neither = F.col("v") - F.col("terms") - F.col("other_terms") + F.col("common")
    summed = F.col("one") + F.col("two") + F.col("more") + F.coalesce(neither * _far(F.col("p0"), F.col("q0")), F.lit(0))
    pairs = pairs.select("lang", "source", "item", summed.alias("value")).withColumn("rank", F.row_number().over(order))

    out = pairs.withColumn("part", F.lit("pair")).unionByName(best.withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", value.cast("long").alias("value"), "rank")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spark, read(spark, sf_dir, "documents"))


OP12_SQL = r"""WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS terms FROM documents),
found AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
counted AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY ALL HAVING count(DISTINCT d) >= 3),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (SELECT g.lang, g.source, sum(CASE WHEN k.term IS NULL THEN 0 ELSE c.n END) AS n FROM groups g LEFT JOIN counted c USING (lang, source) LEFT JOIN kept k USING (lang, term) GROUP BY ALL),
shares AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(g.n, 0) + s.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.n + 1)) // (s.n + s.v)::HUGEINT AS q
    FROM totals g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
