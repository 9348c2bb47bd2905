"""Table operators around extraction: resuming, first and last wins, samples, shards and statistics."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import md5
from graphloom.operators.traverse import hash_order
from graphloom.runtime import materialise

#: Titles whose hashes with another are worked out at a time.
PACK = 32_768


def remaining(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """What has no row in ``done`` yet."""
    return rows.join(done.select(key), key, "left_anti").select(*rows.columns)


def first_wins(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """Of rows with one key the first in the order stays; max_by merges before the shuffle, so a hot key is one row a task."""
    return _wins(rows, key, F.min_by, order)


def last_wins(rows: DataFrame, key: str, *order: str | Column) -> DataFrame:
    return _wins(rows, key, F.max_by, order)


def _wins(rows: DataFrame, key: str, pick, order) -> DataFrame:
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy(key).agg(pick(whole, F.struct(*order)).alias("_row")).select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns])



def dealt_sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows by a seeded hash order of the key."""
    return rows.orderBy(hash_order(key, seed=seed), key).limit(n)


def few_shot(rows: DataFrame, examples: DataFrame, k: int, key: str = "id", example_key: str = "example_id", seed: int = 0, most_examples: int = 1000) -> DataFrame:
    """key, example_ids: ``k`` distinct examples for each row, by a hash order of their own. The pool of examples is bounded and goes along as one array."""
    pool = [r[0] for r in examples.select(example_key).distinct().limit(most_examples + 1).collect()]
    if len(pool) > most_examples:
        raise ValueError(f"more than {most_examples} examples")
    kind = examples.schema[example_key].dataType.simpleString()
    choices = F.array(*[F.lit(p).cast(kind) for p in pool]) if pool else F.array().cast(f"array<{kind}>")
    drawn = F.array_sort(F.transform(choices, lambda e: F.struct(F.md5(F.concat_ws(":", F.col(key), e, F.lit(str(seed)))).alias("h"), e.alias("e"))))
    return rows.select(key, F.transform(F.slice(drawn, 1, k), lambda x: x["e"]).alias("example_ids"))


def negative_pairs(vertices: DataFrame, edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` ordered pairs of distinct titles that are no edge, by hash order; self pairs count as candidates.

    The order is that of a hash of each pair, so all pairs are hashed, but only those below a cut are kept: hashes are spread evenly, so a cut
    that some more than ``n`` should be below is known beforehand. It is raised where they were too few. Packs of titles meet in tasks that
    work out the beginnings of hashes in numpy; Spark's own hash decides on the few pairs that these let through.
    """
    titles, known = materialise(vertices.select("title").distinct(), "titles"), edges.select("src", "dst").distinct()
    many, order = titles.count(), hash_order("src", "dst", seed=seed)
    least = 2 * max(n, 0) + 100
    placed, width = None, 4 * titles.sparkSession.sparkContext.defaultParallelism
    ends = lambda x, y: x.withColumnRenamed("title", "src").repartition(width).crossJoin(F.broadcast(y.withColumnRenamed("title", "dst")))
    while True:
        below = many * many <= 4 * least  # all of them
        if below:
            pairs = ends(titles, titles)
        else:
            cut = (least << 64) // (many * many)
            if placed is None:  # titles of a length are hashed side by side
                placed = numbered(titles.filter("title is not null"), F.octet_length("title"), "title")
                pack = lambda size, name: placed.groupBy(F.floor(F.col("at") / size).alias(f"{name}_pack")).agg(F.collect_list("title").alias(name))
                left, right = materialise(pack(PACK // 64, "src"), "packs"), materialise(pack(PACK, "dst"), "packs")
            packs = left.repartition(max(width, min(left.count(), 2000))).crossJoin(F.broadcast(right)).select("src", "dst")
            pairs = packs.mapInArrow(_hashed_below(cut >> 32, f":{seed}".encode()), "src string, dst string")
            none = titles.filter("title is null")  # one at most
            pairs = pairs.unionByName(ends(titles, none)).unionByName(ends(none, titles.filter("title is not null"))).filter(order < F.lit(f"{cut:016x}"))
        found = materialise(pairs, "below").join(known, ["src", "dst"], "left_anti")
        if below or found.count() >= n:
            return found.orderBy(order, "src", "dst").limit(n)
        least *= 8


def _hashed_below(most: int, tail: bytes):
    """A task over packs (src, dst) that gives the pairs of which the first 32 bits of the hash of ``src:dst`` and ``tail`` are at most ``most``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                mine, theirs = (batch.column(c)[k].values for c in ("src", "dst"))
                by_size: dict[int, list[tuple[int, bytes]]] = {}
                for j, title in enumerate(theirs.to_pylist()):
                    title = title.encode()
                    by_size.setdefault(len(title), []).append((j, title))
                sets = [(np.array([j for j, _ in same]), md5.Ends([title for _, title in same], tail)) for same in by_size.values()]
                i, j = [], []
                for at, title in enumerate(mine.to_pylist()):
                    for places, ends in sets:
                        hit = places[ends.heads(title.encode() + b":") <= most]
                        i += [at] * len(hit)
                        j += hit.tolist()
                if i:
                    yield pa.RecordBatch.from_arrays([mine.take(pa.array(i)), theirs.take(pa.array(j))], names=["src", "dst"])

    return task


def balanced_batch(positives: DataFrame, negatives: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """src, dst, label: half positives, half negatives."""
    take = lambda f, n, y: f.select("src", "dst").orderBy(hash_order("src", "dst", seed=seed), "src", "dst").limit(n).withColumn("label", F.lit(y))
    return take(positives, size - size // 2, 1).unionByName(take(negatives, size // 2, 0))


def without_share(rows: DataFrame, share: float, *keys: str, seed: int = 0) -> DataFrame:
    """Without ``int(share * n)`` rows, chosen by hash order."""
    many = int(share * rows.count())
    placed = numbered(rows.select(*keys).distinct(), hash_order(*keys, seed=seed), *keys, name="_place")  # no task sees all of them
    gone = placed.filter(F.col("_place") < many).drop("_place")
    return rows.join(gone, list(keys), "left_anti").select(*rows.columns)


def numbered(rows: DataFrame, *order: str | Column, name: str = "at") -> DataFrame:
    """Adds ``at``: the place from 0 in a total order.

    Range partitions are sorted, and counts of earlier partitions are added: no single task sees all rows.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    spread = materialise(spread, "numbered")
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row a partition
    return spread.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def running(rows: DataFrame, order: Column, *values: str) -> DataFrame:
    """Each of ``values`` in place replaced by its running sum in an order without ties.

    Sorted ranges are summed up side by side, and the sums of earlier ranges are added.
    """
    spread = materialise(rows.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "running")
    totals = spread.groupBy("_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = totals.select("_part", *[F.coalesce(F.sum(f"_{v}").over(earlier), F.lit(0)).alias(f"_{v}") for v in values])
    own = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    inside = spread.select("_part", *[(F.sum(c).over(own) if c in values else F.col(c)).alias(c) for c in rows.columns])
    return inside.join(F.broadcast(before), "_part").select(*[(F.col(c) + F.col(f"_{c}") if c in values else F.col(c)).alias(c) for c in rows.columns])


def shards(rows: DataFrame, text: Column, size: int, *order: str | Column) -> DataFrame:
    """shard, text: so many texts each, in order, joined by a newline."""
    placed = numbered(rows.withColumn("_text", text), *order).withColumn("shard", F.floor(F.col("at") / size))
    return placed.groupBy("shard").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "_text"))), lambda x: x["_text"]), "\n").alias("text"))


def quantiles(rows: DataFrame, value: Column, at: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row: quantiles (linear interpolation) and mean."""
    return rows.agg(F.percentile(value, F.array(*[F.lit(p) for p in at])).alias("quantiles"), F.avg(value).alias("mean"))


def path_statistics(samples: DataFrame, paths: str = "paths") -> DataFrame:
    """Two rows: quantiles and mean of paths a document, and of vertices a path."""
    a = quantiles(samples, F.size(paths)).withColumn("what", F.lit("paths_per_document"))
    b = quantiles(samples.select(F.explode(paths).alias("p")), F.size("p")).withColumn("what", F.lit("path_length"))
    return a.unionByName(b).select("what", "quantiles", "mean")


def edge_coverage(samples: DataFrame, edges: DataFrame, paths: str = "paths") -> DataFrame:
    """One row: n_edges, n_unused and the share of edges that lie on no path."""
    from graphloom.functions.text import adjacent_pairs

    used = samples.select(F.explode(paths).alias("p")).select(F.inline(adjacent_pairs(F.col("p")))).distinct().withColumn("used", F.lit(1))
    out = edges.select("src", "dst").distinct().join(used, ["src", "dst"], "left").agg(F.count("*").alias("n_edges"), F.count_if(F.col("used").isNull()).alias("n_unused"))
    return out.withColumn("unused", F.coalesce(F.try_divide(F.col("n_unused").cast("double"), F.col("n_edges").cast("double")), F.lit(0.0)))


def corpus_statistics(pages: DataFrame, page_category: DataFrame, text: str = "abstract") -> DataFrame:
    """One row: n_pages, n_chars, chars_per_page, chars_per_node, n_tokens (a quarter of the characters)."""
    sizes = pages.select("page_id", F.length(text).alias("n"))
    total = sizes.agg(F.count("*").alias("n_pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chars"), F.avg("n").alias("chars_per_page"))
    nodes = page_category.join(sizes, "page_id").groupBy("node_id").agg(F.sum("n").alias("n")).agg(F.avg("n").alias("chars_per_node"))
    return total.join(nodes).withColumn("n_tokens", F.col("n_chars") / 4)  # one row each


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """column, n of values that occur more than once."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def shares(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Adds ``share``: the value's part of its group's sum."""
    totals = rows.groupBy(group).agg(F.sum(value).alias("_total"))
    return rows.join(totals, group).withColumn("share", F.try_divide(F.col(value).cast("double"), F.col("_total").cast("double"))).drop("_total")


def growth(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """at, n: how many distinct keys the rows up to each place hold; places are those at which a new key comes."""
    first = numbered(rows, *order).groupBy(key).agg(F.min("at").alias("at"))
    new = first.groupBy("at").agg(F.count("*").alias("n"))
    return running(new, F.col("at"), "n")


def members(rows: DataFrame, key: str, payload: list[str], item: str) -> DataFrame:
    """One row a key: the payload of its smallest item, and all items, sorted."""
    kept = F.min_by(F.struct(*payload), F.col(item)).alias("_p")
    return rows.groupBy(key).agg(kept, F.array_sort(F.collect_set(item)).alias("items")).select(key, *[F.col(f"_p.{p}").alias(p) for p in payload], "items")


def full_outer(a: DataFrame, b: DataFrame, key: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """All keys of both sides, other columns with a suffix."""
    renamed = lambda f, s: f.select(key, *[F.col(c).alias(c + s) for c in f.columns if c != key])
    return renamed(a, suffixes[0]).join(renamed(b, suffixes[1]), key, "full")


def matching(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns all have the given values."""
    return rows.filter(reduce(lambda c, kv: c & (F.col(kv[0]) == kv[1]), values.items(), F.lit(True)))


def query_one(rows: DataFrame, **values):
    """The first match, or an error."""
    found = matching(rows, **values).limit(1).collect()
    if not found:
        raise ValueError(f"nothing matches {values}")
    return found[0]


def long_form(rows: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """Wide to long: variable, value."""
    return rows.unpivot(ids, values, "variable", "value")


def fits(rows: DataFrame, ids: str, most: int) -> DataFrame:
    """Rows whose token list is no longer than ``most``."""
    return rows.filter(F.size(ids) <= most)
