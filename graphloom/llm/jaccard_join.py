"""N-gram Jaccard self-join by a token-group matrix.

A document's tokens are its distinct word shingles, hashed to 64 bits. Two sets
link when their Jaccard similarity reaches a threshold; the result is each
document's linked component. The work goes in steps that each grow with the input:

1. Sets with the same content are one (by a 64-bit key), so copies cost nothing more.
2. A sketch counts tokens. In a fixed order, rare tokens first, each set gives its first
   ``n - ceil(t n) + 1`` tokens, and only those that two sets share live on. Two sets of sizes
   n and m that link share at least ``ceil(t / (1 + t) (n + m)) - ceil(t max(n, m)) + 1`` of these.
3. Sets are partitioned into groups by the most widely shared token they have, and by size. The
   token-group matrix holds, for each shared token, the groups whose members have it. How many of its
   tokens a group's column holds bounds what a set can share with any member, so a set and
   a group qualify only if that reaches the least number for the sizes there are. Only sets with a
   qualifying group have their tokens fetched.
4. Each is compared with its group's pivot; what links is settled. Then qualifying groups are opened:
   by unsettled sets their own, by all sets those of others, in the direction of the larger group.
5. A group is opened chunk by chunk: the overlap of the query with the chunk's whole token union
   bounds its overlap with every member, and only where that reaches the threshold
   are members' overlaps counted, all at once.
6. Components come from alternating large-star and small-star steps.

The sketch only sets an order, so its errors cost time and never a link. Hot
tokens, pivots and groups are split by a salt or into chunks.

Equal 64-bit hashes are taken for equal shingles and sets. Defined results: a null
text, or one without words, has no shingles and is linked with nothing; fewer words
than a shingle make one token together; rows that repeat an id are separate rows of
one component if their texts link; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import read, scratch, small_batches

WORDS = 5
#: The threshold as a fraction: 100 * intersection >= 80 * union.
OVER, UNDER = 80, 100
SKETCH = 1 << 18
SLICE = 1024
#: Bits of the filter that keeps sets without partners from being shuffled; one that fills up only keeps fewer back.
FILTER_BITS = 1 << 24
CHUNK = 256
SALTS, SALT_ROWS = 4096, 4000
#: Sizes in a group differ by at most this factor.
SIZE_STEP = 1.05
#: Bytes of a text that are hashed at once.
SPAN = 1 << 20

BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def powers(base: int) -> np.ndarray:
        out = np.full(SPAN + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


@cache
def _bytes() -> np.ndarray:
    """A random number for each byte, capital letters as small ones."""
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    table[65:91] = table[97:123]
    return table


def word_hashes(text: str) -> np.ndarray:
    """A hash for each word ``[^ \\t-\\r]+``, A-Z lower-cased."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not starts.size:
        return np.zeros(0, np.uint64)
    up, down = _powers()
    out = np.empty(starts.size, np.uint64)
    first = 0
    while first < starts.size:  # as many words as fit a span; a longer word is hashed in pieces
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + SPAN, side="right")))
        s, e = starts[first:last] - origin, ends[first:last] - origin
        part = _bytes()[raw[origin : origin + e[-1]]]
        if e[-1] > SPAN:
            h = np.uint64(0)
            for at in range(0, int(e[-1]), SPAN):
                piece = part[at : at + SPAN]
                h = mix(np.array([h + (piece * up[: piece.size]).sum(dtype=np.uint64)]))[0]
            out[first] = h
        else:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * up[: part.size], dtype=np.uint64)])
            out[first:last] = (total[e] - total[s]) * down[s]
        first = last
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of word shingles, as signed 64-bit numbers."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not w.size:
        return np.zeros(0, np.int64)
    size = min(words, w.size)
    h = np.full(w.size - size + 1, size, np.uint64)
    for k in range(size):
        h = mix(h * np.uint64(0x9FB21C651E98DF25) + w[k : k + h.size])
    return np.unique(h.view(np.int64))


def set_key(tokens: np.ndarray) -> int:
    """A 64-bit key of a whole set."""
    h = tokens.view(np.uint64)
    whole = np.array([(mix(h + np.uint64(0x632BE59BD9B4E019))).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(mix(h)) + np.uint64(h.size)])
    return int(mix(whole).view(np.int64)[0])


def _sets(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    for text in batch.column("text").to_pylist():
        yield shingles(text, words)


def keys_and_counts(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, n, key; and rows of the sketch, told apart by a slice number."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(SKETCH, np.int64), set()
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64())]
        names = ["doc_id", "n", "key", "slice", "counts"]
        for batch in batches:
            sizes, keys = [], []
            for tokens in _sets(batch, words):
                key = set_key(tokens) if tokens.size else None
                if key is not None and key not in seen:
                    np.add.at(total, tokens & (SKETCH - 1), 1)
                    if len(seen) < 1_000_000:
                        seen.add(key)
                sizes.append(tokens.size)
                keys.append(key)
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip((sizes, keys, none, none), kinds[1:], strict=True))], names=names)
        for at in range(0, SKETCH, SLICE * 16):
            numbers = range(at // SLICE, at // SLICE + 16)
            none = [None] * 16
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((none, none, none, list(numbers), [total[i * SLICE : (i + 1) * SLICE] for i in numbers]), kinds, strict=True)], names=names)

    return documents.mapInArrow(task, "doc_id long, n long, key long, slice int, counts array<long>")


def prefixes(documents: DataFrame, words: int, over: int, under: int, sketch) -> DataFrame:
    """token, key, salt: the first tokens of each set, rare ones first; ``salt`` is 0 but for the very common, which it spreads."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = sketch.value, set()
        limit = 2 * counts.mean() + 10_000
        for batch in batches:
            tokens_out, keys_out, salts_out = [], [], []
            for tokens in _sets(batch, words):
                if not tokens.size or (key := set_key(tokens)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(key)
                common = counts[tokens & (SKETCH - 1)]
                need = -(-over * tokens.size // under)
                first = np.lexsort((tokens, common))[: tokens.size - need + 1]
                tokens_out.append(tokens[first])
                keys_out.append(np.full(first.size, key, np.int64))
                salts_out.append(np.where(common[first] > limit, 1 + key % SALTS, 0).astype(np.int32))
            if tokens_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens_out, keys_out, salts_out)], names=["token", "key", "salt"])

    return documents.mapInArrow(task, "token long, key long, salt int")


def wanted_sets(documents: DataFrame, words: int, wanted) -> DataFrame:
    """key, n, tokens (bytes) of sets that pass the filter, one for each task and key."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = wanted.value, set()
        for batch in batches:
            keys, sizes, held = [], [], []
            for tokens in _sets(batch, words):
                if not tokens.size or (key := set_key(tokens)) in seen:
                    continue
                at = key & (FILTER_BITS - 1)
                if bits[at >> 3] >> (at & 7) & 1:
                    if len(seen) < 1_000_000:
                        seen.add(key)
                    keys.append(key)
                    sizes.append(tokens.size)
                    held.append(tokens.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(held, pa.binary())], names=["key", "n", "tokens"])

    return documents.mapInArrow(task, "key long, n long, tokens binary")


def _links(shared: np.ndarray | int, a: int, b: np.ndarray | int, over: int, under: int):
    return under * shared >= over * (a + b - shared)


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if a.size > b.size:
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), b.size - 1)] == a).sum())


def _pivot_task(over: int, under: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pivot and salt, the pivot's own first."""
        held = None
        for batch in batches:
            a, b = [], []
            for pivot, role, key, tokens in zip(*(batch.column(c).to_pylist() for c in ("pivot", "role", "key", "tokens")), strict=True):
                found = np.frombuffer(tokens, np.int64)
                if role == 0:
                    held = found
                elif _links(_overlap(held, found), held.size, found.size, over, under):
                    a.append(key)
                    b.append(pivot)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return task


def _group_task(over: int, under: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group and chunk, members before queries. Of the links to labels, those are given out that join what a chunk's earlier ones have not: a forest."""
        at = union = tokens = owner = sizes = None
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        members: list[np.ndarray] = []
        labels: list[int] = []
        for batch in batches:
            a, b = [], []
            for group, chunk, role, label, held in zip(*(batch.column(c).to_pylist() for c in ("grp", "chunk", "role", "label", "tokens")), strict=True):
                found = np.frombuffer(held, np.int64)
                if at != (group, chunk):
                    at, members, labels, union = (group, chunk), [], [], None
                    parent.clear()
                if role == 0:
                    members.append(found)
                    labels.append(label)
                    continue
                if not members:
                    continue
                if union is None:
                    tokens = np.concatenate(members)
                    owner = np.repeat(np.arange(len(members)), [m.size for m in members])
                    sizes = np.array([m.size for m in members])
                    union = np.unique(tokens)
                if under * _overlap(union, found) < over * found.size:  # no member can reach it
                    continue
                place = np.minimum(np.searchsorted(found, tokens), found.size - 1)
                shared = np.bincount(owner[found[place] == tokens], minlength=len(members))
                for other in {labels[i] for i in np.flatnonzero(_links(shared, found.size, sizes, over, under))}:
                    x, y = root(label), root(other)
                    if x != y:
                        parent[x] = y
                        a.append(label)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return task


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges`` (a, b)."""
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = scratch(spark, now, "edges"), None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch(spark, small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _filter_of(spark: SparkSession, keys: DataFrame):
    """A broadcast bit set of fixed size with a bit for each key."""
    words = keys.select(F.expr(f"key & {FILTER_BITS - 1}L").alias("at")).groupBy(F.expr("shiftright(at, 5)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 31 as int)))").alias("b")).toArrow()
    bits = np.zeros(FILTER_BITS // 32, "<u4")
    bits[words["w"].to_numpy()] = words["b"].to_numpy().astype("<u4")
    return spark.sparkContext.broadcast(bits.view(np.uint8))


def jaccard_components(spark: SparkSession, documents: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, over: int = OVER, under: int = UNDER) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    small_batches(spark)
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    texts = docs.select("text").filter(F.length("text") > 0)
    scanned = scratch(spark, keys_and_counts(docs, words), "keys")
    keys = scanned.filter("slice is null").select("doc_id", "n", "key")
    counted = scanned.filter("slice is not null").select("slice", F.posexplode("counts").alias("i", "c")).groupBy("slice", "i").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(SKETCH, np.int64)
    counts[counted["slice"].to_numpy() * SLICE + counted["i"].to_numpy()] = counted["c"].to_numpy()
    sketch = spark.sparkContext.broadcast(counts)

    # the rows of hot tokens are shared without asking and spread by a salt, so that none of them meet in one task
    by_token = Window.partitionBy("token", "salt")
    rows = prefixes(texts, words, over, under, sketch).withColumn("lo", F.min("key").over(by_token)).withColumn("hi", F.max("key").over(by_token))
    shared = scratch(spark, rows.filter("salt > 0 or lo <> hi").select("token", "key").distinct(), "shared")

    frequent = shared.groupBy("token").agg(F.count("*").alias("df"))
    placed = shared.join(frequent, "token").groupBy("key").agg(F.max(F.struct("df", "token")).alias("best")).select("key", F.col("best.token").alias("own"))
    sizes = keys.filter("key is not null").groupBy("key").agg(F.first("n").alias("n"))
    # sets of like size only are in one group: the closer the sizes, the more a link must share
    placed = placed.join(sizes, "key").select("key", "n", F.xxhash64("own", F.floor(F.log("n") / log(SIZE_STEP))).alias("own"))
    placed = scratch(spark, placed, "placed_sets")
    spans = placed.groupBy(F.col("own").alias("grp")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    rows = shared.join(placed, "key")
    matrix = rows.groupBy("token", F.col("own").alias("grp")).agg(F.count("*").alias("members"))
    bound = rows.join(matrix, "token").filter("own <> grp or members > 1").groupBy("key", "own", "n", "grp").agg(F.count("*").alias("common")).join(spans, "grp")
    a, b = F.greatest(F.col("least"), F.ceil(F.col("n") * over / under)), F.least(F.col("most"), F.floor(F.col("n") * under / over))

    def least_common(m):
        """One less than the bound, as its smallest value is at an end of the sizes' range but for rounding."""
        need = lambda x: F.ceil(x * over / under)
        return F.ceil((F.col("n") + m) * over / (over + under)) - F.greatest(need(F.col("n")), need(m))

    qualifying = scratch(spark, bound.filter((a <= b) & (F.col("common") >= F.least(least_common(a), least_common(b)))).select("key", "own", "grp"), "qualifying")

    live = qualifying.select("key", "own").distinct()
    found = wanted_sets(texts, words, _filter_of(spark, live.select("key")))
    sets = found.join(live, "key").groupBy("key").agg(F.first("own").alias("own"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets = scratch(spark, sets, "sets")

    groups = sets.groupBy("own").agg(F.min("key").alias("pivot"), F.count("*").alias("size")).withColumn("salts", F.ceil(F.col("size") / SALT_ROWS).cast("long"))
    groups = scratch(spark, groups, "groups")
    compared = sets.join(groups, "own").filter("key <> pivot").select("pivot", F.pmod(F.xxhash64("key"), F.col("salts")).alias("salt"), F.lit(1).alias("role"), "key", "tokens")
    own = sets.join(groups.select("pivot", "salts"), F.col("key") == F.col("pivot")).select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), "key", "tokens")
    starred = scratch(spark, compared.unionByName(own).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role").mapInArrow(_pivot_task(over, under), "a long, b long"), "starred")
    settled = starred.select(F.col("a").alias("key"), F.col("b").alias("pivot"))
    # a pivot stands in one group only, so links to pivots are whole components
    labelled = scratch(spark, sets.select("key", "own").join(settled, "key", "left").select("key", "own", F.coalesce("pivot", "key").alias("label"), F.col("pivot").isNotNull().alias("settled")), "labels")

    of = groups.select(F.col("own").alias("grp"), F.col("size").alias("grp_size"), F.ceil(F.col("size") / CHUNK).cast("long").alias("chunks"))
    asking = qualifying.join(labelled.select("key", "label", "settled"), "key").join(of, "grp").join(groups.select("own", F.col("size").alias("own_size"), "pivot"), "own")
    inner = (F.col("own") == F.col("grp")) & ~F.col("settled") & (F.col("key") != F.col("pivot"))
    outer = (F.col("own") != F.col("grp")) & (F.struct(F.col("own_size").alias("s"), F.col("own").alias("g")) < F.struct(F.col("grp_size").alias("s"), F.col("grp").alias("g")))
    asking = scratch(spark, asking.filter(inner | outer).select("key", "label", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role")), "queries")
    inside = labelled.join(of, F.col("own") == F.col("grp")).join(asking.select("grp").distinct(), "grp", "left_semi").select("key", "label", "grp", F.pmod(F.xxhash64("key"), F.col("chunks")).alias("chunk"), F.lit(0).alias("role"))
    rows = inside.unionByName(asking).join(sets.select("key", "tokens"), "key")
    joined = rows.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "role").mapInArrow(_group_task(over, under), "a long, b long")
    merged = components(spark, joined)

    roots = labelled.join(merged, F.col("label") == F.col("node"), "left").select(F.col("key").alias("_key"), F.coalesce("root", "label").alias("root"))
    placed = keys.join(roots, F.col("key") == F.col("_key"), "left").select("doc_id", "n", F.coalesce("root", "key").alias("comp"))
    placed = scratch(spark, placed, "placed")
    heads = placed.filter("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("head")).withColumnRenamed("comp", "_comp")
    return placed.join(heads, F.col("comp") == F.col("_comp"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("head", "doc_id").alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark, read(spark, sf_dir, "documents"))
