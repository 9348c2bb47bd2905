"""Exact searches over vectors in blocks that meet only where bounds allow it.

Vectors are dealt to the nearest of some pivots, sorted by pivot and angle, and cut into blocks of a bounded size. A block's
summary holds, for each pivot, the least and the greatest angle of its members. By the triangle inequality on
angles no pair of two blocks is closer than the gap between their ranges, so

* :func:`pairs_above` opens only pairs of blocks whose gap allows the threshold;
* :func:`nearest` first opens the most promising blocks of each, takes the least k-th best of its members as threshold, and
  then opens what may reach that;
* :func:`top_products` sorts by norm first; norms and gaps bound the products of a pair of blocks. Pairs are
  opened in the order of their bounds, and after each round those below the k-th best found so far are given up.

Summaries are few (``MOST_BLOCKS`` at most, as blocks grow with the data) and go to every task; vectors meet in tasks that hold
some blocks of the left and one of the right at a time. Nothing is left out: bounds have a margin for rounding.

Null vectors are left out. Vectors of length 0 have no cosine and are left out by the first two; their products are 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.tables import numbered
from graphloom.operators.traverse import hash_order
from graphloom.runtime import materialise

#: Vectors of a block: least and usual; the most blocks; pivots at most.
SMALL, USUAL, MOST_BLOCKS, PIVOTS = 128, 4096, 20_000, 64
#: Products that a task holds at a time, and blocks in a batch.
HELD, BATCH = 1 << 20, "2"
#: Bytes of the vectors of the blocks that a task holds of the left side.
GROUP_BYTES = 64 << 20
#: Margin of angles and products for rounding.
MARGIN = 1e-6


@dataclass
class Blocks:
    """``rows``: block, ids, data (doubles, row by row); for each block its size, norms and ranges of angles to the pivots."""

    rows: DataFrame
    size: np.ndarray
    least: np.ndarray
    most: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def gaps(self, others: Blocks, k: int) -> np.ndarray:
        """The least angle between a member of block ``k`` and one of each other block."""
        apart = np.maximum(self.low[k] - others.high, others.low - self.high[k])
        return np.maximum(apart.max(axis=1, initial=0.0) - MARGIN, 0.0)

    def products(self, others: Blocks, k: int) -> np.ndarray:
        """The greatest product of a member of block ``k`` and one of each other block."""
        cos = np.cos(np.minimum(self.gaps(others, k), np.pi))
        return np.where(cos >= 0, self.most[k] * others.most, self.least[k] * others.least) * cos * (1 + MARGIN * np.sign(cos)) + 1e-12


def _matrix(data: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float64).reshape(-1, width)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.arccos(np.clip(x @ pivots.T / norm, -1, 1))


def pivots_of(vectors: DataFrame, n: int) -> np.ndarray:
    """Some vectors, chosen by a hash of their ids, at length 1; each is followed by the nearest that is left, so that blocks across two cells stay narrow."""
    rows = vectors.select("id", "e").filter("norm > 0").orderBy(hash_order("id"), "id").limit(n).collect()  # PIVOTS at most
    if not rows:
        return np.zeros((0, 1))
    x = np.array([r["e"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chain, left = [0], list(range(1, len(x)))
    while left:
        chain.append(left.pop(int(np.argmax(x[left] @ x[chain[-1]]))))
    return x[chain]


def prepared(vectors: DataFrame) -> DataFrame:
    """id, e (doubles), norm."""
    rows = vectors.filter("embed is not null").select("id", F.transform("embed", lambda x: x.cast("double")).alias("e"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)))


def blocks_of(rows: DataFrame, pivots: np.ndarray, unit: bool, width: int, block: int | None = None) -> Blocks:
    """Blocks of ``rows`` (id, e, norm); with ``unit`` vectors are scaled to length 1, those without length left out, and norms play no part."""
    if unit:
        rows = rows.filter("norm > 0").select("id", F.transform("e", lambda x: x / F.col("norm")).alias("e"), F.lit(1.0).alias("norm"))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    kind = rows.schema["id"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("e").flatten().to_numpy(), float).reshape(batch.num_rows, -1)
            at, angle = np.zeros(len(x), np.int32), np.zeros(len(x))
            if len(x) and len(shared.value):
                angles = np.nan_to_num(_angles(x, shared.value))
                at = angles.argmin(axis=1).astype(np.int32)
                angle = angles[np.arange(len(x)), at]
            data = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), data, batch.column("norm"), pa.array(at), pa.array(angle)], names=["id", "data", "norm", "cell", "angle"])

    near = rows.select("id", "e", "norm").mapInArrow(dealt, f"id {kind}, data binary, norm double, cell int, angle double")
    # lengths of a factor of 1.4 are sorted together
    band = F.lit(0) if unit else F.when(F.col("norm") > 0, -F.floor(2 * F.log2("norm"))).otherwise(1 << 30)
    near = numbered(near.withColumn("band", band.cast("long")), "band", "cell", "angle", "id")
    n = rows.count()
    size = block or max(SMALL, min(USUAL, n // 16), -(-n // MOST_BLOCKS))
    grouped = near.groupBy(F.floor(F.col("at") / size).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "id", "data"))).alias("members"), F.min("norm").alias("least"), F.max("norm").alias("most"))  # ``size`` rows each

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high, data = [], [], []
            for members in batch.column("members"):
                parts = members.values.field("data").to_pylist()
                angles = _angles(_matrix(parts, width), shared.value)
                none = np.isnan(angles).any(axis=1, keepdims=True)
                low.append(np.where(none, 0.0, angles).min(axis=0).tobytes())
                high.append(np.where(none, np.pi, angles).max(axis=0).tobytes())
                data.append(b"".join(parts))
            ids = [members.values.field("id") for members in batch.column("members")]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.concat_arrays(ids)) if ids else pa.array([], pa.list_(pa.int64()))
            columns = [batch.column("block"), lists, pa.array(data, pa.binary()), batch.column("least"), batch.column("most"), pa.array(low, pa.binary()), pa.array(high, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "ids", "data", "least", "most", "low", "high"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)  # a row is a block
    full = materialise(grouped.mapInArrow(summed, f"block int, ids array<{kind}>, data binary, least double, most double, low binary, high binary"), "blocks")
    rows.sparkSession.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    heads = full.select("block", F.size("ids").alias("size"), "least", "most", "low", "high").orderBy("block").collect()  # MOST_BLOCKS at most
    low, high = (_matrix([bytes(h[c]) for h in heads], max(1, len(pivots))) if len(pivots) and heads else np.zeros((len(heads), 0)) for c in ("low", "high"))
    return Blocks(full.select("block", "ids", "data"), *(np.array([h[c] for h in heads], float) for c in ("size", "least", "most")), low, high)


def both(left: DataFrame, right: DataFrame, unit: bool, block: int | None = None) -> tuple[Blocks, Blocks, int]:
    """The blocks of two sets of vectors (id, embed) by the same pivots, and how wide vectors are."""
    a = materialise(prepared(left), "vectors")  # looked at several times
    b = a if left is right else materialise(prepared(right), "vectors")
    pivots = pivots_of(a, PIVOTS)
    width = pivots.shape[1] if len(pivots) else (a.select(F.size("e")).first() or [1])[0]
    pivots = pivots.reshape(-1, width)  # with none, blocks still know how wide vectors are
    one = blocks_of(a, pivots, unit, width, block)
    return one, one if left is right else blocks_of(b, pivots, unit, width, block), width


def _listed(a: Blocks, b: Blocks, wanted) -> DataFrame:
    """a, b, bound: the pairs of blocks that ``wanted(left summaries, right summaries, block) -> (right blocks, bounds)`` picks, block by block."""
    spark = a.rows.sparkSession
    shared = spark.sparkContext.broadcast([(x.size, x.least, x.most, x.low, x.high) for x in (a, b)])  # summaries

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (Blocks(None, *x) for x in shared.value)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                to, bound = wanted(one, two, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), k), pa.int32()), pa.array(to, pa.int32()), pa.array(bound, pa.float64())], names=["a", "b", "bound"])

    return spark.range(len(a.size)).mapInArrow(task, "a int, b int, bound double")


def _opened(pairs: DataFrame, a: Blocks, b: Blocks, width: int, work) -> DataFrame:
    """a, b, score: what ``work(left vectors, right vectors, left ids, right ids, state) -> (rows, columns, scores)`` finds in each pair of blocks.

    Blocks that follow each other are dealt together to cells of a grid, where a task holds those of the left and lets those of the right pass by: a block is
    copied once for each row or column of cells that it meets, not for each block. ``work`` sees some rows of the left block at a time, so what a task holds
    besides is bounded by ``HELD``; ``state`` is a dictionary of the pair of blocks.
    """
    kinds = [x.rows.schema["ids"].dataType.elementType.simpleString() for x in (a, b)]
    cores = a.rows.sparkSession.sparkContext.defaultParallelism
    per = max(1, GROUP_BYTES // max(1, int(8 * width * a.size.max())))  # blocks held
    high = min(len(a.size), max(-(-len(a.size) // per), round((3 * cores) ** 0.5)))
    wide = min(len(b.size), max(1, -(-3 * cores // high)))
    one, two = -(-len(a.size) // high), -(-len(b.size) // wide)
    pairs = pairs.select("a", "b", F.expr(f"a div {one}").cast("int").alias("x"), F.expr(f"b div {two}").cast("int").alias("y"))
    left = pairs.groupBy("x", "y", "a").agg(F.array_sort(F.collect_list("b")).alias("with")).join(a.rows.withColumnRenamed("block", "a"), "a")  # MOST_BLOCKS at most
    right = pairs.select("x", "y", "b").distinct().join(b.rows.withColumnRenamed("block", "b"), "b")
    left = left.select("x", "y", F.lit(0).alias("side"), F.col("a").alias("block"), "with", F.col("ids").alias("a_ids"), F.lit(None).cast(f"array<{kinds[1]}>").alias("b_ids"), "data")
    right = right.select("x", "y", F.lit(1).alias("side"), F.col("b").alias("block"), F.lit(None).cast("array<int>").alias("with"), F.lit(None).cast(f"array<{kinds[0]}>").alias("a_ids"), F.col("ids").alias("b_ids"), "data")
    cells = left.unionByName(right).repartitionById(high * wide, F.expr(f"x * {wide} + y").cast("int")).sortWithinPartitions("x", "y", "side", "block")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}  # by blocks of the right, those of the left
        cell = None
        for batch in batches:
            for k in range(batch.num_rows):
                x, y, side = (batch.column(c)[k].as_py() for c in ("x", "y", "side"))
                if (x, y) != cell:
                    held, cell = {}, (x, y)
                vectors = np.frombuffer(batch.column("data")[k].as_py(), np.float64).reshape(-1, width)
                if side == 0:
                    mine = pa.concat_arrays([batch.column("a_ids")[k].values])
                    for to in batch.column("with")[k].as_py():
                        held.setdefault(to, []).append((vectors, mine))
                    continue
                theirs, step = batch.column("b_ids")[k].values, max(1, HELD // max(1, len(vectors)))
                for left, mine in held.get(batch.column("block")[k].as_py(), ()):
                    state: dict = {}
                    for at in range(0, len(left), step):
                        part = mine.slice(at, step)
                        i, j, scores = work(left[at : at + step], vectors, part, theirs, state)
                        yield pa.RecordBatch.from_arrays([part.take(pa.array(i)), theirs.take(pa.array(j)), pa.array(scores)], names=["a", "b", "score"])

    return cells.mapInArrow(task, f"a {kinds[0]}, b {kinds[1]}, score double")


def _nothing(left: DataFrame, right: DataFrame) -> DataFrame:
    kind = right.schema["id"].dataType.simpleString()
    return left.select(F.col("id").alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(0.0).alias("score")).limit(0)


def _near(one: Blocks, two: Blocks, k: int, threshold: float):
    to = np.flatnonzero(one.gaps(two, k) <= np.arccos(np.clip(threshold, -1, 1)) + MARGIN)
    return to, np.zeros(len(to))


def pairs_above(left: DataFrame, right: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """a, b, score: pairs of ids (id, embed) whose cosine is at least ``threshold``."""
    a, b, width = both(left, right, True, block)
    if not len(a.size) or not len(b.size):
        return _nothing(left, right)

    def work(x, y, *_):
        sims = x @ y.T
        rows, columns = np.nonzero(sims >= threshold)
        return rows, columns, sims[rows, columns]

    return _opened(_listed(a, b, lambda p, q, k: _near(p, q, k, threshold)), a, b, width, work)


def share_opened(left: DataFrame, right: DataFrame, threshold: float, block: int | None = None) -> DataFrame:
    """One row, blocks, opened, share: how many pairs of blocks there are, and how many of them :func:`pairs_above` opens; share is of pairs of vectors."""
    a, b, _ = both(left, right, True, block)
    listed = _listed(a, b, lambda p, q, k: _near(p, q, k, threshold))
    counts = [left.sparkSession.createDataFrame([(k, int(n)) for k, n in enumerate(x.size)], f"{c} int, n_{c} long") for x, c in ((a, "a"), (b, "b"))]  # a row a block
    met = listed.join(counts[0], "a").join(counts[1], "b").agg(F.count("*").alias("opened"), F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("pairs"))
    total = float(a.size.sum() * b.size.sum())
    return met.select(F.lit(len(a.size) * len(b.size)).alias("blocks"), "opened", (F.col("pairs") / total).alias("share"))


def _best(k: int, itself: bool):
    def work(x, y, mine, theirs, state):
        sims = x @ y.T
        if not itself:
            if "at" not in state:
                state["at"] = {}
                for j, b in enumerate(theirs.to_pylist()):
                    state["at"].setdefault(b, []).append(j)
            for i, a in enumerate(mine.to_pylist()):
                sims[i, state["at"].get(a, [])] = -np.inf
        n = min(k, sims.shape[1])
        cut = np.partition(sims, sims.shape[1] - n, axis=1)[:, sims.shape[1] - n, None]
        rows, columns = np.nonzero((sims >= cut - 1e-9) & np.isfinite(sims))  # ties are decided later
        return rows, columns, sims[rows, columns]

    return work


def nearest(left: DataFrame, right: DataFrame, k: int, itself: bool = False, block: int | None = None) -> DataFrame:
    """a, b, score, place: the ``k`` most similar on the right of each on the left; equal ids are left out unless ``itself``, ties go by ids."""
    a, b, width = both(left, right, True, block)
    order = Window.partitionBy("a").orderBy(F.desc("score"), "b")
    if not len(a.size) or not len(b.size):
        return _nothing(left, right).withColumn("place", F.row_number().over(order))
    work = _best(k, itself)

    def promising(one: Blocks, two: Blocks, at: int):
        """The closest blocks that hold enough, and one more."""
        by_gap = np.argsort(one.gaps(two, at), kind="stable")
        enough = int(np.searchsorted(np.cumsum(two.size[by_gap]), k + 1)) + 2
        return by_gap[:enough], np.zeros(len(by_gap[:enough]))

    begun = materialise(_listed(a, b, promising), "begun")
    ranked = lambda f: f.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    first = materialise(ranked(_opened(begun, a, b, width, work)), "first")
    members = a.rows.select(F.col("block"), F.explode("ids").alias("a"))
    cut = members.join(first.groupBy("a").agg(F.count("*").alias("n"), F.min("score").alias("worst")), "a", "left")
    cut = cut.groupBy("block").agg(F.min(F.when(F.col("n") >= k, F.col("worst")).otherwise(-1.0)).alias("cut"))
    least = np.full(len(a.size), -1.0)
    for r in cut.collect():  # a row a block
        least[r["block"]] = r["cut"]
    rest = _listed(a, b, lambda p, q, at: _near(p, q, at, least[at] - 1e-9)).join(begun.select("a", "b"), ["a", "b"], "left_anti")
    return ranked(first.drop("place").unionByName(_opened(rest, a, b, width, work)))


def best_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, score: the best cosine that each on the left has on the right."""
    return nearest(left, right, 1, itself=True).select("a", "score")


def top_products(left: DataFrame, right: DataFrame, k: int, block: int | None = None, report: dict | None = None) -> DataFrame:
    """a, b, score: the ``k`` pairs of ids (id, embed) with the greatest products; ties by ids.

    ``report``, if given, is told how many pairs of blocks there are, how many were opened, and the rounds.
    """
    a, b, width = both(left, right, False, block)
    if not len(a.size) or not len(b.size) or k <= 0:
        return _nothing(left, right)
    spark = left.sparkSession
    bounded = lambda cut: _listed(a, b, lambda p, q, at: (lambda all_: (np.flatnonzero(all_ >= cut), all_[all_ >= cut]))(p.products(q, at)))
    cut, step, rounds, opened, have = -np.inf, None, 0, 0, 0
    found, done = None, None
    while True:
        todo = bounded(cut)
        if done is not None:
            todo = todo.join(done, ["a", "b"], "left_anti")
        left_over = todo.count()
        if not left_over:
            break
        # at first so many pairs of blocks as may hold enough, then twice as many each round; all that is left, if it is little more
        step = max(1, int(2 * k / (a.size.mean() * b.size.mean())) + 1) if step is None else 2 * step
        if left_over > 2 * step and step <= MOST_BLOCKS:
            todo = todo.orderBy(F.desc("bound"), "a", "b").limit(step)
        todo = materialise(todo.select("a", "b"), "opened")
        now = cut

        def work(x, y, _, __, state, now=now):
            products = x @ y.T
            rows, columns = np.nonzero(products >= state.get("least", now))
            scores = products[rows, columns]
            # the k best of the rows so far say what later rows must reach
            best = np.concatenate([state.get("best", np.zeros(0)), scores])
            if len(best) >= k:
                best = np.partition(best, len(best) - k)[len(best) - k :]
                state["least"] = max(now, best[0])
                keep = scores >= state["least"]
                rows, columns, scores = rows[keep], columns[keep], scores[keep]
            state["best"] = best
            return rows, columns, scores

        hits = _opened(todo, a, b, width, work)
        placed = numbered(hits if found is None else found.unionByName(hits), F.desc("score"), "a", "b")
        found = materialise(placed.filter(F.col("at") < k).drop("at"), "products")
        got = found.agg(F.count("*").alias("n"), F.min("score").alias("least")).first()
        have = got["n"]
        cut = got["least"] if have >= k else -np.inf
        done = todo if done is None else done.unionByName(todo)
        rounds, opened = rounds + 1, opened + todo.count()
    if report is not None:
        report |= {"blocks": len(a.size) * len(b.size), "opened": opened, "rounds": rounds}
    return found if found is not None else spark.createDataFrame([], _nothing(left, right).schema)
