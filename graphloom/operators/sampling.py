"""Pairs that are no edge, drawn without listing all pairs.

All ordered pairs of N titles have numbers from 0 to N * N - 1. A keyed permutation (four Feistel rounds over
halves of as many bits as N needs) deals out numbers in an order that looks random, each once; those beyond the last pair
are passed over, those of edges go in an anti-join, and more are dealt until there are enough. What is
drawn depends on titles, edges and seed alone, not on how rows are spread. All numbers in turn give all
non-edges, so any number of them can be asked for.

Null titles are left out; a title with itself is a pair like any other; fewer pairs come where there are no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.tables import numbered
from graphloom.runtime import materialise

ROUNDS = 4


def halves(n: int) -> int:
    """Bits of half a number: two halves hold n * n numbers at least."""
    return max(1, (n - 1).bit_length())


def dealt(place: Column, bits: int, seed: int) -> Column:
    """A permutation of the numbers of 2 * ``bits`` bits."""
    mask = (1 << bits) - 1
    left, right = F.shiftright(place, bits), place.bitwiseAND(F.lit(mask))
    for k in range(ROUNDS):
        key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(k)), right.cast("string")))
        mixed = F.conv(F.substr(key, F.lit(1), F.lit(8)), 16, 10).cast("long").bitwiseAND(F.lit(mask))
        left, right = right, left.bitwiseXOR(mixed)
    return F.shiftleft(left, bits).bitwiseOR(right)


def non_edges(vertices: DataFrame, edges: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """src, dst, draw: ``n`` ordered pairs of titles that are no edge, the first by a seeded order (``draw`` rises with it)."""
    spark = vertices.sparkSession
    titles = materialise(numbered(vertices.select("title").filter("title is not null").distinct(), "title"), "titles")
    many = titles.count()
    if not many or n <= 0:
        return titles.select(F.col("title").alias("src"), F.col("title").alias("dst"), F.lit(0).cast("long").alias("draw")).limit(0)
    bits = halves(many)
    number = lambda c: titles.select(F.col("at").alias(f"_{c}"), F.col("title").alias(c))
    taken = edges.select("src", "dst").distinct().join(number("src"), "src").join(number("dst"), "dst").select((F.col("_src") * many + F.col("_dst")).alias("pair"))
    taken = materialise(taken, "taken")
    free = many * many - taken.count()
    found, have, done, last = None, 0, 0, 1 << 2 * bits
    want = min(n, free)
    while have < want:
        # as many numbers as should hold what lacks, and a few more
        upto = min(last, done + int((want - have) * (last / free) * 1.05) + 1000)
        draws = spark.range(done, upto).select(F.col("id").alias("draw"), dealt(F.col("id"), bits, seed).alias("pair")).filter(F.col("pair") < many * many)
        part = materialise(draws.join(taken, "pair", "left_anti"), "draws")
        found = part if found is None else found.unionByName(part)
        have, done = have + part.count(), upto
    if found is None:
        return titles.select(F.col("title").alias("src"), F.col("title").alias("dst"), F.lit(0).cast("long").alias("draw")).limit(0)
    first = numbered(found, "draw", name="_place").filter(F.col("_place") < n) if have > n else found
    ends = first.select("draw", F.expr(f"pair div {many}L").alias("_src"), F.expr(f"pair % {many}L").alias("_dst"))
    return ends.join(number("src"), "_src").join(number("dst"), "_dst").select("src", "dst", "draw")


def labelled_pairs(vertices: DataFrame, edges: DataFrame, factor: int = 10, seed: int = 0) -> DataFrame:
    """src, dst, label: all edges (1), and ``factor`` times as many pairs that are none (0); by title."""
    known = materialise(edges.select("src", "dst").distinct(), "known")
    return known.withColumn("label", F.lit(1)).unionByName(non_edges(vertices, known, factor * known.count(), seed).select("src", "dst", F.lit(0).alias("label")))


def with_non_edges(edges: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """src, dst, weight: the edges, and ``int(share * n)`` pairs of their ends that are none, of weight 1."""
    known = edges.select("src", "dst", F.col("weight").cast("double").alias("weight"))
    titles = known.select(F.explode(F.array("src", "dst")).alias("title"))
    return known.unionByName(non_edges(titles, known, int(share * known.count()), seed).select("src", "dst", F.lit(1.0).alias("weight")))
