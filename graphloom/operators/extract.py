"""From extracted text to weighted edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.operators.concepts import MOST_TOKENS, concept_spans


def edges_per_document(documents: DataFrame, relations: Column, doc_id: str = "id") -> DataFrame:
    """src, dst, weight: how many documents hold each edge. ``relations`` is array<struct<src, dst>>.

    Each row is a document and repeats within it count once, so no distinct over
    the corpus is needed: the arrays are made distinct in place, then counted.
    """
    rows = documents.select(F.inline(F.array_distinct(relations)))
    return rows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """src, dst, weight: how often each pair occurs."""
    return edges.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))


def edge_reweighting(samples: DataFrame, paths: str = "paths") -> DataFrame:
    """src, dst, n, ratio: occurrences over all paths, and their mean over them (rare edges above 1)."""
    pairs = samples.select(F.explode(paths).alias("p")).select(F.inline(T.adjacent_pairs(F.col("p"))))
    counted = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    mean = counted.agg(F.avg("n").alias("mean"))
    return counted.join(F.broadcast(mean)).select("src", "dst", "n", (F.col("mean") / F.col("n")).alias("ratio"))  # one row


def parse_quality(documents: DataFrame, hierarchy: str = "hierarchy") -> DataFrame:
    """One row: samples, samples with an invalid path, paths, invalid paths, relations, and the shares."""
    parsed = documents.select(T.parse_paths(F.col(hierarchy)).alias("p"))
    out = parsed.agg(
        F.count("*").alias("n_samples"),
        F.count_if(F.col("p.invalid") > 0).alias("n_invalid_samples"),
        F.coalesce(F.sum("p.total"), F.lit(0)).alias("n_paths"),
        F.coalesce(F.sum("p.invalid"), F.lit(0)).alias("n_invalid_paths"),
        F.coalesce(F.sum(F.size("p.relations")), F.lit(0)).alias("n_relations"),
    )
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    return out.withColumn("invalid_samples", share("n_invalid_samples", "n_samples")).withColumn("invalid_paths", share("n_invalid_paths", "n_paths"))


def concept_counts(documents: DataFrame, concepts: str = "concepts") -> DataFrame:
    """concept, n, first: count, and the first place (document order, then position) at which it occurs."""
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.posexplode(T.parse_concepts(F.col(concepts))).alias("at", "concept"))
    return rows.groupBy("concept").agg(F.count("*").alias("n"), F.min(F.struct("row", "at")).alias("first"))


def most_common(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent concepts, ties by first occurrence."""
    return counts.orderBy(F.desc("n"), "first", "concept").limit(k).select("concept", "n")


def relation_histogram(documents: DataFrame, triplets: str = "triplets") -> DataFrame:
    """type, n: how many distinct (tail, head) each relation has, most first."""
    rows = documents.select(F.inline(triplets)).filter("head is not null and tail is not null and type is not null")
    return rows.groupBy("type").agg(F.count_distinct("tail", "head").alias("n")).orderBy(F.desc("n"), "type")


def loss_mask(samples: DataFrame, reweighting: DataFrame, seed: int = 0, doc_id: str = "id", paths: str = "paths") -> DataFrame:
    """doc_id, path, at, word, ignored: which words of the paths training should pass over.

    The first word of a path and separators are never passed over; a later word is with
    probability ``max(0, 1 - ratio)`` of its edge, by a hash of document, path and place.
    """
    words = samples.select(F.col(doc_id).alias("doc_id"), F.posexplode(paths).alias("path", "p")).select("doc_id", "path", F.posexplode("p").alias("at", "word"), "p")
    words = words.withColumn("before", F.get(F.col("p"), F.col("at") - 1)).drop("p")
    uniform = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", "path", "at", F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0
    ratios = reweighting.select(F.col("src").alias("before"), F.col("dst").alias("word"), "ratio")
    return words.join(ratios, ["before", "word"], "left").select("doc_id", "path", "at", "word", ((F.col("at") > 0) & (uniform > F.coalesce("ratio", F.lit(1.0)))).alias("ignored"))


def transitions(events: DataFrame, by: str, order: list[str], state: str) -> DataFrame:
    """src, dst, weight: how often one state follows another within a sequence."""
    window = Window.partitionBy(by).orderBy(*order)
    return edge_counts(events.select(F.lag(state).over(window).alias("src"), F.col(state).alias("dst")).filter("src is not null and dst is not null"))


def tag_concepts(documents: DataFrame, concepts: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens", overlaps: str = "first", most_literals: int = MOST_TOKENS) -> DataFrame:
    """doc_id, at, length, concept: at each place the shortest concept that begins there, without overlaps.

    Concepts of up to ``most_literals`` words in all are sent along, more are joined (:func:`concept_spans`).
    """
    return concept_spans(documents, concepts, doc_id, tokens, overlaps=overlaps, most_tokens=most_literals)


def bio_tags(documents: DataFrame, spans: DataFrame, doc_id: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """doc_id, tags: B where a span of :func:`tag_concepts` begins, I within it, O elsewhere; an id is one document."""
    held = spans.groupBy(F.col("doc_id").alias("_doc")).agg(F.sort_array(F.collect_list(F.struct("at", "length"))).alias("_spans"))
    counted = documents.select(F.col(doc_id).alias("doc_id"), F.size(tokens).alias("_n"))
    rows = counted.join(held, F.col("doc_id") == F.col("_doc"), "left").withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<at:int,length:int>>")))
    outside = lambda n: F.array_repeat(F.lit("O"), n)
    ended = lambda k: F.coalesce(F.get("_spans", k)["at"] + F.get("_spans", k)["length"], F.lit(0))
    # stretch by stretch: what is outside before a span, its beginning, and the rest of it
    tagged = F.flatten(F.transform("_spans", lambda s, k: F.concat(outside(s["at"] - F.when(k > 0, ended(k - 1)).otherwise(0)), F.array(F.lit("B")), F.array_repeat(F.lit("I"), s["length"] - 1))))
    return rows.select("doc_id", "_n", tagged.alias("_tagged")).select("doc_id", F.when(F.col("_n").isNotNull() & (F.col("_n") >= 0), F.concat("_tagged", outside(F.col("_n") - F.size("_tagged")))).alias("tags"))
