"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; the unlabelled set is a sample of the documents
that have no label at all (of all documents, where each has one). Negative labels are not
read. With the class prior p, the risk of a score g is
p E+[l(g)] + max(0, E_u[l(-g)] - p E+[l(-g)]), where the maximum keeps the estimated risk
on negatives from falling below zero; when it would, a step is taken against that term
instead. Several linear numpy classifiers are trained so, on resampled sets, and their
margins averaged. The prior is a parameter; where it is not given, it is estimated from the
positives and the unlabelled set alone: among the highest scores of a half that was not
looked at, hardly a negative is left, so there the ratio of the unlabelled share to the
positive share is the prior (the best bin, by its upper confidence bound); under ``FEW``
positives it is ``PRIOR_OF_FEW``.

Features are the words of a text and their beginnings, whether they occur, recur
or are dense. Those that stand out among positives are kept, so scoring looks up
a table of fixed size and works on whole texts however long.

Bounds, both parameters: at most ``max_positive`` positive and ``max_unlabelled``
unlabelled rows teach, those with the smallest hash of their id. Features are counted in
tasks; to the driver go the ``MOST`` best ones, and for each teaching row which of these it
has. Defined results: null and empty texts get the score of a text without features; rows
with a null label or id teach nothing, and an id that is labelled twice counts as toxic if
one of them says so; without positives, and for an empty table of documents to learn
from, every score is 0; repeated rows and equal texts get equal scores; further columns may
have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fold, read, scratch, small_batches

WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6, 7)
#: Features of a model.
MOST = 512
#: With fewer positives than this the prior can't be told from the data, and is taken as the second number.
FEW, PRIOR_OF_FEW = 50, 0.1


def features(text: str, memo: dict[str, list[int]]) -> np.ndarray:
    """Sorted hashed features of a whole text. ``memo`` holds words' hashes from text to text."""
    counts: dict[str, int] = {}
    words = WORD.findall(text.lower())
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    if len(memo) > 200_000:
        memo.clear()
    hashes: list[int] = []
    times: list[int] = []
    for w, n in counts.items():
        own = memo.get(w)
        if own is None:
            own = memo[w] = [crc32(w.encode()), *(crc32(f"{w[:k]}*".encode()) for k in BEGINNINGS if len(w) > k)]
        hashes += own
        times += [n] * len(own)
    if not hashes:
        return np.zeros(0, np.int64)
    at, back = np.unique(np.array(hashes, np.uint64), return_inverse=True)
    total = np.bincount(back, times)
    size = len(words)
    kinds = [at, at[total >= 2] + np.uint64(1 << 32), at[total * 100 >= size] + np.uint64(2 << 32), at[total * 25 >= size] + np.uint64(3 << 32)]
    return np.unique(np.concatenate(kinds)).astype(np.int64)


class PULinear:
    """g(x) = w x + b on binary features, trained with the sigmoid loss and the non-negative risk."""

    def __init__(self, prior: float, rate: float = 0.05, steps: int = 400, decay: float = 1e-3, slack: float = 0.0):
        self.prior, self.rate, self.steps, self.decay, self.slack = prior, rate, steps, decay, slack

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray) -> PULinear:
        w, b = np.zeros(positive.shape[1]), -1.0
        m, v = np.zeros(w.size + 1), np.zeros(w.size + 1)
        loss = lambda z: 1 / (1 + np.exp(np.clip(z, -50, 50)))
        slope = lambda z: -loss(z) * loss(-z)
        for step in range(1, self.steps + 1):
            gp, gu = positive @ w + b, unlabelled @ w + b
            negative = loss(-gu).mean() - self.prior * loss(-gp).mean()
            dp = self.prior * slope(gp) / len(gp)
            dnp, dnu = self.prior * slope(-gp) / len(gp), -slope(-gu) / len(gu)
            if negative < -self.slack:  # overfitted to negatives: go back up that term
                on_p, on_u = -dnp, -dnu
            else:
                on_p, on_u = dp + dnp, dnu
            grad = np.append(positive.T @ on_p + unlabelled.T @ on_u + self.decay * w, on_p.sum() + on_u.sum())
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
            move = self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            w, b = w - move[:-1], b - move[-1]
        self.w, self.b = w, b
        return self


class ToxicityModel:
    """Selected feature numbers, sorted, with the averaged weights; scale turns margins into scores."""

    def __init__(self, chosen: np.ndarray, weights: np.ndarray, bias: float):
        self.chosen, self.weights, self.bias = chosen, weights, bias

    def margin(self, found: np.ndarray) -> float:
        if not self.chosen.size:
            return self.bias
        at = np.minimum(np.searchsorted(self.chosen, found), self.chosen.size - 1)
        return float(self.weights[at[self.chosen[at] == found]].sum() + self.bias)

    def __call__(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(found), -50, 50)))) if self.chosen.size else 0.0


def _bits(found: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Which of the chosen features a text has."""
    out = np.zeros(chosen.size, bool)
    if chosen.size:
        at = np.minimum(np.searchsorted(chosen, found), chosen.size - 1)
        out[at[chosen[at] == found]] = True
    return out


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of both: the least ratio of their tails, by its upper confidence bound."""
    at = np.unique(positive)
    share = lambda x: (len(x) - np.searchsorted(np.sort(x), at, side="left")) / len(x)
    p, u = share(positive), share(unlabelled)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(unlabelled)) + np.sqrt(np.log(4 / delta) / 2 / len(positive))
    return float(np.clip((u / p)[np.argmin((u + slack) / p)], 0.5 / len(unlabelled), 0.9))


def prior_of(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The class prior, from the features of both sets: one half of each is scored by log ratios learnt from the other."""
    if min(len(positive), len(unlabelled)) < FEW:
        return PRIOR_OF_FEW
    (a, b), (c, d) = ((x[::2], x[1::2]) for x in (positive, unlabelled))
    weight = np.log((a.mean(axis=0) + 0.5 / len(a)) / (c.mean(axis=0) + 0.5 / len(c)))
    return best_bin(b @ weight, d @ weight)


def train(chosen: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None, members: int = 3, seed: int = 11) -> ToxicityModel:
    """``chosen`` feature numbers, and which of them each positive and unlabelled text has."""
    if not chosen.size or not len(positive) or not len(unlabelled):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), 0.0)
    positive, unlabelled = positive.astype(float), unlabelled.astype(float)
    prior = prior_of(positive, unlabelled) if prior is None else min(0.9, prior)
    p, u = positive.mean(axis=0), np.maximum(unlabelled.mean(axis=0), 1 / len(unlabelled))
    # the log ratio to an estimate of the share among negatives sets each feature's scale
    rest = np.maximum(u - prior * p, 0.5 / len(unlabelled)) / (1 - prior)
    scale = np.clip(np.log(np.maximum(p, 1e-9) / rest), 0.1, 8)
    a, b = positive * scale, unlabelled * scale
    rng = np.random.default_rng(seed)
    fits = [PULinear(prior).fit(a[rng.integers(0, len(a), len(a))], b[rng.integers(0, len(b), len(b))]) for _ in range(members)]
    return ToxicityModel(chosen, scale * np.mean([f.w for f in fits], axis=0), float(np.mean([f.b for f in fits])))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many positive and unlabelled texts of a batch have each feature."""
    memo: dict[str, list[int]] = {}
    for batch in batches:
        found = [features(t or "", memo) for t in batch.column("text").to_pylist()]
        if not found:
            continue
        at, back = np.unique(np.concatenate(found), return_inverse=True)
        row = np.repeat(np.arange(len(found)), [len(f) for f in found])
        counts = [np.bincount(back, batch.column(c).to_numpy(zero_copy_only=False)[row].astype(float), at.size).astype(np.int64) for c in ("positive", "unlabelled")]
        yield pa.RecordBatch.from_arrays([pa.array(at), *map(pa.array, counts)], names=["feature", "in_p", "in_u"])


def fit(documents: DataFrame, labels: DataFrame, max_positive: int = 3000, max_unlabelled: int = 6000, prior: float | None = None, least_z: float = 6.0, least_seen: int = 5) -> ToxicityModel:
    """``documents``: doc_id, text. ``labels``: doc_id, toxic; of the values only 1 is looked at."""
    spark = documents.sparkSession
    small_batches(spark)
    known = labels.filter(F.col("doc_id").isNotNull())
    positive = known.filter("toxic = 1").select(F.col("doc_id").alias("_id")).distinct()
    ids = documents.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id")).distinct()
    free = ids.join(known.select(F.col("doc_id").alias("_id")), "_id", "left_anti")
    if free.isEmpty():
        free = ids
    taught = lambda f, n, p: f.orderBy(F.xxhash64("_id"), "_id").limit(n).select("_id", F.lit(p).alias("positive"), F.lit(not p).alias("unlabelled"))
    both = taught(positive, max_positive, True).unionByName(taught(free, max_unlabelled, False)).groupBy("_id").agg(F.max("positive").alias("positive"), F.max("unlabelled").alias("unlabelled"))
    # at most max_positive + max_unlabelled rows of a few bytes: a proven bound
    rows = documents.select("doc_id", "text").join(F.broadcast(both), F.col("doc_id") == F.col("_id")).select("text", "positive", "unlabelled")
    rows = scratch(spark, rows, "taught")
    size = rows.agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")).first()
    if not size["p"] or not size["u"]:
        return train(np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros((0, 0)))
    # features whose share among positives stands above that in all
    counted = rows.mapInArrow(_count_task, "feature long, in_p long, in_u long").groupBy("feature").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    p, u = F.col("in_p") / size["p"], F.greatest("in_u", F.lit(1)) / size["u"]
    z = (p - u) / F.sqrt(u * (1 - F.least(u, F.lit(0.999))) / size["p"])
    able = counted.filter(F.col("in_p") >= min(least_seen, max(2, size["p"] // 4))).withColumn("z", z).filter(F.col("z") >= least_z)
    chosen = np.array(sorted(r["feature"] for r in able.orderBy(F.desc("z"), "feature").limit(MOST).collect()), np.int64)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            bits = [np.packbits(_bits(features(t or "", memo), chosen)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), batch.column("unlabelled"), pa.array(bits, pa.binary())], names=["positive", "unlabelled", "bits"])

    held = rows.mapInArrow(task, "positive boolean, unlabelled boolean, bits binary").orderBy("bits", "positive", "unlabelled").toArrow().to_pandas()
    bits = np.array([np.unpackbits(np.frombuffer(x, np.uint8), count=chosen.size) for x in held["bits"]], np.uint8).reshape(len(held), chosen.size)
    order = np.random.default_rng(3).permutation(len(held))  # halves of the sets are taken in this order
    bits, positive, unlabelled = bits[order], held["positive"].to_numpy(bool)[order], held["unlabelled"].to_numpy(bool)[order]
    return train(chosen, bits[positive], bits[unlabelled], prior)


def score(documents: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, score and predicted (1 from 0.5 on)."""
    small_batches(documents.sparkSession)
    frame = documents.select(*keep, F.col(text).alias("_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, list[int]] = {}
        for batch in batches:
            out = np.array([model(features(t or "", memo)) for t in batch.column("_text").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(task, f"{kinds}, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    labels = read(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    return score(documents, fit(documents.filter(~F.col("held_out")), labels), ("doc_id", "held_out"))
