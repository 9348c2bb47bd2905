"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

One pass turns every whole text into sixteen statistics. The Gaussian kernel
over standardised statistics is approximated by random cosines, so kernel ridge
regression is a linear fit whose normal equations add up: each task sums its own,
Spark adds the sums, and the driver solves a system of fixed size. On training
rows kept apart from that fit, raw scores are binned and pooled into a rising
curve (isotonic regression), which turns them into probabilities.

Defined results: a null text counts as empty; an empty text gets statistics of 0
and a score like any other; rows with a null label teach nothing; without both
labels to learn from, every score is the share of label 1, or 0.5 where there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fold, read, scratch, small_batches

STATISTICS = ("chars", "words", "word_length", "upper", "digits", "symbols", "bangs", "bars", "stops", "distinct", "all_upper", "odd_ends", "repeated_lines", "line_length", "commonest", "short_lines")
BINS = 2048


def _classes() -> np.ndarray:
    """Rows: bytes that are upper case, digits, symbols, exclamation marks, bars, sentence ends."""
    out = np.zeros((6, 256))
    for row, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#$%&*+<=>@\\^_`{}~[]", "!", "|", ".,;:?")):
        out[row, [ord(c) for c in chars]] = 1
    return out


CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """The numbers of ``STATISTICS`` for a whole text."""
    if not text:
        return [0.0] * len(STATISTICS)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    upper, digits, symbols, bangs, bars, stops = CLASSES @ np.bincount(raw, minlength=256) / raw.size
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = max(1, len(words))
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    capital = sum(k for w, k in counts.items() if len(w) > 1 and w.isupper())
    odd = sum(k for w, k in counts.items() if not w[-1].isalnum() and len(w) > 2 and not w[-2].isalnum())
    chars = max(1, sum(map(len, lines)))
    return [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(text) / n), upper, digits, symbols, bangs, bars, stops,
        len(counts) / n**0.8, capital / n, odd / n, 1 - sum(map(len, set(lines))) / chars, np.log1p(chars / max(1, len(lines))),
        max(counts.values(), default=0) / n, sum(len(x) < 20 for x in lines) / max(1, len(lines)),
    ]


def document_statistics(documents: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``x``, the statistics."""
    small_batches(documents.sparkSession)
    frame = documents.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    kinds = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(task, f"{kinds}, x array<double>")


class FourierFeatures:
    """cos(Wx + b) scaled, over standardised and clipped statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights = rng.normal(scale=1 / (width * np.sqrt(mean.size)), size=(mean.size, size))
        self.phase = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        return np.hstack([np.sqrt(2 / self.phase.size) * np.cos(z @ self.weights + self.phase), np.ones((len(z), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(STATISTICS))


def isotonic(totals: np.ndarray, positives: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (place, value) of the rising curve nearest to the bins' shares: pool adjacent violators."""
    blocks: list[list[float]] = []  # weight, positives, weighted place
    for n, p, x in zip(totals, positives, at, strict=True):
        if n:
            blocks.append([n, p, n * x])
            while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


class QualityModel:
    def __init__(self, features: FourierFeatures | None, weights: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray], base: float):
        self.features, self.weights, self.knots, self.base = features, weights, knots, base

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.features is None or not len(self.knots[0]):
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def fit(labelled: DataFrame, size: int = 192, width: float = 0.7, ridge: float = 1e-3, seed: int = 7, apart: int = 4) -> QualityModel:
    """Fits on rows of ``x``, ``y`` (0 or 1) and ``part`` (a number; multiples of ``apart`` serve the calibration)."""
    rows = labelled.filter(F.col("y").isin(0, 1)).select("x", F.col("y").cast("double").alias("y"), (F.col("part") % apart == 0).alias("held"))
    moments = rows.agg(F.count("*").alias("n"), F.sum("y").alias("p"), F.sum(F.lit(1) - F.col("y")).alias("q"), *[f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    base = moments["p"] / moments["n"] if moments["n"] else 0.5
    if not moments["p"] or not moments["q"]:
        return QualityModel(None, None, (np.zeros(0), np.zeros(0)), base)
    features = FourierFeatures(*(np.array([moments[f"{f}{i}"] for i in range(len(STATISTICS))]) for f in ("avg", "stddev_pop")), size, width, seed)

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 2))
        for batch in batches:
            z = features(_matrix(batch))
            total += z.T @ np.hstack([z, batch.column("y").to_numpy()[:, None]])
        i, j = np.indices(total.shape)
        upper = j >= i
        yield pa.RecordBatch.from_arrays([pa.array(i[upper].astype(np.int32)), pa.array(j[upper].astype(np.int32)), pa.array(total[upper])], names=["i", "j", "v"])

    summed = rows.filter(~F.col("held")).select("x", "y").mapInArrow(normal_equations, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow().to_pandas()
    total = np.zeros((size + 1, size + 2))
    total[summed["i"], summed["j"]] = summed["v"]
    gram = total[:, :-1] + np.triu(total[:, :-1], 1).T
    weights = np.linalg.solve(gram + ridge * max(1.0, gram[-1, -1]) / size * np.eye(size + 1), total[:, -1])
    model = QualityModel(features, weights, (np.zeros(0), np.zeros(0)), base)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip((model.raw(_matrix(batch)) + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("y")], names=["bin", "y"])

    held = rows.filter("held").select("x", "y").mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).orderBy("bin").toArrow().to_pandas()
    model.knots = isotonic(held["n"].to_numpy(float), held["p"].to_numpy(float), (held["bin"].to_numpy(float) + 0.5) / BINS * 2 - 0.5)
    return model


def score(statistics_: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, score and predicted (1 from 0.5 on)."""
    frame = statistics_.select(*keep, "x")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = model(_matrix(batch))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    kinds = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in keep)
    return frame.mapInArrow(task, f"{kinds}, score double, predicted int")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    stats = scratch(spark, document_statistics(documents, ("doc_id", "held_out")), "statistics")
    # an id that is labelled several times counts once, as of good quality if any of its labels says so
    labels = read(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("y"))
    part = F.crc32(F.concat(F.lit("part "), F.col("doc_id").cast("string")).cast("binary"))
    model = fit(stats.filter(~F.col("held_out")).join(labels, F.col("doc_id") == F.col("_id")).select("x", "y", part.alias("part")))
    return score(stats, model, ("doc_id", "held_out"))
