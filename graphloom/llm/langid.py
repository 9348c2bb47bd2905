"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, every run of non-letters becomes one space, and the
1-, 2- and 3-grams of what is left are hashed into a fixed number of columns.
Training counts all learnable texts, whole, in one pass: each task adds up its
own languages-by-columns counts, Spark sums them, and the smoothed log
probabilities (languages x columns, so bounded whatever the corpus) are
broadcast. Scoring is a product of a sparse matrix, texts x columns, with that
matrix, in numpy, many texts at a time.

Defined results: a null text or one without letters is ``und`` with score 0;
so is every text when there was nothing to learn from; texts and rows with a
null language teach nothing; equal scores go to the language that sorts first;
a text of any length is worked through in slices, n-grams across slices included.
An empty table gives an empty result; rows that repeat an id, a null one too, are each
scored; a kept column that is named as a result comes out as ``kept_`` and its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import fold, read, small_batches

COLUMNS = 1 << 16
ORDERS = (1, 2, 3)
#: Code points that are hashed at once; bounds a worker's memory.
SLICE = 1 << 19
UNKNOWN = "und"


@cache
def _is_letter() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of non-letters as one space, a space around it all."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _is_letter()[np.minimum(codes, 0xFFFF)]
    if codes.size and codes.max() > 0xFFFF:
        beyond = codes > 0xFFFF
        unique, back = np.unique(codes[beyond], return_inverse=True)
        known = known.copy()
        known[beyond] = np.array([chr(c).isalpha() for c in unique])[back]
    marks = np.where(known, codes, np.uint32(32))
    keep = known.copy()
    keep[1:] |= known[:-1]
    out = marks[keep]
    if not known.any():
        return out[:0]
    return np.concatenate([[np.uint32(32)], out[int(out[0] == 32) :], [np.uint32(32)][: int(out[-1] != 32)]]).astype(np.uint32)


def columns_of(symbols: np.ndarray) -> Iterator[np.ndarray]:
    """The hashed n-grams of prepared symbols, slice by slice."""
    for start in range(0, symbols.size, SLICE):
        part = symbols[start : start + SLICE + max(ORDERS) - 1]
        for order in ORDERS:
            n = min(part.size - order + 1, SLICE)
            if n <= 0:
                continue
            h = np.full(n, order, np.uint32)
            for j in range(order):
                h = (h ^ part[j : j + n]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield h & np.uint32(COLUMNS - 1)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            for at in columns_of(letters(text)):
                total = counts.setdefault(lang, np.zeros(COLUMNS, np.int64))
                if at.size > COLUMNS // 8:
                    total += np.bincount(at, minlength=COLUMNS)
                else:
                    np.add.at(total, at, 1)
    for lang, total in counts.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * at.size, pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "col", "n"])


def fit(documents: DataFrame, text: str = "text", lang: str = "lang", smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of shape (languages, columns)."""
    small_batches(documents.sparkSession)
    usable = documents.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    summed = usable.mapInArrow(_count_task, "lang string, col int, n long").groupBy("lang", "col").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    languages = sorted(summed["lang"].unique())
    counts = np.full((len(languages), COLUMNS), smoothing)
    row = {x: i for i, x in enumerate(languages)}
    np.add.at(counts, (summed["lang"].map(row).to_numpy(int), summed["col"].to_numpy(int)), summed["n"].to_numpy(float))
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32) if languages else counts.astype(np.float32)


def sums(texts: list[str | None], by_column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Summed log probabilities, texts x languages, and which texts have letters.

    The sparse matrix has an entry for each n-gram, in the order of texts; some ``SLICE`` entries are multiplied at a time.
    """
    total, lettered = np.zeros((len(texts), by_column.shape[1])), np.zeros(len(texts), bool)
    entries: list[np.ndarray] = []
    rows: list[int] = []
    size = 0

    def multiply() -> None:
        starts = np.cumsum([0, *(e.size for e in entries[:-1])])
        np.add.at(total, rows, np.add.reduceat(by_column[np.concatenate(entries)], starts, axis=0, dtype=np.float64))

    for i, text in enumerate(texts):
        symbols = letters(text or "")
        lettered[i] = symbols.size > 0
        for at in columns_of(symbols):
            entries.append(at)
            rows.append(i)
            size += at.size
            if size >= SLICE:
                multiply()
                entries, rows, size = [], [], 0
    if entries:
        multiply()
    return total, lettered


def classify(documents: DataFrame, model: tuple[list[str], np.ndarray], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, lang_pred and score (the posterior of the predicted language, languages equally likely before)."""
    spark = documents.sparkSession
    small_batches(spark)
    languages, table = model
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(table.T))
    names = [f"kept_{c}" if c in ("lang_pred", "score") else c for c in keep]
    source = "_text"
    while source in names:
        source += "_"
    frame = documents.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(f"`{text}`").alias(source))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_column = shared.value
        for batch in batches:
            texts = batch.column(source).to_pylist()
            predicted, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if languages and texts:
                total, lettered = sums(texts, by_column)
                best = total.argmax(axis=1)
                top = total[np.arange(len(texts)), best]
                scores = np.where(lettered, 1 / np.exp(np.maximum(total - top[:, None], -700)).sum(axis=1), 0.0)
                predicted = [languages[b] if known else UNKNOWN for b, known in zip(best, lettered, strict=True)]
            held = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*held, pa.array(predicted, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in names)
    return frame.mapInArrow(task, f"{kinds}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold("doc_id", 3) == 1).alias("held_out"))
    model = fit(documents.filter(~F.col("held_out")))
    return classify(documents, model, ("doc_id", "held_out"))
