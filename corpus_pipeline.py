"""The corpus pipeline: five stages from raw documents to packed training sequences.

Each stage works on all that its predecessor kept, written as Parquet and read again;
all but the last return the columns of ``documents``. Null ids are an id like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, exact_dedup, jaccard_join, langid, packing
from graphloom.llm.common import fold, read, scratch

#: The least posterior of its language at which a document stays.
LEAST_SCORE = 0.5


def _only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    wanted = ids.select(F.col("doc_id").alias("_id"))
    return docs.join(wanted, docs["doc_id"].eqNullSafe(wanted["_id"]), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: those without letters, or of no language more likely than all others together."""
    model = langid.fit(docs.filter(fold("doc_id", 3) != 1))
    # the columns go along under names that cannot be those of the results
    own = {c: f"_column_{i}" for i, c in enumerate(docs.columns)}
    found = langid.classify(docs.toDF(*own.values()), model, tuple(own.values()), own["text"])
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*[F.col(to).alias(c) for c, to in own.items()])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group with the same normalised text, and one of rows repeated whole."""
    found = exact_dedup.exact_duplicates(spark, docs)
    return _only(docs, found.filter("kept")).dropDuplicates(["doc_id", "text"])


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of similar ones."""
    found = jaccard_join.jaccard_components(spark, docs)
    return _only(docs, found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, up to edits."""
    found = decontaminate.contaminated(spark, docs, read(spark, sf_dir, "benchmark"), verbatim=True)
    return _only(docs, found.select("doc_id").distinct(), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, packing.default_tokenizer())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("jaccard_join", near),
    ("decontaminate", clean_of_benchmarks),
    ("packing", packed),
]

#: SQL can express neither a trained classifier nor a tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
