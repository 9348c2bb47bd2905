"""Incremental processing: resumable batches from appended files, and running counts.

The stream reads only what is new since its checkpoint, so a rerun continues where the
last one stopped. Running edge counts over events are an extension.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def new_rows(spark: SparkSession, schema: str, folder: str, form: str = "json", most_files: int | None = None) -> DataFrame:
    """A stream of what is appended to a folder."""
    reader = spark.readStream.schema(schema).format(form)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.load(folder)


def resume(rows: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str = "id") -> None:
    """Works through all new rows once, each key the first time it comes, and writes the results as JSON lines.

    Each batch has a folder of its own (``out/batch=0`` and so on). A batch whose end was not noted, because the run was stopped
    behind the write, comes again with the same number and the same rows and replaces its folder, so no row is there twice.
    """

    def batch(frame: DataFrame, number: int) -> None:
        work(frame).write.mode("overwrite").json(f"{out}/batch={number}")

    query = rows.dropDuplicates([key]).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
    query.awaitTermination()


def running_edges(paths: DataFrame, relations: Column) -> DataFrame:
    """src, dst, weight so far over a stream of documents; for update or complete output."""
    return paths.select(F.inline(F.array_distinct(relations))).groupBy("src", "dst").agg(F.count("*").alias("weight"))


def windowed_counts(events: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("window"), *keys).agg(F.count("*").alias("n"))
