"""Materialising intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all machines share; where it is unset, a new folder on a single machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        if at.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
            at = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = at.get()
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str = "table") -> str:
    """A new path in the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/graphloom-tables/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(frame: DataFrame, name: str = "table") -> DataFrame:
    """``frame`` written to the shared folder and read again: short lineage, no recomputation."""
    spark = frame.sparkSession
    path = table_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """Rows of few bytes that take much work, dealt by ``keys`` to all cores: a small file would be a single task."""
    return frame.repartition(max(32, 4 * frame.sparkSession.sparkContext.defaultParallelism), *keys)


def bounded(frame: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must be small to be collected; an error beyond the bound."""
    rows = frame.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows
