"""Tables written to the shared scratch folder, to cut lineage and fix what recomputing could change."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


@cache
def _own() -> str:
    return f"file://{tempfile.mkdtemp(prefix='quillon-')}"


def folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and all runs on this machine."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (there or _own()).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already
        pass


def place(spark: SparkSession, tag: str) -> str:
    """A new path in the folder; what is written there is deleted when the driver's interpreter ends."""
    path = f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written down and read back: a lost executor then costs a task and not a chain of stages."""
    path = place(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
