"""Histograms and selections over streams.

A histogram is a mergeable sum, so the batch expressions run unchanged under
readStream: bin, group, sum. Windows and watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import finite
from ..operators.histogram import bin_index


def read_stream(spark: SparkSession, path: str, schema: str, files: int = 100) -> DataFrame:
    """New parquet files of a directory, at most so many in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def stream_hist(stream: DataFrame, column: str, bins: int, lo: float, hi: float, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Running (by..., bin, count, sumw, sumw2); write with output mode complete or update."""
    x, w = F.col(column).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = stream.where(finite(F.col(column))).withColumn("bin", bin_index(x, lo, hi, bins)).where("bin IS NOT NULL")
    return rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"), F.sum(w).alias("sumw"), F.sum(w * w).alias("sumw2"))


def windowed_hist(stream: DataFrame, time_col: str, column: str, bins: int, lo: float, hi: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """A histogram per time window; rows later than `late` are dropped and closed windows leave the state."""
    rows = stream.withWatermark(time_col, late).where(finite(F.col(column))).withColumn("bin", bin_index(F.col(column).cast("double"), lo, hi, bins))
    out = rows.where("bin IS NOT NULL").groupBy(F.window(time_col, window), "bin").agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "bin", "count")


def first_candidates(stream: DataFrame, keys: Sequence[str], time_col: str, late: str = "10 minutes") -> DataFrame:
    """The first candidate of each event to arrive; state is kept for the watermark's span."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(list(keys))
