"""Sessions and tables."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def session(name: str = "quillon", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; other settings are the cluster's.

    The JVM never compiles methods above 8000 bytes, so wide projections are
    generated in parts beyond that rather than as one method that stays interpreted.
    """
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.codegen.hugeMethodLimit", "8000")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def small(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of a few rows that the driver has.

    Handed over as Arrow, Spark knows its size and broadcasts it by itself; from Python rows it doesn't,
    and a join would deal the other table by a key of which a few tasks get all rows.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.types)], schema=kinds))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
