"""Sinks: files, arrays, iterators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def save(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    """Write as parquet, csv, json or orc, or as one numpy file on the driver (numpy: for results that fit there)."""
    if kind == "numpy":
        np.save(path, df.toPandas().to_records(index=False))
        return
    if kind not in ("parquet", "csv", "json", "orc"):
        raise ValueError(f"unknown format {kind!r}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("header", "true").format(kind).save(path)


def to_pandas(df: DataFrame, max_rows: int | None = None) -> pd.DataFrame:
    return (df if max_rows is None else df.limit(max_rows)).toPandas()


def materialize(df: DataFrame, kind: str = "arrow", path: str | None = None):
    """The result as an arrow table, pandas frame, dict of numpy arrays, or parquet files."""
    if kind in ("auto", "arrow"):
        return df.toArrow()
    if kind == "pandas":
        return df.toPandas()
    if kind == "numpy":
        return to_numpy(df)
    if kind == "parquet" and path:
        return save(df, path)
    raise ValueError(f"unknown form {kind!r}")


def to_numpy(df: DataFrame) -> dict[str, np.ndarray]:
    p = df.toPandas()
    return {c: p[c].to_numpy() for c in p.columns}


def to_list(df: DataFrame, column: str) -> list:
    return [r[0] for r in df.select(column).collect()]


def iter_chunks(df: DataFrame, rows: int = 100_000) -> Iterator[pd.DataFrame]:
    """The result in pandas chunks; one partition at a time is on the driver."""
    it = df.toLocalIterator(prefetchPartitions=True)
    while chunk := list(islice(it, rows)):
        yield pd.DataFrame([tuple(r) for r in chunk], columns=df.columns)
