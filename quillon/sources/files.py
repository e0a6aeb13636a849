"""Files opened by tasks: footers and single record batches, without a job for each file.

Tasks open files through pyarrow's file systems, which read parts of a file in
place (memory maps for local and mounted ones). Stores that only Spark's own
file systems know are told apart by `reachable`; callers have another way for these.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

#: Schemes of URIs that tasks open by themselves; a path without one is local.
SCHEMES = ("file", "s3", "gs", "hdfs", "abfs", "abfss")
#: Files, or record batches, that a task goes through one after the other, if there are as many.
EACH = 16
#: Tasks at most.
TASKS = 10_000
#: Rows of a batch that is handed on.
ROWS = 10_000


def _place(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "file" == (re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path) or ["", "file"])[1]:
        return pa.fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def reachable(path: str) -> bool:
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    return scheme is None or re.sub(r"^s3[an]$", "s3", scheme[1].lower()) in SCHEMES


def opened(path: str) -> pa.NativeFile:
    fs, at = _place(path)
    return pa.memory_map(at) if isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)


def over_files(spark: SparkSession, paths: Sequence[str], f: Callable[[str], Iterable[tuple]], schema: str) -> DataFrame:
    """Rows that f gives for each path, one job for all: paths are dealt to tasks of EACH."""
    tasks = max(1, min(TASKS, -(-len(paths) // EACH)))
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(tasks)

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for path in batch.column(0).to_pylist() for row in f(path)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.types)], schema=kinds)

    return listed.mapInArrow(run, schema)


def parquet_facts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, size, rows, columns) of parquet files, from their ends; null but for the path where a file isn't there or isn't one."""

    def facts(path: str) -> Iterator[tuple]:
        try:
            fs, at = _place(path)
            info = fs.get_file_info(at)
            if info.type == pa.fs.FileType.NotFound:
                yield path, None, None, None
                return
            if info.type == pa.fs.FileType.Directory:
                inside = [x for x in fs.get_file_info(pa.fs.FileSelector(at)) if x.base_name.endswith(".parquet")]
                at, size = (inside[0].path, sum(x.size for x in inside)) if inside else (at, 0)
            else:
                size = info.size
        except OSError:
            yield path, None, None, None
            return
        try:
            with fs.open_input_file(at) as file:
                meta = pa.parquet.ParquetFile(file)
                yield path, size, meta.metadata.num_rows, meta.schema_arrow.names
        except (pa.ArrowInvalid, OSError):
            yield path, size, None, None

    return over_files(spark, paths, facts, "path string, size long, rows long, columns array<string>")


def arrow_batches(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of Arrow (feather) files; a task reads single record batches of a file, and of these the named columns only.

    The schema is that of the first path; other files are cast to it. One job reads
    all ends of files first, for the number of batches.
    """

    def footer(path: str) -> Iterator[tuple]:
        with opened(path) as file:
            reader = pa.ipc.open_file(file)
            yield path, reader.num_record_batches, reader.schema.remove_metadata().serialize().to_pybytes()

    ends = over_files(spark, paths, footer, "path string, batches int, schema binary")
    total, first = ends.agg(F.sum("batches"), F.first(F.when(F.col("path") == paths[0], F.col("schema")), ignorenulls=True)).first()
    schema = pa.ipc.read_schema(pa.py_buffer(bytes(first)))
    if columns is not None:
        schema = pa.schema([schema.field(c) for c in columns])
    numbered = ends.where("batches > 0").select("path", F.explode(F.sequence(F.lit(0), F.col("batches") - 1)).alias("batch"))
    tasks = max(1, min(TASKS, -(-(total or 0) // EACH), total or 0), min(total or 1, spark.sparkContext.defaultParallelism))
    dealt = numbered.repartition(tasks, "path", "batch").sortWithinPartitions("path", "batch")
    names = schema.names

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, k in zip(*(c.to_pylist() for c in batch.columns)):
                with opened(path) as file:
                    there = pa.ipc.open_file(file).schema.names
                    options = pa.ipc.IpcReadOptions(included_fields=[there.index(n) for n in names])
                    got = pa.ipc.open_file(file, options=options).get_batch(k)
                    yield from pa.Table.from_batches([got]).select(names).cast(schema).to_batches(max_chunksize=ROWS)

    return dealt.mapInArrow(read, from_arrow_schema(schema))
