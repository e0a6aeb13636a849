"""Helpers that the operators of this folder share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One word: a run of bytes other than ASCII white space (Java and DuckDB syntax).
WORD = r"[^\x20\x09-\x0D]+"
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except AttributeError:  # another C library
    _TRIM = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@cache
def _own_dir() -> str:
    return f"file://{tempfile.mkdtemp(prefix='quillon-')}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Only where it is unset and all runs on this machine (tests) a local folder is
    made; on a cluster the executors couldn't read one another's files in it.
    """
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (there or _own_dir()).rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session has ended already; the folder is scratch space
        pass


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs one task, not a chain of
    stages. The table is deleted when the driver's interpreter ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[str], rank: str, tag: str) -> DataFrame:
    """df with a long column of global row numbers from 1 in the given order.

    Range partitions bound each window; only one count per range partition
    goes through the driver, so no task ever holds the whole order.
    """
    spark = df.sparkSession
    n = shuffle_partitions(spark)
    by = [F.col(c).asc_nulls_last() for c in order]
    dealt = materialise(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), tag)
    total, starts = 0, []
    for part, count in sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect()):
        starts.append((part, total))
        total += count
    start = spark.createDataFrame(starts, "_part int, _start long")
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return (
        dealt.withColumn(rank, within)
        .join(F.broadcast(start), "_part")
        .withColumn(rank, F.col(rank) + F.col("_start"))
        .drop("_part", "_start")
    )


#: Ranks up to which Spark cuts rows before the shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
_CUT = 1000


def lowest(df: DataFrame, by: str, order: list[str], n: int) -> DataFrame:
    """At most n rows of each value of `by`, the first in the given order.

    Each task passes on at most n rows of a value, so one that most rows have
    isn't gathered in one task. Beyond _CUT rows these are the first _CUT (or
    fewer) of as many shares, dealt by a hash of `order`, as make up n.
    """
    shares = -(-n // _CUT)
    share = F.pmod(F.xxhash64(*order, F.lit(1)), F.lit(shares))
    window = Window.partitionBy(by, "_quillon_share").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    ranked = df.withColumn("_quillon_share", share).withColumn("_quillon_rank", F.row_number().over(window))
    return ranked.where(F.col("_quillon_rank") <= n // shares).drop("_quillon_rank", "_quillon_share")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether a document belongs to the fold that training must not see."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def held_out_py(doc_id: object, folds: int, fold: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == fold


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits doesn't hold it."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


class Remembered(dict):
    """What `make` gave for a key, kept for between `size` and 2 * `size` latest keys.

    Keys longer than `longest` are computed each time, so memory is bounded.
    """

    def __init__(self, make: Callable, size: int, longest: int = 48):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[key] = got
        return got
