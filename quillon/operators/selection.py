"""One candidate per event, and row access that needs an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import written

#: Columns that identify an event, as far as a table has them.
EVENT_KEYS = ("__experiment__", "__run__", "__event__", "__production__")
#: Column by which the best candidate of a decay mode is chosen.
MODE_SORT = {"B_meson": "chiProb", "D_meson": "M", "tau": "decayModeScore"}


def event_keys(df: DataFrame) -> list[str]:
    keys = [k for k in EVENT_KEYS if k in df.columns]
    if not keys:
        raise ValueError("no event identity column in the table; name the keys")
    return keys


def one_candidate(
    df: DataFrame, keys: Sequence[str] | None = None, sort_col: str | None = None, ascending: bool = False, tiebreak: Sequence[str] = (), seed: int = 42, decisive: bool = False
) -> DataFrame:
    """One row for each combination of keys.

    With sort_col the row with the largest value (smallest if ascending); null
    values never win, and an event with none but nulls disappears. Without, the
    first by tiebreak (by all columns if there is none). sort_col="random" chooses by the MD5 of
    seed, keys and tiebreak as text. Ties go by tiebreak, then by a hash of the row; without a tiebreak
    by all orderable columns. So reruns agree. decisive says that sort_col and tiebreak tell all rows of an event
    apart: then columns that aren't asked for later are neither read nor shuffled.
    """
    keys = list(keys) if keys else event_keys(df)
    rest = [c for c, t in df.dtypes if c not in {*keys, *tiebreak, sort_col} and not t.startswith(("map", "variant"))]
    last = [] if decisive and (tiebreak or sort_col) else [F.xxhash64(*rest)] if tiebreak and rest else [F.col(c).asc_nulls_last() for c in rest]
    order: list[Column] = [*[F.col(c).asc_nulls_last() for c in tiebreak], *last]
    if sort_col == "random":
        order.insert(0, F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, *(tiebreak or rest))])))
    elif sort_col is not None:
        df = df.where(F.col(sort_col).isNotNull())
        order.insert(0, F.col(sort_col).asc() if ascending else F.col(sort_col).desc())
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    # Spark cuts each partition to its best rows before the shuffle (WindowGroupLimit).
    return df.withColumn("_nr", nr).where("_nr = 1").drop("_nr")


def one_candidate_any(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Any one row for each combination of keys."""
    return df.dropDuplicates(list(keys) if keys else event_keys(df))


def one_candidate_by_mode(df: DataFrame, mode: str, keys: Sequence[str] | None = None, ascending: bool = False) -> DataFrame:
    return one_candidate(df, keys, MODE_SORT[mode], ascending)


def best_by(df: DataFrame, keys: Sequence[str], sort_col: str) -> DataFrame:
    """As one_candidate with the largest sort_col, by one aggregation with partial sums instead of a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.where(F.col(sort_col).isNotNull()).groupBy(*keys).agg(F.max(F.struct(F.col(sort_col).alias("_s"), *rest)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def row_index(df: DataFrame, order: Sequence[str], name: str = "row_nr") -> DataFrame:
    """Row numbers from 0 in the given order, by range partitions: no single task holds the order."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(c).asc_nulls_last() for c in order]
    # Written once: range bounds come from a sample that another run would draw anew.
    dealt = written(df.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()), "row-index")
    counts = sorted((r[0], r[1]) for r in dealt.groupBy("_part").count().collect())  # one row a partition
    starts, total = [], 0
    for part, count in counts:
        starts.append((part, total))
        total += count
    start = spark.createDataFrame(starts, "_part int, _start long")
    nr = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return dealt.withColumn(name, nr).join(F.broadcast(start), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def slice_rows(df: DataFrame, order: Sequence[str], start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
    """Rows start:stop:step in the given order, as Python slices a list: from the end where negative, backwards with a negative step."""
    step = 1 if step is None else step
    if step > 0 and (start or 0) >= 0 and (stop is None or stop >= 0):
        start = start or 0
        if step == 1 and stop is not None:
            # Spark takes the first rows of each task.
            out = df.orderBy(*order).limit(max(0, stop))
            return out.offset(start) if start else out
        if not start and step == 1:
            return df.orderBy(*order)
        nr = row_index(df, order, "_nr")
        keep = (F.col("_nr") >= start) & ((F.col("_nr") - start) % step == 0)
        return nr.where(keep if stop is None else keep & (F.col("_nr") < stop)).orderBy("_nr").drop("_nr")
    nr = row_index(df, order, "_nr")
    first, end, step = slice(start, stop, step).indices(nr.count())
    low, high = (first, end) if step > 0 else (end + 1, first + 1)
    kept = nr.where((F.col("_nr") >= low) & (F.col("_nr") < high) & (F.abs(F.col("_nr") - first) % abs(step) == 0))
    return kept.orderBy(F.col("_nr").asc() if step > 0 else F.col("_nr").desc()).drop("_nr")


def take(df: DataFrame, order: Sequence[str], positions: Sequence[int]) -> DataFrame:
    """Rows at the given positions, in their order; negative ones count from the end, one given twice gives its row twice.

    A position that the table doesn't have is an IndexError.
    """
    nr = row_index(df, order, "_nr")
    n = nr.count()
    places = [int(p) + n if p < 0 else int(p) for p in positions]
    wrong = [p for p, at in zip(positions, places) if not 0 <= at < n]
    if wrong:
        raise IndexError(f"no row {wrong[0]} among {n}")
    wanted = df.sparkSession.createDataFrame(list(enumerate(places)), "_at long, _nr long")
    return nr.join(wanted, "_nr").orderBy("_at").drop("_nr", "_at")


def hash_sample(df: DataFrame, fraction: float, key: str = "__event__") -> DataFrame:
    """Whole events, kept or dropped by the MD5 of their key as text."""
    share = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return df.where(share < fraction)


def head(df: DataFrame, n: int = 5, order: Sequence[str] = ()) -> DataFrame:
    return (df.orderBy(*order) if order else df).limit(n)


def tail(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
