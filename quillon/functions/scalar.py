"""Column functions with the semantics of the selection language."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def floor_div(a: Column, b: Column) -> Column:
    return F.floor(safe_div(a, b))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of b, as Python has it; null where b is 0."""
    return a - b * floor_div(a, b)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi]; NaN stays NaN and null stays null (least and greatest alone skip nulls)."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.least(F.greatest(x, F.lit(lo)), F.lit(hi))).otherwise(x)


def finite(x: Column) -> Column:
    """Whether x is neither null, NaN nor infinite."""
    d = x.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(math.inf))


def fill_nan(x: Column, value: float) -> Column:
    """NaN becomes value; null stays."""
    return F.when(F.isnan(x), F.lit(value)).otherwise(x)


def is_between(x: Column, lo: float, hi: float) -> Column:
    return x.between(lo, hi)


def min_horizontal(*columns: Column) -> Column:
    """The least of the columns that aren't null."""
    return F.least(*columns) if len(columns) > 1 else columns[0]


def nan_sum(x: Column) -> Column:
    return F.sum(F.when(~F.isnan(x), x))


def nan_mean(x: Column) -> Column:
    return F.avg(F.when(~F.isnan(x), x))


def hash_bucket(x: Column, buckets: int = 100) -> Column:
    """A bucket that depends on x alone, so that rows of one event stay together."""
    return F.pmod(F.xxhash64(x), F.lit(buckets))


#: Parts of a timestamp by name.
DATE_PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}


def date_part(x: Column, part: str) -> Column:
    return DATE_PARTS[part](x)


def edit_distance(a: Column, b: Column, most: int | None = None) -> Column:
    """Edit distance; -1 above `most`."""
    return F.levenshtein(a, b) if most is None else F.levenshtein(a, b, most)


def cast(x: Column, kind: str, lenient: bool = False) -> Column:
    """Strict cast raises on bad input; lenient gives null."""
    return x.try_cast(kind) if lenient else x.cast(kind)
