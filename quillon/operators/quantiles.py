"""Exact quantiles of columns and of groups, found by rank without gathering values.

A double is mapped to a whole number of 64 bits that keeps the order. The first pass
counts the values of each group by its first BITS bits, and running sums over these
counts say in which part a wanted rank is. Each further pass reads only the columns
with a part that isn't settled, keeps what is between the least and the greatest value
of such a part, and counts it by 2**BITS equal stretches between these two. As values of
a part share all but 48 bits, three such passes, whatever the distribution, leave one
value in a part (a fourth is made where rounding leaves two neighbours together); as soon
as all parts have few values, one more pass settles them. What is shuffled are counts
that each task has summed up; a group with most rows of the table is as many parts as any
other, and the driver learns one number a pass and column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import finite
from ..scratch import written

#: Bits that a pass settles: so many parts of a group are summed up in one task at most.
BITS = 16
#: Values of a part up to which its values are summed up one by one.
FEW = 100_000
#: 2**52, by which one exponent of a double is apart from the next.
_STEP = 1 << 52


def with_order(rows: DataFrame, x: str, key: str) -> DataFrame:
    """rows with a long that keeps the order of the doubles in x: 0 for both zeros, infinities at the ends, NaN last.

    It is the exponent and the fraction as doubles have them. A projection each for
    what is used several times, so that Spark computes it once.
    """
    size, exponent, share = F.abs(x), F.col(f"{key}_e"), F.col(f"{key}_m")
    rows = rows.withColumn(f"{key}_e", F.least(F.greatest(F.coalesce(F.floor(F.log2(size)), F.lit(-1022)), F.lit(-1022)), F.lit(1023)))
    rows = rows.withColumn(f"{key}_m", size / F.pow(F.lit(2.0), exponent))
    # The logarithm may have been rounded over a power of two.
    up, down = share >= 2, (share < 1) & (exponent > -1022)
    bits = (exponent + F.when(up, 1).when(down, -1).otherwise(0) + 1022) * F.lit(_STEP)
    bits = bits + (share * F.when(up, 0.5 * _STEP).when(down, 2.0 * _STEP).otherwise(float(_STEP))).cast("long")
    plain = F.when(F.isnan(x), F.lit(2047 * _STEP + 1)).when(size == float("inf"), F.lit(2047 * _STEP)).otherwise(bits)
    return rows.withColumn(key, F.when(F.col(x) < 0, -plain).otherwise(plain)).drop(f"{key}_e", f"{key}_m")


def long_form(df: DataFrame, keep: Sequence[Column], columns: Mapping[int, Column]) -> DataFrame:
    """Rows (keep.., _c, _x): a row for each of the numbered columns, as double, nulls too."""
    rows = df.select(*keep, F.posexplode(F.array(*[c.cast("double") for c in columns.values()])).alias("_at", "_x"))
    number = F.get(F.array(*map(F.lit, columns)), F.col("_at")).alias("_c")
    return rows.select(*[c for c in rows.columns if c not in {"_at", "_x"}], number, "_x")


def _values(df: DataFrame, by: Sequence[str], columns: Mapping[int, str], only_finite: bool) -> DataFrame:
    """Rows (_g0.., _c, _x, _top): a row for each value that isn't null, with the part of the first pass."""
    x = {k: F.when(finite(F.col(c)), F.col(c).cast("double")) if only_finite else F.col(c) for k, c in columns.items()}
    rows = long_form(df, [F.col(c).alias(f"_g{k}") for k, c in enumerate(by)], x).where("_x IS NOT NULL")
    return with_order(rows, "_x", "_key").withColumn("_top", F.shiftright("_key", 64 - BITS)).drop("_key")


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> tuple[Column, DataFrame]:
    """A condition that the named columns are the same in both, nulls too (but in _c, which has none, so that it may be a key of one long), and b with these renamed."""
    b = b.withColumnsRenamed({n: f"{n}_" for n in names})
    return reduce(Column.__and__, [F.col(n) == F.col(f"{n}_") if n == "_c" else F.col(n).eqNullSafe(F.col(f"{n}_")) for n in names]), b


def _counted(rows: DataFrame, by: list[str], part: str) -> DataFrame:
    """(by.., part, _lo, _hi, _n, _from, _upto): the parts of each key of `by`, their ends and the ranks that they hold."""
    counts = rows.groupBy(*by, part).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_upto", upto).withColumn("_from", F.col("_upto") - F.col("_n"))


def _placed(wanted: DataFrame, counted: DataFrame, by: list[str]) -> DataFrame:
    """wanted with the part that holds each rank, its ends, the rank within it, and how many values it has; 0 if they are all the same."""
    same, counted = _same(wanted, counted, by)
    inside = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_upto"))
    names = dict.fromkeys([*[n for n in wanted.columns if n not in {"_rank", "_a"}], "_top"])
    return wanted.join(counted, same & inside).select(
        *names,
        (F.col("_rank") - F.col("_from")).alias("_rank"),
        F.when(F.col("_lo") == F.col("_hi"), 0).otherwise(F.col("_n")).alias("_n"),
        "_lo",
        "_hi",
    )


def group_quantiles(df: DataFrame, by: Sequence[str], columns: Sequence[str], at: Sequence[float], only_finite: bool = True, few: int = FEW) -> DataFrame:
    """(_g0.., _c, _q, value): quantile number _q of column number _c in each group, linear between ranks.

    Groups without a value of a column have no row for it. A null key is a group. Without only_finite, NaN counts as the
    greatest value. df is read once for each pass, so it has to give the same rows each time.
    """
    group = [*[f"_g{k}" for k in range(len(by))], "_c"]
    counted = written(_counted(_values(df, by, dict(enumerate(columns)), only_finite), group, "_top"), "quantile-parts")
    totals = counted.groupBy(*group).agg(F.max("_upto").alias("_total"))
    place = (F.col("_total") - 1) * F.col("_at.share")
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("q"), F.lit(float(q)).alias("share")) for k, q in enumerate(at)])).alias("_at")
    ends = F.explode(F.array(F.floor("_place"), F.ceil("_place"))).alias("_rank")
    wanted = totals.select(*group, "_total", asked).select(*group, F.col("_at.q").alias("_q"), place.alias("_place")).select(*group, "_q", "_place", ends)
    wanted = written(_placed(wanted.withColumn("_end", F.col("_rank")), counted, group), "quantile-ranks")
    while most := dict(wanted.where("_n > 0").groupBy("_c").agg(F.max("_n")).collect()):
        rows = _values(df, by, {k: columns[k] for k in sorted(most)}, only_finite)
        parts = wanted.where("_n > 0").select(*group, "_top", F.col("_lo").alias("_a"), F.col("_hi").alias("_b")).distinct()
        # With the part of the first pass, a large group isn't one key of the join; without groups, it needn't be computed again.
        same, parts = _same(rows, parts, [*group, "_top"] if by else group)
        stretch = F.floor((F.col("_x") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (1 << BITS))
        part = F.col("_x") if max(most.values()) <= few else stretch
        inside = rows.join(parts, same & F.col("_x").between(F.col("_a"), F.col("_b"))).select(*group, "_a", "_x", part.alias("_next"))
        open_ = wanted.where("_n > 0").withColumn("_a", F.col("_lo")).drop("_n", "_lo", "_hi")
        placed = _placed(open_, _counted(inside, [*group, "_a"], "_next"), [*group, "_a"])
        wanted = written(wanted.where("_n = 0").unionByName(placed), "quantile-ranks")
    pair = wanted.groupBy(*group, "_q", "_place").agg(F.min_by("_lo", "_end").alias("lo"), F.max_by("_lo", "_end").alias("hi"))
    between = F.col("lo") + (F.col("_place") - F.floor("_place")) * (F.col("hi") - F.col("lo"))
    return pair.select(*group, "_q", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(between).alias("value"))


def group_medians(df: DataFrame, by: Sequence[str], names: dict[str, str], few: int = FEW) -> DataFrame:
    """(by.., names): the median of each column of names {new name: column} in each group that has values of any."""
    columns = list(dict.fromkeys(names.values()))
    found = group_quantiles(df, by, columns, (0.5,), only_finite=False, few=few)
    each = [F.max(F.when(F.col("_c") == columns.index(c), F.col("value"))).alias(new) for new, c in names.items()]
    keys = [f"_g{k}" for k in range(len(by))]
    return found.groupBy(*keys).agg(*each).withColumnsRenamed(dict(zip(keys, by)))
