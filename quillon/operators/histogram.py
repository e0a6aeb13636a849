"""Histograms: one aggregation, however many processes or groups.

Bins are closed below and open above, but the last is closed on both sides.
Null, NaN and infinite values are left out first. Bins are reported dense.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import finite, safe_div
from .aggregate import quantiles

# Ranges of known columns.
RANGES = {"pRecoil": (0.1, 6.0), "mu1P": (0.0, 5.0), "mu2P": (0.0, 5.0)}
RANGES_WIDE = {
    "M_bc": (5.20, 5.30), "Mbc": (5.20, 5.30), "delta_E": (-0.30, 0.30), "deltaE": (-0.30, 0.30), "pRecoil": (0.1, 6.0),
    "mu1P": (0.0, 3.0), "mu2P": (0.0, 3.0), "mu1Pt": (0.0, 3.0), "mu2Pt": (0.0, 3.0),
}
# The order in which groups are stacked.
STACK = ("BBbar", "qqbar", "taupair", "ee", "mumu", "gg", "hhISR", "llYY")


def edges(lo: float, hi: float, bins: int) -> np.ndarray:
    """bins + 1 edges; the last is exactly hi."""
    return np.linspace(lo, hi, bins + 1)


def bin_within(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of an x that is known to be in [lo, hi]."""
    return F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int"), F.lit(bins - 1))


def bin_index(x: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin of x, null outside [lo, hi]."""
    return F.when((x >= lo) & (x <= hi), bin_within(x, lo, hi, bins))


def default_range(column: str, table: Mapping[str, tuple[float, float]] = RANGES) -> tuple[float, float] | None:
    """The range that a column's name says, if it does; weighted chains go by RANGES_WIDE."""
    if column in table:
        return table[column]
    if column.endswith(("P", "Pt", "Energy", "E")):
        return (0.0, 5.0)
    if "theta" in column.lower():
        return (0.0, math.pi)
    if "phi" in column.lower():
        return (-math.pi, math.pi)
    return None


def minmax_range(df: DataFrame, column: str) -> tuple[float, float]:
    """Exact least and greatest finite value; (0, 1) for none."""
    x = F.col(column).cast("double")
    lo, hi = df.where(finite(F.col(column))).agg(F.min(x), F.max(x)).first()
    return (0.0, 1.0) if lo is None else (lo, hi)


def range_of(df: DataFrame, column: str, table: Mapping[str, tuple[float, float]] = RANGES) -> tuple[float, float]:
    """By name, else the 1st and 99th percentile of all rows and a tenth of their distance on each side; (0, 10) for ten rows or fewer."""
    named = default_range(column, table)
    if named:
        return named
    if df.where(finite(F.col(column))).limit(11).count() <= 10:
        return (0.0, 10.0)
    low, high = quantiles(df, [column], (0.01, 0.99))[column]
    margin = (high - low) * 0.1
    return (low - margin, high + margin)


def hist(
    df: DataFrame,
    column: str,
    bins: int = 50,
    range: tuple[float, float] | None = None,
    weights: str | Column | None = None,
    density: str | None = None,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., bin, lo, hi, count, sumw, sumw2) for each bin, empty ones included.

    weights is a column or expression; without, each row weighs 1. density adds a
    column of that name's kind: "in" divides by the weight within the range, so
    that the integral is 1, "all" by that of all finite rows. With `by`, each of
    its combinations gets all bins, also if no row of it is in range.
    """
    lo, hi = map(float, range or range_of(df, column))
    x = F.col(column).cast("double")
    w = F.lit(1.0) if weights is None else (F.col(weights) if isinstance(weights, str) else weights).cast("double")
    if by or density == "all":
        rows = df.where(finite(F.col(column))).select(*by, bin_index(x, lo, hi, bins).alias("bin"), w.alias("_w"))
    else:
        # No row outside the range counts: the range goes to the file scan, and NaN, infinite and null values with it.
        rows = df.where((x >= lo) & (x <= hi)).select(bin_within(x, lo, hi, bins).alias("bin"), w.alias("_w"))
    if weights is not None:
        rows = rows.where(finite(F.col("_w")))
    weight, square = (F.sum("_w"), F.sum(F.col("_w") * F.col("_w"))) if weights is not None else (F.count(F.lit(1)).cast("double"),) * 2
    sums = rows.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("count"), weight.alias("sumw"), square.alias("sumw2"))
    keys = sums.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = keys.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    named = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("bin").alias("_bin"), "count", "sumw", "sumw2")
    same = F.col("bin") == F.col("_bin")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    width = (hi - lo) / bins
    edge = lambda k: F.when(k == bins, F.lit(hi)).otherwise(F.lit(lo) + k * F.lit(width))
    out = every.join(named, same, "left").select(
        *by, "bin", edge(F.col("bin")).alias("lo"), edge(F.col("bin") + 1).alias("hi"),
        F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("sumw", F.lit(0.0)).alias("sumw"), F.coalesce("sumw2", F.lit(0.0)).alias("sumw2"),
    )
    if density == "in":
        total = F.sum("sumw").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
        return out.withColumn("density", safe_div(F.col("sumw"), total * width))
    if density == "all":
        sums_all = rows.groupBy(*by).agg(F.sum("_w").alias("_all"))
        if by:
            sums_all = sums_all.select(*[F.col(c).alias(f"_{c}") for c in by], "_all")
            on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
            joined = out.join(sums_all, on, "left")
        else:
            joined = out.crossJoin(sums_all)  # one row
        return joined.withColumn("density", safe_div(F.col("sumw"), F.col("_all") * width)).select(*out.columns, "density")
    if density:
        raise ValueError(f"density {density!r}: 'in' or 'all'")
    return out


def observed(df: DataFrame, column: str, lo: float, hi: float, weights: str | None = None) -> tuple[DataFrame, Observation]:
    """df, and what the job that reads it sees of a column: rows, null, not finite, below, above and in range, and their weight.

    The observation's `get` waits for that job; nothing is read twice.
    """
    x, good = F.col(column).cast("double"), finite(F.col(column))
    w = F.lit(1.0) if weights is None else F.col(weights).cast("double")
    within = good & (x >= lo) & (x <= hi) & (F.lit(True) if weights is None else finite(F.col(weights)))
    counts = {"null": x.isNull(), "not_finite": x.isNotNull() & ~good, "below": good & (x < lo), "above": good & (x > hi), "in_range": within}
    watch = Observation()
    sums = [F.coalesce(F.sum(F.when(within, w)), F.lit(0.0)).alias("weight")]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()], *sums), watch


def hist_observed(
    df: DataFrame,
    column: str,
    bins: int = 50,
    range: tuple[float, float] | None = None,
    weights: str | None = None,
) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """Counts (or weights), edges, and what the same job saw (see observed) with its seconds."""
    lo, hi = map(float, range or range_of(df, column))
    seen, watch = observed(df, column, lo, hi, weights)
    start = time.monotonic()
    counts, at = counts_edges(hist(seen, column, bins, (lo, hi), weights), weights is not None)
    return counts, at, watch.get | {"seconds": time.monotonic() - start}


def counts_edges(histogram: DataFrame, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """An ungrouped histogram as arrays of counts and edges."""
    rows = sorted((r["bin"], r["lo"], r["hi"], r["sumw" if weighted else "count"]) for r in histogram.collect())
    return np.array([r[3] for r in rows]), np.array([r[1] for r in rows] + [rows[-1][2]])


def with_errors(histogram: DataFrame) -> DataFrame:
    """Adds error, n_eff, centre and width."""
    return histogram.withColumns(
        {
            "error": F.sqrt("sumw2"),
            "n_eff": safe_div(F.col("sumw") * F.col("sumw"), F.col("sumw2")),
            "centre": (F.col("lo") + F.col("hi")) / 2,
            "width": F.col("hi") - F.col("lo"),
        },
    )


def scaled(histogram: DataFrame, factor: Column | float) -> DataFrame:
    """With each weight multiplied by a factor, which may depend on the keys."""
    f = F.lit(factor) if isinstance(factor, (int, float)) else factor
    return histogram.withColumns({"sumw": F.col("sumw") * f, "sumw2": F.col("sumw2") * f * f})


def grouped(histogram: DataFrame, key: str = "grp") -> DataFrame:
    """Sums the histograms of processes into those of groups."""
    return histogram.groupBy(key, "bin").agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), *[F.sum(c).alias(c) for c in ("count", "sumw", "sumw2")])


def stacked(histogram: DataFrame, key: str = "grp", order: Sequence[str] = STACK) -> DataFrame:
    """Adds stack_from and stack_to, running sums over the groups in stacking order."""
    place = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(key)), F.lit(0))
    place = F.when(place == 0, F.lit(len(order) + 1)).otherwise(place)
    below = Window.partitionBy("bin").orderBy(place, key).rowsBetween(Window.unboundedPreceding, 0)
    to = F.sum("sumw").over(below)
    return histogram.withColumn("stack_to", to).withColumn("stack_from", F.col("stack_to") - F.col("sumw"))


def ratio(data: DataFrame, mc: DataFrame, strict: bool = False) -> DataFrame:
    """(bin, data, mc, ratio, error) of two histograms over the same bins.

    The ratio is 1 where mc is not above 0, with strict 0; errors add in quadrature of
    the relative ones. With strict the errors are those of counts of 1 at least.
    """
    d = data.select("bin", F.col("sumw").alias("data"), F.col("sumw2").alias("d2"))
    m = mc.select("bin", F.col("sumw").alias("mc"), F.col("sumw2").alias("m2"))
    both = d.join(m, "bin")
    sd, sm = (F.sqrt(F.greatest("data", F.lit(1.0))), F.sqrt(F.greatest("mc", F.lit(1.0)))) if strict else (F.sqrt("d2"), F.sqrt("m2"))
    r = F.when(F.col("mc") > 0, F.col("data") / F.col("mc")).otherwise(F.lit(0.0 if strict else 1.0))
    relative = F.sqrt(F.pow(F.coalesce(safe_div(sd, F.col("data")), F.lit(0.0)), 2) + F.pow(F.coalesce(safe_div(sm, F.col("mc")), F.lit(0.0)), 2))
    return both.select("bin", "data", "mc", r.alias("ratio"), (r * relative).alias("error"))


def totals(histogram: DataFrame, key: str = "process", is_data: Column | None = None) -> DataFrame:
    """Events, processes, and weight of data and of simulation."""
    d = is_data if is_data is not None else F.lower(F.col(key)).contains("data")
    return histogram.agg(
        F.sum("count").alias("events"),
        F.countDistinct(key).alias("processes"),
        F.sum(F.when(d, F.col("sumw")).otherwise(0.0)).alias("data"),
        F.sum(F.when(~d, F.col("sumw")).otherwise(0.0)).alias("mc"),
    )


def hist_passed(df: DataFrame, column: str, passed: Column, bins: int, range: tuple[float, float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., bin, passed, total, efficiency) of one table, in one scan: total counts all rows, passed those that a condition keeps."""
    h = hist(df.withColumn("_passed", F.when(passed, 1.0).otherwise(0.0)), column, bins, range, "_passed", by=by)
    out = h.select(*by, "bin", F.col("sumw").cast("long").alias("passed"), F.col("count").alias("total"))
    return out.withColumn("efficiency", safe_div(F.col("passed"), F.col("total")))


def efficiency_counts(selected: DataFrame, baseline: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., bin, passed, total, efficiency) of two histograms over the same bins."""
    s = selected.select(*keys, "bin", F.col("count").alias("passed"))
    b = baseline.select(*keys, "bin", F.col("count").alias("total"))
    both = b.join(s, [*keys, "bin"], "left").withColumn("passed", F.coalesce("passed", F.lit(0)))
    return both.withColumn("efficiency", safe_div(F.col("passed"), F.col("total")))


def moments(histogram: DataFrame) -> DataFrame:
    """Mean and width of a binned distribution, from bin centres, centred at the mean."""
    rows = histogram.select(((F.col("lo") + F.col("hi")) / 2).alias("c"), F.col("sumw").alias("w"))
    first = rows.agg(F.sum("w").alias("norm"), safe_div(F.sum(F.col("w") * F.col("c")), F.sum("w")).alias("mean"))
    d = F.col("c") - F.col("mean")
    wide = rows.crossJoin(first).groupBy("norm", "mean").agg(F.sum(F.col("w") * d * d).alias("s"))  # one row by the bins
    return wide.select("norm", "mean", F.sqrt(F.greatest(safe_div(F.col("s"), F.col("norm")), F.lit(0.0))).alias("sigma"))


@dataclass
class Progress:
    """What a histogram over batches has done."""

    batches: int = 0
    rows: int = 0
    seconds: float = 0.0
    complete: bool = False
    column: str = ""
    history: list[float] = field(default_factory=list)


def hist_batches(
    tables: Iterable[DataFrame],
    column: str,
    bins: int,
    range: tuple[float, float],
    weights: str | None = None,
    time_budget_s: float | None = None,
    progress: Callable[[Progress], None] | None = None,
) -> tuple[np.ndarray, np.ndarray, Progress]:
    """A histogram summed over tables one after the other, stopping once the time is used up.

    Returns counts (or weights), edges, and the progress, whose `complete` says
    whether all tables are in. Without a time budget it is the same as one histogram of their union.
    """
    total, info, start = np.zeros(bins), Progress(column=column), time.monotonic()
    for df in tables:
        if time_budget_s is not None and info.batches and time.monotonic() - start >= time_budget_s:
            break
        counts, _, seen = hist_observed(df, column, bins, range, weights)
        total += counts
        info.batches += 1
        info.rows += int(seen["in_range"])
        info.history.append(time.monotonic() - start - info.seconds)
        info.seconds = time.monotonic() - start
        if progress:
            progress(info)
    else:
        info.complete = True
    return total, edges(*range, bins), info
