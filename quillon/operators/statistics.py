"""Intervals and uncertainties per row, so that a histogram gets one per bin."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from pyspark.sql.functions import pandas_udf

from ..functions import special
from ..functions.scalar import safe_div
from .aggregate import weighted_moments

#: Confidence of one standard deviation.
ONE_SIGMA = 0.6827
INTERVAL = "lower double, upper double"


def z_value(level: float = ONE_SIGMA) -> float:
    return special.normal_quantile(0.5 + level / 2)


def _interval(f: Callable[..., tuple[np.ndarray, np.ndarray]]):
    """A pandas UDF giving (lower, upper) from numeric columns; a null in gives nulls out."""

    def run(*columns: pd.Series) -> pd.DataFrame:
        values = [c.to_numpy(float) for c in columns]
        ok = ~np.any([np.isnan(v) for v in values], axis=0)
        out = np.full((2, len(ok)), np.nan)
        if ok.any():
            out[:, ok] = f(*[v[ok] for v in values])
        return pd.DataFrame({"lower": out[0], "upper": out[1]}).where(lambda d: d.notna(), None)

    if f.__code__.co_argcount == 1:
        return pandas_udf(lambda a: run(a), INTERVAL)  # the UDF's arity comes from its signature
    return pandas_udf(lambda a, b: run(a, b), INTERVAL)


def poisson_exact(n: str | Column, level: float = ONE_SIGMA) -> Column:
    """Central interval of a Poisson mean from quantiles of the gamma distribution."""
    alpha = 1 - level

    def f(n):
        lower = np.where(n > 0, special.gamma_quantile(alpha / 2, np.maximum(n, 1e-9)), 0.0)
        return lower, special.gamma_quantile(1 - alpha / 2, n + 1)

    return _interval(f)(n)


def clopper_pearson(k: str | Column, n: str | Column, level: float = ONE_SIGMA) -> Column:
    """Exact binomial interval of k of n; (0, 1) for no trials."""
    alpha = 1 - level

    def f(k, n):
        lower = np.where(k > 0, special.beta_quantile(alpha / 2, np.maximum(k, 1e-9), np.maximum(n - k + 1, 1e-9)), 0.0)
        upper = np.where(k < n, special.beta_quantile(1 - alpha / 2, k + 1, np.maximum(n - k, 1e-9)), 1.0)
        return np.where(n > 0, lower, 0.0), np.where(n > 0, upper, 1.0)

    return _interval(f)(k, n)


def beta_interval(k: str | Column, n: str | Column, level: float = ONE_SIGMA, prior: tuple[float, float] = (0.5, 0.5), shortest: bool = False) -> Column:
    """Bayesian binomial interval: equal tails, or the shortest one. The default prior is Jeffreys'; (1, 1) is uniform."""
    alpha = 1 - level

    def f(k, n):
        a, b = k + prior[0], n - k + prior[1]
        if not shortest:
            return special.beta_quantile(alpha / 2, a, b), special.beta_quantile(1 - alpha / 2, a, b)
        lo, hi = np.zeros(a.shape), np.full(a.shape, alpha)
        size = lambda t: special.beta_quantile(np.minimum(t + level, 1), a, b) - special.beta_quantile(t, a, b)
        for _ in range(25):  # ternary search of the lower tail
            m1, m2 = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            left = size(m1) < size(m2)
            lo, hi = np.where(left, lo, m1), np.where(left, m2, hi)
        tail = (lo + hi) / 2
        return special.beta_quantile(tail, a, b), special.beta_quantile(np.minimum(tail + level, 1), a, b)

    return _interval(f)(k, n)


def jeffreys_poisson(n: str | Column, level: float = ONE_SIGMA) -> Column:
    alpha = 1 - level
    return _interval(lambda n: (special.gamma_quantile(alpha / 2, n + 0.5), special.gamma_quantile(1 - alpha / 2, n + 0.5)))(n)


def barlow_beeston(sumw: str | Column, sumw2: str | Column, level: float = ONE_SIGMA) -> Column:
    """Interval of a weighted count: that of its effective number, scaled back."""
    alpha = 1 - level

    def f(w, ww):
        some = ww > 0
        n = np.where(some, w * w / np.where(some, ww, 1), 0)
        # The mean weight takes an effective number back to the weighted count.
        unit = np.where(some, np.sqrt(np.where(some, ww, 0) / np.maximum(n, 1e-300)), 1)
        return special.gamma_quantile(alpha / 2, n + 0.5) * unit, special.gamma_quantile(1 - alpha / 2, n + 0.5) * unit

    return _interval(f)(sumw, sumw2)


def profile_likelihood(total: str | Column, n: str | Column, level: float = ONE_SIGMA) -> Column:
    """Interval of a Poisson mean from n observations with the given total, by the drop of the log likelihood."""
    drop = z_value(level) ** 2 / 2

    def f(total, n):
        best = total / n
        like = lambda m: np.where(total > 0, total * np.log(np.maximum(m, 1e-300)), 0) - n * m
        floor = like(best) - drop
        lo, hi = np.zeros(best.shape), best.copy()
        for _ in range(100):
            mid = (lo + hi) / 2
            out = like(mid) < floor
            lo, hi = np.where(out, mid, lo), np.where(out, hi, mid)
        a, b = best.copy(), best + 10 * np.sqrt((best + 1) / n) + 10 * drop / n
        for _ in range(100):
            mid = (a + b) / 2
            out = like(mid) < floor
            a, b = np.where(out, a, mid), np.where(out, mid, b)
        return np.where(total > 0, hi, 0.0), a

    return _interval(f)(total, n)


def wilson(k: Column, n: Column, level: float = ONE_SIGMA) -> tuple[Column, Column]:
    z = z_value(level)
    p, size = safe_div(k, n), n + z * z
    mid, half = (k + z * z / 2) / size, z * n / size * F.sqrt(safe_div(p * (1 - p), n) + safe_div(F.lit(z * z / 4), n * n))
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def agresti_coull(k: Column, n: Column, level: float = ONE_SIGMA) -> tuple[Column, Column]:
    z = z_value(level)
    size = n + z * z
    p = (k + z * z / 2) / size
    half = z * F.sqrt(p * (1 - p) / size)
    return F.greatest(p - half, F.lit(0.0)), F.least(p + half, F.lit(1.0))


def log_factorial(k: Column) -> Column:
    """ln k! for k of 0 or more: Stirling's series from 11 on, to which smaller values are multiplied up."""
    x = F.when(k < 10, k + F.ceil(10 - k)).otherwise(k) + 1.0
    steps = F.lit(1.0)
    for j in range(1, 11):
        steps = steps * F.when(k + j < 11, k + float(j)).otherwise(1.0)
    tail = sum(1 / (c * F.pow(x, F.lit(float(p)))) for c, p in ((12, 1), (-360, 3), (1260, 5), (-1680, 7), (1188, 9)))
    return (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + tail - F.ln(steps)


def poisson_logpmf(k: Column, mu: Column) -> Column:
    """k ln mu - mu - ln k!, as an expression."""
    return k * F.ln(mu) - mu - log_factorial(k)


def systematics(df: DataFrame, nominal: str, stat: str, variations: Sequence[str]) -> DataFrame:
    """Adds syst (shifts in quadrature) and total (with the statistical error)."""
    s = sum((F.pow(F.col(v) - F.col(nominal), 2) for v in variations), F.lit(0.0))
    return df.withColumns({"syst": F.sqrt(s), "total": F.sqrt(s + F.pow(stat, 2))})


def propagate(df: DataFrame, weight: str, sigma: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., error) of a weighted mean of values with errors."""
    w = F.col(weight)
    sums = df.groupBy(*by).agg(F.sum(F.pow(w * F.col(sigma), 2)).alias("_s"), F.sum(w).alias("_w"))
    return sums.select(*by, safe_div(F.sqrt("_s"), F.col("_w")).alias("error"))


def weighted_scaling(error: Column, n: Column, n_eff: Column) -> Column:
    """Errors of a method without weights, made wider for weighted rows."""
    return error * F.sqrt(safe_div(n, n_eff))


_SHARE = {"weights": False, "counts": True, "least": 1, "of": lambda k, n: safe_div(k, n)}
_COUNT = {"weights": False, "counts": True, "least": 1, "of": lambda k, n: k}
_DRAWN = {"weights": True, "counts": False, "of": None}
#: What each method needs, and what its interval is about.
METHODS = {
    **dict.fromkeys(("clopper_pearson", "wilson", "agresti_coull", "jeffreys", "uniform_hpd", "profile_likelihood"), _SHARE),
    **dict.fromkeys(("poisson_exact", "jeffreys_poisson"), _COUNT),
    "barlow_beeston": _COUNT | {"weights": True},
    "bootstrap_percentile": _DRAWN | {"least": 2},
    "bootstrap_bca": _DRAWN | {"least": 10},
}


def intervals(df: DataFrame, method: str, k: str = "k", n: str = "n", level: float = ONE_SIGMA) -> DataFrame:
    """df with lower and upper by a method of METHODS; methods of counts alone don't read n."""
    pair = {"wilson": wilson, "agresti_coull": agresti_coull}
    if method in pair:
        low, high = pair[method](F.col(k), F.col(n), level)
        return df.withColumns({"lower": low, "upper": high})
    found = {
        "clopper_pearson": lambda: clopper_pearson(k, n, level), "jeffreys": lambda: beta_interval(k, n, level=level),
        "uniform_hpd": lambda: beta_interval(k, n, prior=(1.0, 1.0), level=level, shortest=True), "poisson_exact": lambda: poisson_exact(k, level),
        "jeffreys_poisson": lambda: jeffreys_poisson(k, level), "profile_likelihood": lambda: profile_likelihood(k, n, level), "barlow_beeston": lambda: barlow_beeston(k, n, level),
    }
    if method not in found:
        raise ValueError(f"unknown method {method!r}; known: {', '.join([*pair, *found])}")
    return df.withColumn("_i", found[method]()).select(*df.columns, "_i.lower", "_i.upper")


def auto_intervals(df: DataFrame, k: str = "k", n: str = "n", sumw2: str | None = None, level: float = ONE_SIGMA) -> DataFrame:
    """intervals by the method that suits the number of rows and the values; sumw2 is there for weighted ones.

    Where auto_method says bootstrap_bca, rows have to be drawn, which sums of weights no longer have: then this
    raises a ValueError, and bootstrap_mean with the rows' weights is what to use.
    """
    rows, whole = df.agg(F.count(F.lit(1)), F.min(F.col(k) == F.floor(F.col(k)))).first()
    method = auto_method(rows, bool(whole), sumw2 is not None)
    if not METHODS[method]["counts"]:
        raise ValueError(f"{method} needs rows and not counts: use bootstrap_mean")
    if sumw2 is not None and not METHODS[method]["weights"]:
        # Errors of a method without weights are those of effective numbers.
        size = safe_div(F.col(k) * F.col(k), F.col(sumw2))
        found = intervals(df.withColumn("_eff", safe_div(size, F.col(n))), method, k, n, level)
        wider = weighted_scaling(F.lit(1.0), F.lit(1.0), F.least(F.col("_eff"), F.lit(1.0)))
        mid = METHODS[method]["of"](F.col(k), F.col(n))
        return found.withColumns({"lower": mid - (mid - F.col("lower")) * wider, "upper": mid + (F.col("upper") - mid) * wider}).drop("_eff")
    return intervals(df, method, k, sumw2 if method == "barlow_beeston" else n, level)


def method_info(name: str) -> dict[str, object]:
    """What a method needs: whether it takes weights, counts alone, and how many values at least."""
    if name not in METHODS:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(METHODS)}")
    return {k: v for k, v in METHODS[name].items() if k != "of"}


def hist_uncertainty(histogram: DataFrame, weighted: bool = False, level: float = ONE_SIGMA, method: str = "poisson_exact") -> DataFrame:
    """Adds lower and upper for each bin: by sums of squares if weighted, else by a method for counts."""
    if weighted:
        return intervals(histogram, "barlow_beeston", "sumw", "sumw2", level)
    rows = histogram.withColumns({"_k": F.col("count").cast("double"), "_n": F.sum(F.col("count").cast("double")).over(Window.partitionBy(F.lit(1)))})
    return intervals(rows, method, "_k", "_n", level).drop("_k", "_n")


def jackknife_acceleration(rows: DataFrame, x: str = "x", w: str = "w") -> DataFrame:
    """(n, mean, acceleration) of a weighted mean, from the means that leave out one row each.

    One pass sums up all rows; the means without a row follow from these sums, and a second one sums up their
    second and third moments. Without weights the result is skewness / (6 sqrt(n)).
    """
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("_s"), safe_div(F.sum(F.col(w) * F.col(x)), F.sum(w)).alias("mean"))
    # The mean without a row, less the mean of all.
    off = safe_div(F.col(w) * (F.col("mean") - F.col(x)), F.col("_s") - F.col(w))
    each = rows.crossJoin(total).select(off.alias("_d"))  # one row
    sums = total.crossJoin(each.agg(*[F.coalesce(F.sum(F.pow("_d", F.lit(float(p)))), F.lit(0.0)).alias(f"_{p}") for p in (1, 2, 3)]))  # one row each
    mid = F.coalesce(safe_div(F.col("_1"), F.col("n")), F.lit(0.0))
    second = F.greatest(F.col("_2") - F.col("n") * mid * mid, F.lit(0.0))
    third = -(F.col("_3") - 3 * mid * F.col("_2") + 2 * F.col("n") * mid * mid * mid)
    return sums.select("n", "mean", F.coalesce(safe_div(third, 6 * F.pow(second, 1.5)), F.lit(0.0)).alias("acceleration"))


def bootstrap_mean(
    df: DataFrame, column: str, replicas: int = 2000, seed: int = 42, level: float = ONE_SIGMA, key: str | None = None, weight: str | None = None
) -> DataFrame:
    """(n, mean, lower, upper, lower_bca, upper_bca): intervals of the mean, weighted if asked, by a Poisson bootstrap.

    How often a replica draws a row comes from the hash of the row's key (default: all columns) and
    the replica, so the result is the same however rows are dealt. Each batch
    leaves one pair of sums per replica. lower_bca and upper_bca are bias-corrected, and
    accelerated by the jackknife.
    """
    keys = [key] if key else df.columns
    own = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(column).isNotNull() & own.isNotNull()).select(F.col(column).cast("double").alias("x"), own.alias("w"), F.xxhash64(*keys).alias("h"))
    chance = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])

    def sums(batches):
        w, wx = np.zeros(replicas), np.zeros(replicas)
        with np.errstate(over="ignore"):
            for batch in batches:
                one, h = batch["w"].to_numpy(), batch["h"].to_numpy().astype(np.uint64)
                x = batch["x"].to_numpy() * one
                for b in range(replicas):
                    u = h + np.uint64(((seed * 1_000_003 + b + 1) * 0x9E3779B97F4A7C15) % 2**64)
                    u = (u ^ (u >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    u = (u ^ (u >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    n = np.searchsorted(chance, ((u ^ (u >> np.uint64(31))) >> np.uint64(11)) / 2.0**53)
                    w[b] += n @ one
                    wx[b] += n @ x
        yield pd.DataFrame({"b": np.arange(replicas), "w": w, "wx": wx})

    means = rows.mapInPandas(sums, "b int, w double, wx double").groupBy("b").agg(safe_div(F.sum("wx"), F.sum("w")).alias("m"))
    alpha = 1 - level
    drawn = means.agg(F.sort_array(F.collect_list("m")).alias("ms"))  # as many as replicas, fewer where one drew nothing
    z = z_value(level)

    @pandas_udf("lower double, upper double, lower_bca double, upper_bca double")
    def ends(ms: pd.Series, mean: pd.Series, acceleration: pd.Series) -> pd.DataFrame:
        out = []
        for m, mid, a in zip(ms, mean, acceleration):
            m = np.asarray(m)
            if not len(m):
                out.append([None] * 4)
                continue
            z0 = special.normal_quantile(min(max((m < mid).mean(), 0.5 / len(m)), 1 - 0.5 / len(m)))
            cdf = lambda t: 0.5 * math.erfc(-t / math.sqrt(2))
            low, high = (cdf(z0 + (z0 + t) / (1 - a * (z0 + t))) for t in (-z, z))
            out.append([*np.quantile(m, [alpha / 2, 1 - alpha / 2]), *np.quantile(m, [low, high])])
        return pd.DataFrame(out, columns=["lower", "upper", "lower_bca", "upper_bca"])

    both = jackknife_acceleration(rows).crossJoin(drawn)  # one row each
    return both.withColumn("e", ends("ms", "mean", "acceleration")).select("n", "mean", "e.*")


def column_statistics(df: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """(mean, n_eff, var, error) of a column, weighted if asked."""
    rows = df if weight else df.withColumn("_one", F.lit(1.0))
    m = weighted_moments(rows, column, weight or "_one")
    return m.withColumn("error", F.sqrt(safe_div(F.col("var"), F.col("n_eff"))))


def auto_method(n: int, integers: bool, weighted: bool) -> str:
    """Which method suits so many values."""
    if integers:
        return "clopper_pearson" if n < 30 else "barlow_beeston" if weighted else "poisson_exact"
    if n < 30:
        return "jeffreys"
    return "bootstrap_bca" if weighted and n < 1000 else "wilson"


