"""Aggregation over tables and groups."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite, nan_mean, nan_sum, safe_div
from .quantiles import FEW, group_medians, group_quantiles, long_form

#: Values that an exact quantile may hold in one buffer.
BUFFER = 2_000_000
#: Types whose columns are aggregated where none are named.
NUMERIC = ("double", "float", "bigint", "int", "decimal(20,0)")
FUNCTIONS: dict[str, Callable[[str], Column]] = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "median": F.median, "count": F.count,
    "n_unique": F.countDistinct, "first": F.first, "nan_sum": lambda c: nan_sum(F.col(c)), "nan_mean": lambda c: nan_mean(F.col(c)),
}


def numeric_columns(df: DataFrame, without: Sequence[str] = ()) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC and c not in without]


def _function(name: str) -> Callable[[str], Column]:
    if name not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {name!r}; known: {', '.join(FUNCTIONS)}")
    return FUNCTIONS[name]


def _grouped(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, Column], medians: Mapping[str, str], buffer: int) -> DataFrame:
    """Aggregates and medians {name: column} per group, named and in the order of `aggregates`, which has them all.

    A median that the aggregate function would hold more than `buffer` values for is
    found by rank instead: this takes a count of the rows, or of those of the largest group, at once.
    """
    named = [c.alias(k) for k, c in aggregates.items()]
    if not medians or df.count() * len(medians) <= buffer:
        return df.groupBy(*by).agg(*named)
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest * len(medians) <= buffer:
        return df.groupBy(*by).agg(*named)
    rest = df.groupBy(*by).agg(*[c.alias(k) for k, c in aggregates.items() if k not in medians], F.lit(1).alias("_one"))
    found = group_medians(df, by, dict(medians), min(buffer, FEW)).withColumnsRenamed({c: f"{c}_" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    return rest.join(found, same, "left").select(*by, *aggregates)


def group_agg(df: DataFrame, by: Sequence[str], *columns: Column, buffer: int = BUFFER, **named: str | Column) -> DataFrame:
    """Aggregates per group: Columns as they are; col="mean" becomes col_mean; name=Column is named so."""
    medians = {f"{k}_median": k for k, v in named.items() if isinstance(v, str) and v == "median"}
    more = {f"{k}_{v}": _function(v)(k) if isinstance(v, str) else v for k, v in named.items() if isinstance(v, str)} | {k: v for k, v in named.items() if not isinstance(v, str)}
    if not medians:
        return df.groupBy(*by).agg(*columns, *[c.alias(k) for k, c in more.items()])
    names = [c for c in df.groupBy(*by).agg(*columns).columns if c not in by] if columns else []
    return _grouped(df, by, dict(zip(names, columns)) | more, medians, buffer)


def group_dict(df: DataFrame, by: Sequence[str], spec: Mapping[str, str | Sequence[str]], count_rows: bool = True, buffer: int = BUFFER) -> DataFrame:
    """{column: operation or operations} as {column}_{operation}; count counts rows, or values that aren't null."""
    out, medians = {}, {}
    for c, ops in spec.items():
        for op in [ops] if isinstance(ops, str) else ops:
            out[f"{c}_{op}"] = F.count(F.lit(1)) if op == "count" and count_rows else _function(op)(c)
            if op == "median":
                medians[f"{c}_{op}"] = c
    return _grouped(df, by, out, medians, buffer)


def group_count(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("count"))


def group_all(df: DataFrame, by: Sequence[str], operation: str, columns: Sequence[str] = ()) -> DataFrame:
    """{c}_{operation} for the named or all numeric columns."""
    return group_dict(df, by, dict.fromkeys(columns or numeric_columns(df, by), operation), count_rows=False)


def agg_frame(df: DataFrame, operation: str, columns: Sequence[str] = ()) -> DataFrame:
    """One row with the aggregate of each column; count gives total_count."""
    if operation == "count":
        return df.agg(F.count(F.lit(1)).alias("total_count"))
    columns = columns or numeric_columns(df)
    return _grouped(df, [], {c: _function(operation)(c) for c in columns}, {c: c for c in columns if operation == "median"}, BUFFER)


def agg(df: DataFrame, operation: str, columns: Sequence[str] = ()) -> dict[str, float]:
    return agg_frame(df, operation, columns).first().asDict()


def column_stat(df: DataFrame, column: str, operation: str):
    if operation == "median":
        return agg_frame(df, operation, [column]).first()[0]
    return df.agg(_function(operation)(column)).first()[0]


def quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], buffer: int = BUFFER) -> dict[str, list[float | None]]:
    """Exact quantiles of finite values, linear between ranks; None for a column without any.

    Columns with `buffer` values or fewer together are held in a buffer; more are found by rank.
    """
    return _quantiles(df, columns, at, df.count() * len(columns), buffer)


def _quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float], values: int, buffer: int) -> dict[str, list[float | None]]:
    x = [F.when(finite(F.col(c)), F.col(c).cast("double")) for c in columns]
    if values <= buffer:
        shares = F.array(*map(F.lit, map(float, at)))
        got = df.agg(*[F.percentile(v, shares) for v in x]).first()
        return {c: list(v) if v is not None else [None] * len(at) for c, v in zip(columns, got)}
    out = {c: [None] * len(at) for c in columns}
    for row in group_quantiles(df, [], columns, at, few=min(buffer, FEW)).collect():  # as many as are returned
        out[columns[row["_c"]]][row["_q"]] = row["value"]
    return out


def _stats(x: str) -> list[Column]:
    named = (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    return [F.count(x).alias("count"), F.count_if(F.col(x).isNull()).alias("null_count"), *[f(x).alias(name) for name, f in named]]


def describe(df: DataFrame, columns: Sequence[str] = (), buffer: int = BUFFER) -> DataFrame:
    """(column, count, null_count, mean, std, min, q25, q50, q75, max) over all rows; quartiles exact, of finite values.

    Two passes where the columns have `buffer` values at most, else one and as many as the ranks need. A row for each value, not
    seven aggregates for each column, so that the JVM compiles the aggregation however many columns there are.
    """
    columns = list(columns or numeric_columns(df))
    stats = long_form(df, [], {k: F.col(c) for k, c in enumerate(columns)}).groupBy("_c").agg(*_stats("_x"))
    none = {"count": 0, "null_count": 0, "mean": None, "std": None, "min": None, "max": None}
    one = [none] * len(columns)
    for row in stats.collect():  # as many as columns
        one[row["_c"]] = row
    found = _quantiles(df, columns, (0.25, 0.5, 0.75), sum(s["count"] for s in one), buffer)
    rows = [(c, s["count"], s["null_count"], s["mean"], s["std"], s["min"], *found[c], s["max"]) for c, s in zip(columns, one)]
    return df.sparkSession.createDataFrame(rows, "column string, count long, null_count long, mean double, std double, min double, q25 double, q50 double, q75 double, max double")


def group_describe(df: DataFrame, by: Sequence[str], columns: Sequence[str], buffer: int = BUFFER) -> DataFrame:
    """(by.., column, count, null_count, mean, std, min, q25, q50, q75, max) of each column in each group; quartiles as in describe.

    One job where all values together are `buffer` at most; else quartiles are found by rank.
    """
    shares = (0.25, 0.5, 0.75)
    keys = [f"_g{k}" for k in range(len(by))]
    few = df.count() * len(columns) <= buffer
    stats = _stats("_x") + ([F.percentile(F.when(finite(F.col("_x")), F.col("_x")), F.array(*map(F.lit, shares))).alias("_q")] if few else [])
    rows = long_form(df, [F.col(c).alias(k) for c, k in zip(by, keys)], {k: F.col(c) for k, c in enumerate(columns)}).groupBy(*keys, "_c").agg(*stats)
    if few:
        ends = [F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(("q25", "q50", "q75"))]
    else:
        found = group_quantiles(df, by, columns, shares, few=min(buffer, FEW))
        wide = found.groupBy(*keys, "_c").agg(*[F.max(F.when(F.col("_q") == k, F.col("value"))).alias(f"_q{k}") for k in range(3)])
        wide = wide.withColumnsRenamed({c: f"{c}_" for c in [*keys, "_c"]})
        same = F.col("_c") == F.col("_c_")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        rows = rows.join(wide, same, "left")
        ends = [F.col(f"_q{k}").alias(n) for k, n in enumerate(("q25", "q50", "q75"))]
    name = F.get(F.array(*map(F.lit, columns)), F.col("_c")).alias("column")
    return rows.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], name, "count", "null_count", "mean", "std", "min", *ends, "max")


def weighted_moments(df: DataFrame, column: str, weight: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., mean, n_eff, var): weighted, with the variance corrected by the effective number.

    A first pass gives the means and a second one sums squares of what is left, so
    a mean that is large against the spread costs no digits.
    """
    x, w = F.col(column).cast("double"), F.col(weight).cast("double")
    keys = [f"_by{k}" for k in range(len(by))]
    rows = df.where(x.isNotNull() & w.isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], x.alias("_x"), w.alias("_w"))
    first = rows.groupBy(*keys).agg(F.avg("_x").alias("_near"))
    if by:
        first = first.withColumnsRenamed({k: f"{k}_" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
        rows = rows.join(first, same)
    else:
        rows = rows.crossJoin(first)  # one row
    d = F.col("_x") - F.col("_near")
    sums = rows.groupBy(*keys).agg(
        F.first("_near").alias("_near"),
        F.sum("_w").alias("_s"),
        F.sum(F.col("_w") * F.col("_w")).alias("_ss"),
        F.sum(F.col("_w") * d).alias("_sd"),
        F.sum(F.col("_w") * d * d).alias("_sdd"),
    )
    off, n = safe_div(F.col("_sd"), F.col("_s")), safe_div(F.col("_s") * F.col("_s"), F.col("_ss"))
    plain = F.greatest(safe_div(F.col("_sdd"), F.col("_s")) - off * off, F.lit(0.0))
    return sums.select(
        *[F.col(k).alias(c) for k, c in zip(keys, by)],
        (F.col("_near") + off).alias("mean"),
        n.alias("n_eff"),
        F.when(n > 1, plain * n / (n - 1)).otherwise(plain).alias("var"),
    )


def correlations(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(x, y, corr) for all pairs of columns, weighted if asked, of rows without a null; a second pass is centred."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.select(*[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(columns)], w.alias("_w")).dropna()
    each = range(len(columns))
    rows = rows.crossJoin(rows.agg(*[F.avg(f"_x{k}").alias(f"_near{k}") for k in each]))  # one row
    d = [F.col(f"_x{k}") - F.col(f"_near{k}") for k in each]
    pairs = [(a, b) for a in each for b in each if a <= b]
    sums = [F.sum("_w").alias("n")] + [F.sum(F.col("_w") * d[k]).alias(f"s_{k}") for k in each] + [F.sum(F.col("_w") * d[a] * d[b]).alias(f"p_{a}_{b}") for a, b in pairs]
    one = rows.agg(*sums)
    cov = lambda a, b: F.col(f"p_{a}_{b}") / F.col("n") - F.col(f"s_{a}") / F.col("n") * F.col(f"s_{b}") / F.col("n")
    cells = [F.struct(F.lit(columns[a]).alias("x"), F.lit(columns[b]).alias("y"), safe_div(cov(a, b), F.sqrt(cov(a, a) * cov(b, b))).alias("corr")) for a, b in pairs]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
