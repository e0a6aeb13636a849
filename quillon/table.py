"""A thin lazy table: selections, projections and histograms with lineage.

Everything returns a new table around a DataFrame; only collect-like calls and
scalar statistics run a job.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .functions import scalar
from .functions.expressions import compile_query, query_columns
from .operators import aggregate, derive, histogram, joins, luminosity, selection
from .sources import sinks


def _column(value) -> Column:
    return value.expr if isinstance(value, ColumnHandle) else value if isinstance(value, Column) else F.lit(value)


def _binary(op: str) -> Callable:
    """An operator of column handles: with another handle or a value, as a Column."""
    return lambda self, other: getattr(self.expr, op)(_column(other))


def _by(f: Callable[[Column, Column], Column]) -> Callable:
    return lambda self, other: f(self.expr, _column(other))


def _reflected(f: Callable[[Column, Column], Column]) -> Callable:
    return lambda self, other: f(_column(other), self.expr)


class ColumnHandle:
    """One column of a table: an expression, and statistics that run at once."""

    def __init__(self, table: LazyTable, name: str):
        self.table, self.name, self.expr = table, name, F.col(f"`{name}`")

    def _stat(self, operation: str):
        return aggregate.column_stat(self.table.df, self.name, operation)

    mean, sum, min, max, std, var, count, median, n_unique = (
        (lambda op: lambda self: self._stat(op))(op) for op in ("mean", "sum", "min", "max", "std", "var", "count", "median", "n_unique")
    )

    def astype(self, kind: str, lenient: bool = False) -> Column:
        return scalar.cast(self.expr, kind, lenient)

    def date_part(self, part: str) -> Column:
        return scalar.date_part(self.expr, part)

    def apply(self, f: Callable, meta: str) -> Column:
        """A function of single values, in Arrow batches; meta is the result's type."""
        return pandas_udf(lambda s: s.map(f), meta)(self.expr)

    def to_list(self) -> list:
        return sinks.to_list(self.table.df, self.name)

    def to_numpy(self) -> np.ndarray:
        return np.asarray(self.to_list())

    lower = lambda self: F.lower(self.expr)
    upper = lambda self: F.upper(self.expr)
    strip = lambda self: F.trim(self.expr)
    contains = lambda self, p: self.expr.rlike(p)
    startswith = lambda self, p: self.expr.startswith(p)
    endswith = lambda self, p: self.expr.endswith(p)

    __lt__, __le__, __gt__, __ge__, __eq__, __ne__ = map(_binary, ("__lt__", "__le__", "__gt__", "__ge__", "__eq__", "__ne__"))
    __add__, __sub__, __mul__, __and__, __or__ = map(_binary, ("__add__", "__sub__", "__mul__", "__and__", "__or__"))
    __radd__, __rsub__, __rmul__ = map(_reflected, (lambda a, b: a + b, lambda a, b: a - b, lambda a, b: a * b))
    __rand__, __ror__ = map(_reflected, (lambda a, b: a & b, lambda a, b: a | b))
    # Null where the divisor is 0; // and % floor.
    __truediv__, __floordiv__, __mod__, __pow__ = map(_by, (scalar.safe_div, scalar.floor_div, scalar.floor_mod, F.pow))
    __rtruediv__, __rfloordiv__, __rmod__, __rpow__ = map(_reflected, (scalar.safe_div, scalar.floor_div, scalar.floor_mod, F.pow))
    __neg__, __invert__, __abs__ = lambda self: -self.expr, lambda self: ~self.expr, lambda self: F.abs(self.expr)
    __hash__ = None


class LazyTable:
    def __init__(self, df: DataFrame, lineage: Sequence[str] = (), order: Sequence[str] = ()):
        self.df, self.lineage, self.order = df, tuple(lineage), tuple(order)
        self.watches: tuple[tuple[str, Observation], ...] | None = None

    def _like(self, df: DataFrame, lineage: Sequence[str], order: Sequence[str]) -> LazyTable:
        return LazyTable(df, lineage, order)

    def _with(self, df: DataFrame, step: str) -> LazyTable:
        if self.watches is not None:
            watch = Observation()
            df = df.observe(watch, F.count(F.lit(1)).alias("rows"))
        out = self._like(df, (*self.lineage, step), self.order)
        out.watches = None if self.watches is None else (*self.watches, (step, watch))
        return out

    def observed(self) -> LazyTable:
        """The table with its further steps watched: profile then tells how many rows each has let through.

        Spark moves no selection over a watched step, so this is for looking and not for production.
        """
        start = self._like(self.df, self.lineage, self.order)
        start.watches = ()
        return start._with(self.df, "start")

    def profile(self) -> list[dict[str, object]]:
        """Steps since observed with the rows that they gave, from one run of the plan whose result isn't kept; the last has the seconds."""
        if not self.watches:
            raise ValueError("nothing is watched: use observed before the steps")
        begin = time.monotonic()
        self.df.write.format("noop").mode("overwrite").save()
        seconds = time.monotonic() - begin
        return [{"step": step, "rows": watch.get["rows"]} for step, watch in self.watches] + [{"step": "total", "seconds": seconds}]

    columns = property(lambda self: self.df.columns)
    schema = property(lambda self: self.df.schema)
    dtypes = property(lambda self: dict(self.df.dtypes))
    shape = property(lambda self: (self.df.count(), len(self.df.columns)))

    def ordered_by(self, *columns: str) -> LazyTable:
        """The order that positions refer to."""
        return self._like(self.df, self.lineage, columns)

    def weighted(self, column: str) -> WeightedTable:
        """The same rows with a weight that all further steps keep."""
        return WeightedTable(self.df, column, self.lineage, self.order)

    def weighted_by_luminosity(self, condition: str, name_col: str = "process") -> WeightedTable:
        """Each row weighs what its process does at an energy condition."""
        names = luminosity.weights(self.df.select(name_col).distinct(), condition, name_col)
        return WeightedTable(luminosity.apply_weights(self.df, names, name_col), "lumi_weight", (*self.lineage, f"weights {condition}"), self.order)

    def __getitem__(self, key):
        if isinstance(key, str):
            if key not in self.columns:
                raise KeyError(key)
            return ColumnHandle(self, key)
        if isinstance(key, (Column, ColumnHandle)):
            return self._with(self.df.where(_column(key)), "mask")
        if isinstance(key, tuple):
            return self[key[0]].select(list(key[1]))
        if isinstance(key, slice):
            self._need_order()
            return self._with(selection.slice_rows(self.df, self.order, key.start, key.stop, key.step), f"slice {key}")
        if isinstance(key, np.ndarray):
            self._need_order()
            return self._with(selection.take(self.df, self.order, key.tolist()), "take")
        return self.select(list(key))

    def _need_order(self) -> None:
        if not self.order:
            raise ValueError("positions need an order: use ordered_by")

    def select(self, columns: Sequence[str]) -> LazyTable:
        missing = [c for c in columns if c not in self.columns]
        if missing:
            raise KeyError(missing[0])
        return self._with(self.df.select(*columns), f"select {list(columns)}")

    def filter(self, *predicates: Column | str) -> LazyTable:
        df = self.df
        for p in predicates:
            df = df.where(p)
        return self._with(df, f"filter {len(predicates)}")

    def query(self, text: str, derive_missing: bool = True, /, **variables) -> LazyTable:
        """Rows that a selection keeps; missing angular columns are derived first."""
        df, missing = self.df, [c for c in query_columns(text) if c not in self.columns]
        if missing and derive_missing and all("delta" in c or "abs" in c or c.startswith("dR") for c in missing):
            df = derive.delta_columns(df)
        return self._with(df.where(compile_query(text, df.columns, **variables)), f"query {text}")

    def apply_cuts(self, cuts: Sequence[str]) -> LazyTable:
        out = self
        for cut in cuts:
            out = out.query(cut)
        return out

    def sql_filter(self, text: str) -> LazyTable:
        return self._with(self.df.where(text), f"sql {text}")

    def with_columns(self, **columns: Column) -> LazyTable:
        return self._with(self.df.withColumns(columns), f"with_columns {list(columns)}")

    def rename(self, names: dict[str, str]) -> LazyTable:
        return self._with(self.df.withColumnsRenamed(names), "rename")

    def drop(self, *columns: str) -> LazyTable:
        return self._with(self.df.drop(*columns), "drop")

    def fillna(self, value, columns: Sequence[str] | None = None) -> LazyTable:
        return self._with(self.df.fillna(value, columns), "fillna")

    def dropna(self, columns: Sequence[str] | None = None) -> LazyTable:
        return self._with(self.df.dropna(subset=columns), "dropna")

    def sort(self, *columns: str, descending: bool = False) -> LazyTable:
        return self._with(self.df.orderBy(*[F.col(c).desc() if descending else F.col(c) for c in columns]), "sort")

    def unique(self, *columns: str) -> LazyTable:
        return self._with(self.df.dropDuplicates(list(columns) or None), "unique")

    def head(self, n: int = 5) -> LazyTable:
        return self._with(selection.head(self.df, n, self.order), f"head {n}")

    def sample(self, fraction: float, seed: int = 42) -> LazyTable:
        return self._with(self.df.sample(fraction=fraction, seed=seed), "sample")

    def partition(self, n: int, *columns: str) -> LazyTable:
        """In n partitions, by ranges of the columns."""
        return self._with(self.df.repartitionByRange(n, *columns), f"partition {n}")

    def union(self, *others: LazyTable) -> LazyTable:
        df = self.df
        for o in others:
            df = df.unionByName(o.df, allowMissingColumns=True)
        return self._with(df, "union")

    def join(self, other: LazyTable, on, how: str = "inner", **options) -> LazyTable:
        return self._with(joins.join(self.df, other.df, on, how, **options), f"join {on} {how}")

    def merge(self, other: LazyTable, on, how: str = "inner", validate: str | None = None) -> LazyTable:
        return self._with(joins.merge(self.df, other.df, on, how, validate), f"merge {on} {how}")

    def one_candidate(self, *args, **options) -> LazyTable:
        return self._with(selection.one_candidate(self.df, *args, **options), "one_candidate")

    def delta_columns(self) -> LazyTable:
        return self._with(derive.delta_columns(self.df), "delta_columns")

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> LazyTable:
        return self._with(f(self.df), "transform")

    def groupby(self, *by: str) -> GroupedTable:
        return GroupedTable(self, by)

    def hist(self, column: str, bins: int = 50, range=None, density: bool = False, weights: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Counts (weights, densities) and edges as arrays."""
        h = histogram.hist(self.df, column, bins, range, weights, "in" if density else None)
        if density:
            rows = sorted((r["bin"], r["density"], r["lo"], r["hi"]) for r in h.collect())
            return np.array([r[1] or 0.0 for r in rows]), np.array([r[2] for r in rows] + [rows[-1][3]])
        return histogram.counts_edges(h, weights is not None)

    def agg(self, operation: str, columns: Sequence[str] = ()) -> dict[str, float]:
        return aggregate.agg(self.df, operation, columns)

    # One value for each of the columns, or for each numeric one.
    sum, mean, min, max, std, var, median = (
        (lambda op: lambda self, *columns: self.agg(op, columns))(op) for op in ("sum", "mean", "min", "max", "std", "var", "median")
    )

    def describe(self, columns: Sequence[str] = ()) -> DataFrame:
        return aggregate.describe(self.df, columns)

    def count(self) -> int:
        return self.df.count()

    def to_pandas(self, max_rows: int | None = None):
        return sinks.to_pandas(self.df, max_rows)

    def collect(self):
        return self.df.collect()

    def explain(self) -> str:
        return "\n".join(f"{i}: {s}" for i, s in enumerate(self.lineage))


class WeightedTable(LazyTable):
    """A lazy table whose rows have a weight, which selections, candidates, derived columns and projections keep.

    Histograms and means are weighted by it; what no longer has the column, as an aggregate, is a plain table.
    """

    def __init__(self, df: DataFrame, weight: str, lineage: Sequence[str] = (), order: Sequence[str] = ()):
        if weight not in df.columns:
            raise KeyError(weight)
        super().__init__(df, lineage, order)
        self.weight = weight

    def _like(self, df: DataFrame, lineage: Sequence[str], order: Sequence[str]) -> LazyTable:
        if self.weight not in df.columns:
            return LazyTable(df, lineage, order)
        return WeightedTable(df, self.weight, lineage, order)

    def select(self, columns: Sequence[str]) -> LazyTable:
        return super().select([*columns, *({self.weight} - set(columns))])

    def scaled(self, factor: float) -> LazyTable:
        return self._with(self.df.withColumn(self.weight, F.col(self.weight) * factor), f"scaled {factor}")

    def hist(self, column: str, bins: int = 50, range=None, density: bool = False, weights: str | None = None) -> tuple[np.ndarray, np.ndarray]:
        range = range or histogram.range_of(self.df, column, histogram.RANGES_WIDE)
        return super().hist(column, bins, range, density, weights or self.weight)

    def hist_frame(self, column: str, bins: int = 50, range=None, by: Sequence[str] = ()) -> DataFrame:
        """The histogram as a table, with errors from the sums of squared weights."""
        range = range or histogram.range_of(self.df, column, histogram.RANGES_WIDE)
        return histogram.with_errors(histogram.hist(self.df, column, bins, range, self.weight, by=by))

    def moments(self, column: str, by: Sequence[str] = ()) -> DataFrame:
        """(by.., mean, n_eff, var) by the weights."""
        return aggregate.weighted_moments(self.df, column, self.weight, by)


class GroupedTable:
    def __init__(self, table: LazyTable, by: Sequence[str]):
        self.table, self.by = table, list(by)

    def agg(self, *columns, **named) -> LazyTable:
        if len(columns) == 1 and isinstance(columns[0], dict):
            return self.table._with(aggregate.group_dict(self.table.df, self.by, columns[0]), "groupby")
        return self.table._with(aggregate.group_agg(self.table.df, self.by, *columns, **named), "groupby")

    def count(self) -> LazyTable:
        return self.table._with(aggregate.group_count(self.table.df, self.by), "groupby count")

    def mean(self, *columns: str) -> LazyTable:
        return self.table._with(aggregate.group_all(self.table.df, self.by, "mean", columns), "groupby mean")

    def sum(self, *columns: str) -> LazyTable:
        return self.table._with(aggregate.group_all(self.table.df, self.by, "sum", columns), "groupby sum")
