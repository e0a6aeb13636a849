"""How queries are registered, and the events that they read.

The driver tables stand in for events: an order is an event, a line item a
candidate, return flag and line status the process. Momenta and angles are fixed
arithmetic on keys and prices, in SQL text that both engines read alike.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..session import load, small

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The tables of one folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name)

    @property
    def events_mu(self) -> DataFrame:
        return self.lineitem.selectExpr(*[f"{e} AS `{c}`" for c, e in MUONS.items()])

    def rows(self, values: Sequence, schema: str) -> DataFrame:
        return small(self.spark, [v if isinstance(v, tuple) else (v,) for v in values], schema)


def query(sql: str | None = None, name: str | None = None):
    """Register a function of Tables, with SQL for the oracle."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            SQL[key] = sql
        return f

    return add


def _angle(key: str, factor: int, span: int, offset: float) -> str:
    return f"CAST(({key} * {factor}) % {span} AS DOUBLE) / 1000 + CAST({offset} AS DOUBLE)"


MUONS = {
    "__event__": "l_orderkey",
    "__candidate__": "l_linenumber",
    "partkey": "l_partkey",
    "process": "concat(l_returnflag, l_linestatus)",
    "quality": "l_extendedprice",
    "weight": "1 - l_discount",
    "mu1P": "l_quantity / 12 + CAST(0.5 AS DOUBLE)",
    "mu2P": "CAST(l_partkey % 40 AS DOUBLE) / 10 + CAST(0.5 AS DOUBLE)",
    "mu1Theta": _angle("l_partkey", 1, 2500, 0.3),
    "mu2Theta": _angle("l_suppkey", 23, 2500, 0.3),
    "mu1Phi": _angle("l_partkey", 1, 6283, -3.1415),
    "mu2Phi": _angle("l_orderkey", 7, 6283, -3.1415),
    "mu1clusterTheta": _angle("l_orderkey", 3, 2500, 0.3),
    "mu2clusterTheta": _angle("l_orderkey", 11, 2500, 0.3),
    "mu1clusterPhi": _angle("l_orderkey", 13, 6283, -3.1415),
    "mu2clusterPhi": _angle("l_partkey", 17, 6283, -3.1415),
    "pRecoil": "l_extendedprice / 20000 + CAST(0.1 AS DOUBLE)",
    "pRecoilTheta": _angle("l_orderkey", 5, 2500, 0.3),
    "pRecoilPhi": _angle("l_orderkey", 19, 6283, -3.1415),
    "E": "l_discount * 10",
    "theta": _angle("l_partkey", 29, 2500, 0.3),
    "phi": _angle("l_suppkey", 31, 6283, -3.1415),
    "eRecoil": "l_extendedprice / 15000 + CAST(0.2 AS DOUBLE)",
    "m2Recoil": "l_tax * 100 - 2",
    "mRecoil": "l_tax * 20",
}
#: The same events in SQL.
EVENTS = "SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in MUONS.items()) + " FROM lineitem"


def bin_sql(x: str, lo: float, hi: float, bins: int) -> str:
    """Bin of x in SQL, null outside the range."""
    w = (hi - lo) / bins
    return f"CASE WHEN {x} >= {lo!r}::DOUBLE AND {x} <= {hi!r}::DOUBLE THEN least(floor(({x} - {lo!r}::DOUBLE) / {w!r}::DOUBLE)::INT, {bins - 1}) END"


def dense_sql(rows: str, bins: int, by: str = "", sums: str = "count(*) AS count", columns: str = "coalesce(count, 0) AS count") -> str:
    """A histogram over `rows` (with a column bin and the keys `by`), empty bins included."""
    if by:
        return f"WITH r AS ({rows}), g AS (SELECT {by}, bin, {sums} FROM r GROUP BY ALL), k AS (SELECT DISTINCT {by} FROM r) SELECT k.{by}, b.bin::INT AS bin, {columns} FROM k CROSS JOIN range({bins}) b(bin) LEFT JOIN g ON g.{by} = k.{by} AND g.bin = b.bin"
    return f"WITH r AS ({rows}), g AS (SELECT bin, {sums} FROM r GROUP BY ALL) SELECT b.bin::INT AS bin, {columns} FROM range({bins}) b(bin) LEFT JOIN g USING (bin)"
