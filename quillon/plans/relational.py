"""Queries on scans, projections, selections, joins and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalar
from ..functions.expressions import compile_query
from ..operators import aggregate, joins, selection
from ..operators.statistics import column_statistics
from ..scratch import place
from ..sources import readers
from ..table import LazyTable
from .base import query


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def scan_parquet(t):
    """By a glob, as by the file's name."""
    return readers.scan(t.spark, f"{t.sf_dir}/line*.parquet").select("l_orderkey", "l_linenumber", "l_quantity")


def _saved(t, df, kind: str = "parquet", name: str = "") -> str:
    """A directory without a suffix to which df has been saved."""
    path = place(t.spark, "saved")
    df.write.mode("overwrite").format(kind).save(f"{path}/{name}" if name else path)
    return path


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000")
def scan_directory(t):
    """A directory of several files; selection and columns reach its scan."""
    return readers.load_table(t.spark, _saved(t, t.orders.repartition(3)), ["o_orderkey", "o_totalprice"], ["o_totalprice > 50000"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 500")
def scan_json_directory(t):
    return readers.scan(t.spark, _saved(t, t.orders.where("o_orderkey < 500").select("o_orderkey", "o_orderstatus").repartition(2), "json"))


@query("SELECT l_returnflag AS process, count(*) AS count FROM lineitem GROUP BY ALL")
def load_discovered(t):
    """Directories that are found by name and read as processes of one table."""
    base = place(t.spark, "found")
    for flag in ("A", "N", "R"):
        t.lineitem.where(F.col("l_returnflag") == flag).select("l_orderkey", "l_quantity").write.parquet(f"{base}/{flag}")
    return readers.load_discovered(t.spark, base, "manual", least=1).counts()


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.02")
def load_table(t):
    return readers.load_table(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_quantity"], ["l_quantity > 45", "l_discount < 0.02"])


@query("SELECT p_partkey, p_name FROM part")
def select(t):
    return LazyTable(t.part).select(["p_partkey", "p_name"]).df


@query("SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 40 OFFSET 10)")
def slice_rows(t):
    return LazyTable(t.orders.select("o_orderkey", "o_totalprice"), order=["o_orderkey"])[10:50].df


_NUMBERED = "(SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS k, count(*) OVER () AS n FROM orders)"


@query(f"SELECT o_orderkey, o_totalprice FROM {_NUMBERED} WHERE k >= n - 7")
def slice_from_the_end(t):
    return LazyTable(t.orders.select("o_orderkey", "o_totalprice"), order=["o_orderkey"])[-7:].df


@query(f"SELECT o_orderkey, row_number() OVER (ORDER BY k DESC) - 1 AS place FROM {_NUMBERED} WHERE k <= 90 AND k > 10 AND (90 - k) % 4 = 0")
def slice_backwards(t):
    """Rows in the order in which the slice gives them."""
    back = LazyTable(t.orders.select("o_orderkey"), order=["o_orderkey"])[90:10:-4].df
    return t.rows([(r["o_orderkey"], i) for i, r in enumerate(back.collect())], "o_orderkey long, place long")  # 20 rows


@query(f"SELECT o_orderkey FROM {_NUMBERED} WHERE k >= 1200")
def slice_to_the_end(t):
    return LazyTable(t.orders.select("o_orderkey"), order=["o_orderkey"])[1200:].df


@query(f"SELECT o_orderkey FROM {_NUMBERED} WHERE k IN (0, n - 1, n - 20) UNION ALL SELECT o_orderkey FROM {_NUMBERED} WHERE k = n - 1")
def take_from_the_end(t):
    return selection.take(t.orders.select("o_orderkey"), ["o_orderkey"], [-1, 0, -20, -1])


@query("SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice > 90000 AS dear FROM orders) WHERE dear")
def mask_column(t):
    """A boolean column of the table itself as the mask."""
    o = LazyTable(t.orders.withColumn("dear", F.col("o_totalprice") > 90000))
    return o[o["dear"]].select(["o_orderkey"]).df


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2 * l_quantity AS a, 1 - l_tax AS b, round(100 / nullif(l_quantity, 0), 6) AS c, -l_quantity AS d, pow(2, l_tax) AS e, l_quantity - 7 * floor(l_quantity / 7) AS f, floor(l_quantity / 7)::BIGINT AS g, (l_tax > 0.02 AND l_quantity > 10) AND NOT l_discount > 0.05 AS h FROM lineitem",
)
def f_reflected(t):
    x = LazyTable(t.lineitem)
    q, tax, less = x["l_quantity"], x["l_tax"], x["l_discount"]
    both = (tax > 0.02) & (q > 10) & ~(less > 0.05)
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (2 * q).alias("a"),
        (1 - tax).alias("b"),
        F.round(100 / q, 6).alias("c"),
        (-q).alias("d"),
        (2**tax).alias("e"),
        (q % 7).alias("f"),
        (q // 7).alias("g"),
        both.alias("h"),
    )


@query("SELECT round(sum(l_quantity), 4) AS total, round(avg(l_quantity), 6) AS mean, min(l_tax) AS least, max(l_tax) AS most, round(stddev_samp(l_tax), 8) AS std FROM lineitem")
def table_shorthands(t):
    x = LazyTable(t.lineitem)
    row = (x.sum("l_quantity")["l_quantity"], x.mean("l_quantity")["l_quantity"], x.min("l_tax")["l_tax"], x.max("l_tax")["l_tax"], x.std("l_tax")["l_tax"])
    df = t.rows([row], "total double, mean double, least double, most double, std double")
    return df.withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6), "std": F.round("std", 8)})


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) WHERE k >= 5 AND k < 500 AND (k - 5) % 7 = 0")
def row_col_index(t):
    return LazyTable(t.orders, order=["o_orderkey"])[5:500:7, ["o_orderkey", "o_totalprice"]].df


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def mask_index(t):
    p = LazyTable(t.part)
    return p[p["p_size"] > 25].select(["p_partkey", "p_size"]).df


@query("SELECT c_custkey, k::BIGINT AS k FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) WHERE k IN (0, 3, 5, 149)")
def take(t):
    return selection.take(selection.row_index(t.customer.select("c_custkey"), ["c_custkey"], "k"), ["c_custkey"], [0, 3, 5, 149])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_all(t):
    return LazyTable(t.orders).filter(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000).select(["o_orderkey"]).df


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 5 AND 45 > l_quantity AND (l_discount > 0.02 OR l_tax > 0.04)")
def query_string(t):
    return LazyTable(t.lineitem).query("l_quantity > 5 & 45 > l_quantity & (l_discount > 0.02 | l_tax > 0.04)").select(["l_orderkey", "l_linenumber"]).df


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_discount > 0.03 AND l_tax < 0.05")
def apply_cuts(t):
    return LazyTable(t.lineitem).apply_cuts(["l_quantity > 10", "l_discount > 0.03", "l_tax < 0.05"]).select(["l_orderkey", "l_quantity"]).df


@query("SELECT event_id FROM events WHERE value BETWEEN 10 AND 20 AND event_type LIKE '%c%'")
def sql_filter(t):
    return LazyTable(t.events).sql_filter("value BETWEEN 10 AND 20 AND event_type LIKE '%c%'").select(["event_id"]).df


@query("SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 5)")
def head(t):
    return LazyTable(t.orders.select("o_orderkey", "o_custkey"), order=["o_orderkey"]).head(5).df


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE ('0x' || substr(md5(l_orderkey::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.1")
def hash_sample(t):
    """Whole orders, a tenth of them."""
    return selection.hash_sample(t.lineitem, 0.1, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT o_orderkey, o_totalprice * 2 AS twice, o_totalprice / 8 AS thousands FROM orders")
def with_columns(t):
    return LazyTable(t.orders).with_columns(twice=F.col("o_totalprice") * 2, thousands=F.col("o_totalprice") / 8).select(["o_orderkey", "twice", "thousands"]).df


@query("SELECT s_suppkey AS id, coalesce(s_acctbal, 0) AS balance FROM supplier WHERE s_name IS NOT NULL")
def rename_fill_drop(t):
    s = LazyTable(t.supplier).dropna(["s_name"]).fillna(0.0, ["s_acctbal"]).rename({"s_suppkey": "id", "s_acctbal": "balance"})
    return s.drop("s_name", "s_nationkey").df


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS k FROM orders")
def row_index(t):
    return selection.row_index(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "k").select("o_orderkey", "k")


# --- the selection language ----------------------------------------------------

_L = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE "


def _rows(t, text, **variables):
    df = t.lineitem
    return df.where(compile_query(text, df.columns, **variables)).select("l_orderkey", "l_linenumber", "l_partkey")


@query(_L + "l_quantity >= 25 AND l_discount <= 0.05 AND l_returnflag = 'R' AND l_linestatus <> 'F' AND 0.03 > l_tax")
def q_compare(t):
    return _rows(t, "l_quantity >= 25 & l_discount <= 0.05 & l_returnflag == 'R' & l_linestatus != 'F' & 0.03 > l_tax")


@query(_L + "30 > l_quantity AND l_quantity > 10 AND 0.01 < l_tax AND l_tax <= 0.05")
def q_chain(t):
    return _rows(t, "30 > l_quantity > 10 and 0.01 < l_tax <= 0.05")


@query(_L + "NOT (l_quantity > 10 AND l_tax < 0.02) AND (l_discount > 0.05 OR l_quantity < 3)")
def q_and_or_not(t):
    return _rows(t, "~(l_quantity > 10 & l_tax < 0.02) & (l_discount > 0.05 | l_quantity < 3)")


@query(_L + "l_returnflag IN ('A', 'N') AND l_linenumber NOT IN (1, 2)")
def q_in(t):
    return _rows(t, "l_returnflag in ['A', 'N'] and l_linenumber not in [1, 2]")


@query(_L + "(l_partkey + 3) % 5 = 2 AND floor(l_quantity / 7) = 3 AND pow(l_tax, 2) < 0.0016 AND -l_discount < -0.01 AND l_extendedprice / nullif(l_quantity, 0) > 1000")
def q_arith(t):
    return _rows(t, "(l_partkey + 3) % 5 == 2 & l_quantity // 7 == 3 & l_tax ** 2 < 0.0016 & -l_discount < -0.01 & l_extendedprice / l_quantity > 1000")


@query(
    _L + "abs(l_quantity - 25) < 5 AND sqrt(l_extendedprice) > 150 AND ln(l_quantity) > 3 AND sin(l_tax) < 0.05 AND cos(l_tax) > 0.99 AND floor(l_quantity / 2) > 10 AND ceil(l_discount * 10) >= 1 AND exp(l_tax) > 1.01 AND tan(l_tax) < 0.07 AND least(l_tax, l_discount) > 0.01 AND greatest(l_tax, l_discount) < 0.09 AND round(l_quantity / 4, 0) > 3",
)
def q_math(t):
    return _rows(
        t,
        "abs(l_quantity - 25) < 5 & sqrt(l_extendedprice) > 150 & log(l_quantity) > 3 & sin(l_tax) < 0.05 & cos(l_tax) > 0.99 & floor(l_quantity / 2) > 10 & ceil(l_discount * 10) >= 1 & exp(l_tax) > 1.01 & tan(l_tax) < 0.07 & min(l_tax, l_discount) > 0.01 & max(l_tax, l_discount) < 0.09 & round(l_quantity / 4, 0) > 3",
    )


@query(
    "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[1-4]') AND (starts_with(p_type, 'S') OR p_type LIKE '%Y') AND length(p_name) > 8 "
    "AND lower(p_brand) <> upper(p_brand) AND substr(p_brand, 1, 2) = 'Br' AND regexp_replace(p_name, '[aeiou]+', '', 'g') <> 'smll rng'"
)
def q_string(t):
    text = (
        "p_brand.contains('#[1-4]') & (p_type.startswith('S') | p_type.endswith('Y')) & p_name.len() > 8 "
        "& p_brand.lower() != p_brand.upper() & p_brand.slice(0, 2) == 'Br' & p_name.replace('[aeiou]+', '') != 'smll rng'"
    )
    return t.part.where(compile_query(text, t.part.columns)).select("p_partkey")


@query("SELECT o_orderkey FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) WHERE p IS NULL OR (p IS NOT NULL AND o_custkey % 2 = 1)")
def q_null(t):
    df = t.orders.withColumn("p", F.when(F.col("o_custkey") % 3 != 0, F.col("o_totalprice")))
    return df.where(compile_query("p.isna() | (p.notnull & o_custkey % 2 == 1)", df.columns)).select("o_orderkey")


@query(_L + "l_quantity > 20 AND l_returnflag IN ('A', 'R')")
def q_var(t):
    return _rows(t, "l_quantity > @least & l_returnflag in @flags", least=20, flags=["A", "R"])


@query(_L + f"l_quantity > {math.pi!r} * 10 AND l_quantity < {math.e!r} * 15 AND (l_tax > 0.02) = TRUE")
def q_const_bool(t):
    return _rows(t, "l_quantity > pi * 10 & l_quantity < e * 15 & (l_tax > 0.02) == True")


# --- scalar functions ----------------------------------------------------------


@query("SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS mo, day(ts)::INT AS d, hour(ts)::INT AS h, minute(ts)::INT AS mi, second(ts)::INT AS s FROM events")
def f_datetime(t):
    part = lambda p: scalar.date_part(F.col("ts"), p)
    return t.events.select(
        "event_id",
        part("year").alias("y"),
        part("month").alias("mo"),
        part("day").alias("d"),
        part("hour").alias("h"),
        part("minute").alias("mi"),
        part("second").alias("s"),
    )


@query("SELECT p_partkey, lower(p_name) AS lo, upper(p_brand) AS up, trim(p_type) AS st, regexp_matches(p_name, 'a') AS has, starts_with(p_brand, 'B') AS b FROM part")
def f_string(t):
    p = LazyTable(t.part)
    return t.part.select(
        "p_partkey",
        p["p_name"].lower().alias("lo"),
        p["p_brand"].upper().alias("up"),
        p["p_type"].strip().alias("st"),
        p["p_name"].contains("a").alias("has"),
        p["p_brand"].startswith("B").alias("b"),
    )


@query("SELECT o_orderkey, round(acos(least(greatest(o_totalprice / 100000 - 1, -1), 1)), 6) AS a, round(sin(o_totalprice), 6) AS s, round(cos(o_totalprice), 6) AS c FROM orders")
def f_trig_clip(t):
    x = F.col("o_totalprice")
    return t.orders.select("o_orderkey", F.round(F.acos(scalar.clip(x / 100000 - 1, -1.0, 1.0)), 6).alias("a"), F.round(F.sin(x), 6).alias("s"), F.round(F.cos(x), 6).alias("c"))


@query(
    "SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN -1.0 WHEN o_custkey % 4 = 1 THEN NULL ELSE o_totalprice END AS v, least(CASE WHEN o_custkey % 4 <> 1 THEN o_totalprice END, o_custkey::DOUBLE) AS m, o_totalprice BETWEEN 1000 AND 50000 AS b, CASE WHEN o_totalprice > 90000 THEN 'high' ELSE 'low' END AS w FROM orders",
)
def f_nan_min_when(t):
    k = F.col("o_custkey") % 4
    x = F.when(k == 0, F.lit(math.nan)).when(k != 1, F.col("o_totalprice"))
    m = scalar.min_horizontal(F.when(k != 1, F.col("o_totalprice")), F.col("o_custkey").cast("double"))
    return t.orders.select(
        "o_orderkey",
        scalar.fill_nan(x, -1.0).alias("v"),
        m.alias("m"),
        scalar.is_between(F.col("o_totalprice"), 1000, 50000).alias("b"),
        F.when(F.col("o_totalprice") > 90000, "high").otherwise("low").alias("w"),
    )


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name)::INT AS d FROM nation a, nation b WHERE levenshtein(a.n_name, b.n_name) <= 1")
def f_levenshtein(t):
    a, b = (t.nation.select(F.col("n_nationkey").alias(k), F.col("n_name").alias(f"name_{k}")) for k in "ab")
    both = joins.cross(a, b)  # 25 by 25 rows
    return both.withColumn("d", scalar.edit_distance(F.col("name_a"), F.col("name_b"))).where("d <= 1").select("a", "b", "d")


@query("SELECT o_orderkey, floor(o_totalprice)::INT AS i, o_orderkey::VARCHAR AS s, TRY_CAST(o_orderpriority AS INT) AS bad FROM orders")
def f_cast(t):
    return t.orders.select(
        "o_orderkey",
        F.floor("o_totalprice").cast("int").alias("i"),
        scalar.cast(F.col("o_orderkey"), "string").alias("s"),
        scalar.cast(F.col("o_orderpriority"), "int", lenient=True).alias("bad"),
    )


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity + l_tax AS a, l_quantity - l_tax AS s, l_quantity * l_tax AS m, round(l_quantity / nullif(l_tax, 0), 6) AS d, pow(l_tax, 2) AS p FROM lineitem",
)
def f_arith(t):
    x = LazyTable(t.lineitem)
    q, y = x["l_quantity"], x["l_tax"]
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        (q + y).alias("a"),
        (q - y).alias("s"),
        (q * y).alias("m"),
        F.round(q / y, 6).alias("d"),
        (y**2).alias("p"),
    )


# --- joins ----------------------------------------------------------------------

_BIG = "(SELECT * FROM orders WHERE o_totalprice > 150000)"


def _big(t):
    return t.orders.where("o_totalprice > 150000").withColumnRenamed("o_custkey", "c_custkey")


def _join_query(how: str, sql_how: str):
    @query(
        f"SELECT coalesce(c.c_custkey, o.o_custkey) AS c_custkey, c_name, coalesce(o_orderkey, -1) AS o_orderkey FROM customer c {sql_how} JOIN {_BIG} o ON c.c_custkey = o.o_custkey",
        name=f"join_{how}",
    )
    def run(t):
        return joins.join(
            t.customer.select("c_custkey", "c_name"),
            _big(t).select("c_custkey", "o_orderkey"),
            "c_custkey",
            how,
        ).withColumn("o_orderkey", F.coalesce("o_orderkey", F.lit(-1)))


for _how, _sql in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join_query(_how, _sql)


@query(f"SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM {_BIG} o WHERE o.o_custkey = c_custkey)")
def join_semi(t):
    return joins.join(t.customer.select("c_custkey", "c_name"), _big(t), "c_custkey", "semi")


@query(f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM {_BIG} o WHERE o.o_custkey = c_custkey)")
def join_anti(t):
    return joins.join(t.customer.select("c_custkey", "c_name"), _big(t), "c_custkey", "anti")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return joins.cross(t.region.select("r_name"), t.nation.select("n_name"))


@query("SELECT a.n_nationkey, a.n_name, b.n_name AS n_name_right FROM nation a JOIN nation b USING (n_nationkey)")
def join_suffix(t):
    return joins.join(t.nation.select("n_nationkey", "n_name"), t.nation.select("n_nationkey", "n_name"), "n_nationkey")


def _merge_query(strategy: str):
    @query("SELECT n_nationkey, n_name, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey", name=f"merge_{strategy}")
    def run(t):
        right = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
        return joins.join(t.nation.select("n_nationkey", "n_name"), right, "n_nationkey", strategy=strategy)


for _strategy in joins.STRATEGY:
    _merge_query(_strategy)


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_validate(t):
    right = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.merge(t.orders.select("o_orderkey", "o_custkey"), right, "o_custkey", validate="many_to_one").select("o_orderkey", "c_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey >= r_regionkey AND n_nationkey % 5 = r_regionkey")
def join_theta(t):
    r = t.region.select("r_regionkey", "r_name")
    return joins.theta(t.nation, r, (F.col("n_nationkey") % 5 == F.col("r_regionkey")) & (F.col("n_regionkey") >= F.col("r_regionkey"))).select("n_name", "r_name")


# --- aggregates -------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS l_quantity_mean, round(sum(l_tax), 6) AS tax FROM lineitem GROUP BY ALL")
def groupby_agg(t):
    g = aggregate.group_agg(t.lineitem, ["l_returnflag", "l_linestatus"], l_quantity="mean", tax=F.round(F.sum("l_tax"), 6))
    return g.withColumn("l_quantity_mean", F.round("l_quantity_mean", 6))


@query("SELECT event_type, count(*) AS count FROM events GROUP BY ALL")
def groupby_count(t):
    return LazyTable(t.events).groupby("event_type").count().df


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS l_quantity_mean, round(avg(l_tax), 6) AS l_tax_mean FROM lineitem GROUP BY ALL")
def groupby_mean(t):
    return LazyTable(t.lineitem).groupby("l_returnflag").mean("l_quantity", "l_tax").df.select(
        "l_returnflag",
        *[F.round(f"l_{c}_mean", 6).alias(f"l_{c}_mean") for c in ("quantity", "tax")],
    )


@query("SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum FROM orders GROUP BY ALL")
def groupby_sum(t):
    return LazyTable(t.orders).groupby("o_orderstatus").sum("o_totalprice").df.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))


@query(
    "SELECT event_type, round(sum(value), 4) AS value_sum, round(avg(value), 6) AS value_mean, count(*) AS value_count, min(value) AS value_min, max(value) AS value_max, round(stddev_samp(value), 6) AS value_std FROM events GROUP BY ALL",
)
def groupby_dict_agg(t):
    g = aggregate.group_dict(t.events, ["event_type"], {"value": ["sum", "mean", "count", "min", "max", "std"]})
    return g.withColumns({"value_sum": F.round("value_sum", 4), "value_mean": F.round("value_mean", 6), "value_std": F.round("value_std", 6)})


@query(
    "SELECT event_type, round(var_samp(value), 4) AS value_var, median(value) AS value_median, count(value) AS value_count FROM (SELECT event_type, CASE WHEN event_id % 5 <> 0 THEN value END AS value FROM events) GROUP BY ALL",
)
def groupby_dict_agg2(t):
    df = t.events.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return aggregate.group_dict(df, ["event_type"], {"value": ["var", "median", "count"]}, count_rows=False).withColumn("value_var", F.round("value_var", 4))


def _agg_query(op: str, f: str):
    @query(f"SELECT round({f}(l_quantity), 4) AS l_quantity, round({f}(l_extendedprice), 4) AS l_extendedprice FROM lineitem", name=f"agg_{op}")
    def run(t):
        return aggregate.agg_frame(t.lineitem, op, ["l_quantity", "l_extendedprice"]).select(
            F.round("l_quantity", 4).alias("l_quantity"),
            F.round("l_extendedprice", 4).alias("l_extendedprice"),
        )


for _op, _f in (("sum", "sum"), ("mean", "avg"), ("min", "min"), ("max", "max"), ("std", "stddev_samp")):
    _agg_query(_op, _f)


@query("SELECT count(*) AS total_count FROM lineitem")
def agg_count(t):
    return aggregate.agg_frame(t.lineitem, "count")


@query(
    "SELECT q, round(quantile_cont(l_extendedprice, q), 6) AS price, quantile_cont(l_quantity, q) AS quantity FROM lineitem, (VALUES (0.01), (0.25), (0.5), (0.99)) v(q) GROUP BY q".replace(
        "quantile_cont(l_extendedprice, q)",
        "CASE q WHEN 0.01 THEN quantile_cont(l_extendedprice, 0.01) WHEN 0.25 THEN quantile_cont(l_extendedprice, 0.25) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5) ELSE quantile_cont(l_extendedprice, 0.99) END",
    ).replace("quantile_cont(l_quantity, q)", "CASE q WHEN 0.01 THEN quantile_cont(l_quantity, 0.01) WHEN 0.25 THEN quantile_cont(l_quantity, 0.25) WHEN 0.5 THEN quantile_cont(l_quantity, 0.5) ELSE quantile_cont(l_quantity, 0.99) END").replace("SELECT q,", "SELECT q::DOUBLE AS q,"),
)
def quantiles_refined(t):
    """Exact quantiles by refining counts, as for tables of which no buffer may hold all values."""
    at = (0.01, 0.25, 0.5, 0.99)
    found = aggregate.quantiles(t.lineitem, ["l_extendedprice", "l_quantity"], at, buffer=500)
    rows = t.rows(list(zip(at, found["l_extendedprice"], found["l_quantity"])), "q double, price double, quantity double")
    return rows.withColumn("price", F.round("price", 6))


_STATS = "count({0}) AS count, count(*) - count({0}) AS null_count, round(avg({0}), 6) AS mean, round(stddev_samp({0}), 6) AS std, min({0}) AS min, quantile_cont({0}, 0.25) AS q25, quantile_cont({0}, 0.5) AS q50, quantile_cont({0}, 0.75) AS q75, max({0}) AS max"


@query(f"SELECT 'l_quantity' AS column, {_STATS.format('l_quantity')} FROM lineitem UNION ALL SELECT 'l_tax', {_STATS.format('l_tax')} FROM lineitem")
def describe(t):
    return aggregate.describe(t.lineitem, ["l_quantity", "l_tax"]).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


#: One group has most rows, and one key is null.
_HOT = (
    "CASE WHEN l_orderkey % 10 < 7 THEN 'hot' WHEN l_orderkey % 10 < 9 THEN l_returnflag END AS g",
    "l_extendedprice AS price",
    "CASE WHEN l_linenumber <> 3 THEN l_tax - 0.04 END AS tax",
)


@query(f"SELECT g, median(price) AS price_median, round(median(tax), 9) AS tax_median, count(tax) AS tax_count FROM (SELECT {', '.join(_HOT)} FROM lineitem) GROUP BY g")
def median_hot_group(t):
    """Medians per group found by rank, as for groups of which no buffer may hold all values."""
    rows = t.lineitem.selectExpr(*_HOT)
    spec = {"price": "median", "tax": ["median", "count"]}
    return aggregate.group_dict(rows, ["g"], spec, count_rows=False, buffer=1000).withColumn("tax_median", F.round("tax_median", 9))


#: Twenty columns of different spreads, with nulls, zeros, both signs, ties and large and small numbers.
_WIDE = {f"c{k}": e for k, e in enumerate(f"{a} * {b}" for a in ("l_quantity", "(l_extendedprice - 30000)", "(l_discount - 0.05)", "nullif(l_partkey % 17, 3)", "(l_orderkey - 20000)") for b in ("1", "1e12", "-1e-12", "0.25"))}
_WIDE_STATS = "count({0}) AS count, count(*) - count({0}) AS null_count, min({0})::DOUBLE AS min, max({0})::DOUBLE AS max, quantile_cont({0}::DOUBLE, 0.25) AS q25, quantile_cont({0}::DOUBLE, 0.5) AS q50, quantile_cont({0}::DOUBLE, 0.75) AS q75"


@query(" UNION ALL ".join(f"SELECT '{c}' AS column, " + _WIDE_STATS.format(f"({e})") + " FROM lineitem" for c, e in _WIDE.items()))
def describe_wide(t):
    """Twenty columns described with quartiles found by rank."""
    rows = t.lineitem.selectExpr(*[f"CAST({e} AS DOUBLE) AS {c}" for c, e in _WIDE.items()])
    return aggregate.describe(rows, buffer=1000).drop("mean", "std")


@query("SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(DISTINCT l_partkey) AS parts FROM lineitem")
def minmax_unique(t):
    return t.lineitem.agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi"), F.countDistinct("l_partkey").alias("parts"))


_W = "sum(1 - l_discount) AS w, sum(pow(1 - l_discount, 2)) AS ww, sum((1 - l_discount) * l_quantity) AS wx, sum((1 - l_discount) * l_quantity * l_quantity) AS wxx"


@query(
    f"SELECT l_returnflag, round(wx / w, 6) AS mean, round(w * w / ww, 4) AS n_eff, round((wxx / w - pow(wx / w, 2)) * (w * w / ww) / (w * w / ww - 1), 5) AS var FROM (SELECT l_returnflag, {_W} FROM lineitem GROUP BY ALL)",
)
def weighted_mean_var(t):
    m = aggregate.weighted_moments(t.lineitem.withColumn("w", 1 - F.col("l_discount")), "l_quantity", "w", ["l_returnflag"])
    return m.select("l_returnflag", F.round("mean", 6).alias("mean"), F.round("n_eff", 4).alias("n_eff"), F.round("var", 5).alias("var"))


@query(
    "WITH s AS (SELECT corr(l_quantity, l_extendedprice) AS a, corr(l_quantity, l_tax) AS b, corr(l_extendedprice, l_tax) AS c FROM lineitem) "
    "SELECT x, y, round(v, 5) AS corr FROM (SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, a AS v FROM s UNION ALL SELECT 'l_quantity', 'l_tax', b FROM s UNION ALL SELECT 'l_extendedprice', 'l_tax', c FROM s)"
)
def corr_matrix(t):
    return aggregate.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"]).where("x != y").withColumn("corr", F.round("corr", 5))


_FAR = "SELECT l_returnflag, 1 - l_discount AS w, l_quantity + 1e9::DOUBLE AS x FROM lineitem"


@query(
    f"SELECT l_returnflag, round(any_value(m) - 1e9::DOUBLE, 4) AS mean, round(sum(w * pow(x - m, 2)) / sum(w) * (pow(sum(w), 2) / sum(w * w)) / (pow(sum(w), 2) / sum(w * w) - 1), 4) AS var "
    f"FROM (SELECT *, 1e9::DOUBLE + sum(w * (x - 1e9::DOUBLE)) OVER (PARTITION BY l_returnflag) / sum(w) OVER (PARTITION BY l_returnflag) AS m FROM ({_FAR})) GROUP BY l_returnflag"
)
def weighted_mean_var_far(t):
    """Values that are far from zero against their spread."""
    df = t.lineitem.select("l_returnflag", (1 - F.col("l_discount")).alias("w"), (F.col("l_quantity") + 1e9).alias("x"))
    m = aggregate.weighted_moments(df, "x", "w", ["l_returnflag"])
    return m.select("l_returnflag", F.round(F.col("mean") - 1e9, 4).alias("mean"), F.round("var", 4).alias("var"))


@query("SELECT 'x' AS x, 'y' AS y, round(corr(l_quantity + 1e9::DOUBLE, l_extendedprice + 1e9::DOUBLE), 5) AS corr FROM lineitem")
def corr_matrix_far(t):
    df = t.lineitem.select((F.col("l_quantity") + 1e9).alias("x"), (F.col("l_extendedprice") + 1e9).alias("y"))
    return aggregate.correlations(df, ["x", "y"]).where("x != y").withColumn("corr", F.round("corr", 5))


@query("SELECT round(avg(x) - 1e9::DOUBLE, 4) AS mean, round(var_samp(x), 4) AS var FROM (SELECT l_quantity + 1e9::DOUBLE AS x FROM lineitem)")
def column_statistics_far(t):
    s = column_statistics(t.lineitem.select((F.col("l_quantity") + 1e9).alias("x")), "x")
    return s.select(F.round(F.col("mean") - 1e9, 4).alias("mean"), F.round("var", 4).alias("var"))


@query("SELECT event_type, round(sum(value) FILTER (event_id % 7 <> 0), 4) AS s, round(avg(value) FILTER (event_id % 7 <> 0), 6) AS m FROM events GROUP BY ALL")
def nan_sum_mean(t):
    df = t.events.withColumn("v", F.when(F.col("event_id") % 7 == 0, F.lit(math.nan)).otherwise(F.col("value")))
    g = aggregate.group_agg(df, ["event_type"], s=scalar.nan_sum(F.col("v")), m=scalar.nan_mean(F.col("v")))
    return g.select("event_type", F.round("s", 4).alias("s"), F.round("m", 6).alias("m"))


# --- sets and order ------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25)")
def top_k(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def sort(t):
    return LazyTable(t.orders.select("o_orderkey", "o_totalprice")).sort("o_totalprice", descending=True).df


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_name FROM customer")
def union_all(t):
    n, r, c = (LazyTable(df.select(F.col(x).alias("name"))) for df, x in ((t.nation, "n_name"), (t.region, "r_name"), (t.customer, "c_name")))
    return n.union(r, c).df


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def unique(t):
    return LazyTable(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber")).unique().df


@query("SELECT p_partkey, p_retailprice * 1.1::DOUBLE AS dearer FROM part")
def column_apply(t):
    return t.part.select("p_partkey", LazyTable(t.part)["p_retailprice"].apply(lambda v: v * 1.1, "double").alias("dearer"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY ALL")
def transform_compose(t):
    steps = [lambda df: df.where("o_totalprice > 1000"), lambda df: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))]
    out = LazyTable(t.orders)
    for s in steps:
        out = out.transform(s)
    return out.df
