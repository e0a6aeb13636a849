"""Queries on weighted chains, names, all members at once, and what running jobs see."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, fuzzy, histogram
from ..operators.processes import Processes
from ..table import LazyTable
from .base import EVENTS, bin_sql, query


_BEST = f"""SELECT process, "mu1P", weight / 2 AS w FROM (
  SELECT *, row_number() OVER (PARTITION BY "__event__" ORDER BY quality DESC, "__candidate__") AS nr FROM ({EVENTS}) WHERE "pRecoil" > 2 AND "mu1P" > 1) WHERE nr = 1"""


@query(f"""
WITH c AS ({_BEST}), h AS (SELECT process, {bin_sql('"mu1P"', 0.0, 3.0, 12)} AS bin, sum(w) AS sumw, sum(w * w) AS sumw2 FROM c GROUP BY ALL)
SELECT k.process, b.bin::INT AS bin, round(coalesce(sumw, 0), 6) AS sumw, round(sqrt(coalesce(sumw2, 0)), 6) AS error
FROM (SELECT DISTINCT process FROM c) k CROSS JOIN range(12) b(bin) LEFT JOIN h ON h.process = k.process AND h.bin = b.bin""")
def weighted_chain(t):
    """Selection, derived columns, candidates and a projection keep the weight; the histogram's range is the wide table's."""
    rows = LazyTable(t.events_mu).weighted("weight").query("pRecoil > 2 & mu1P > 1").delta_columns()
    best = rows.one_candidate(["__event__"], "quality", tiebreak=["__candidate__"]).scaled(0.5).select(["process", "mu1P"])
    return best.hist_frame("mu1P", 12, by=["process"]).select("process", "bin", F.round("sumw", 6).alias("sumw"), F.round("error", 6).alias("error"))


@query(
    "SELECT text, name, levenshtein(text, name)::INT AS distance FROM (SELECT DISTINCT p_name || p_size AS text FROM part WHERE p_partkey % 2 = 0), "
    "(SELECT DISTINCT p_name AS name FROM part) WHERE levenshtein(text, name) <= 2"
)
def fuzzy_names(t):
    """Names within two edits of others, found by what deletions make of them."""
    texts = t.part.where("p_partkey % 2 = 0").select(F.concat("p_name", "p_size").alias("text")).distinct()
    return fuzzy.near(texts, t.part.select(F.col("p_name").alias("name")), "text", "name", 2)


@query(f'SELECT process, count(*) AS n, round(avg(quality), 6) AS mean, max("mu1P") AS top FROM ({EVENTS}) GROUP BY process')
def aggregate_each(t):
    """Aggregates of each process from one job."""
    found, errors = Processes(t.events_mu).aggregate_each(n=F.count(F.lit(1)), mean=F.round(F.avg("quality"), 6), top=F.max("mu1P"))
    assert not errors
    return t.rows([(p, v["n"], v["mean"], v["top"]) for p, v in found.items()], "process string, n long, mean double, top double")


_QUARTILES = ", ".join(f"round(quantile_cont(quality, {q}), 6) AS q{round(100 * q)}" for q in (0.25, 0.5, 0.75))


@query(f"SELECT process, count(quality) AS count, {_QUARTILES} FROM ({EVENTS}) GROUP BY process")
def describe_each(t):
    """Each process described, with quartiles found by rank for all of them at once."""
    found = aggregate.group_describe(t.events_mu, ["process"], ["quality"], buffer=1000)
    return found.select("process", "count", *[F.round(q, 6).alias(q) for q in ("q25", "q50", "q75")])


@query(
    "SELECT count(*) AS rows, count(*) FILTER (x < 5000) AS below, count(*) FILTER (x > 60000) AS above, count(*) FILTER (x BETWEEN 5000 AND 60000) AS in_range, "
    "round(sum(1 - l_discount) FILTER (x BETWEEN 5000 AND 60000), 4) AS weight FROM (SELECT *, l_extendedprice AS x FROM lineitem)"
)
def hist_metrics(t):
    """What the job that fills a histogram saw."""
    rows = t.lineitem.withColumn("w", 1 - F.col("l_discount"))
    _, _, seen = histogram.hist_observed(rows, "l_extendedprice", 20, (5000.0, 60000.0), "w")
    return t.rows([(seen["rows"], seen["below"], seen["above"], seen["in_range"], round(seen["weight"], 4))], "rows long, below long, above long, in_range long, weight double")
