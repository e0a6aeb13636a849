"""Weighted chains, watched plans, members in one job, near names, and methods of intervals."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import fuzzy, histogram, luminosity, statistics
from quillon.operators.processes import Processes
from quillon.sources.synthetic import generate
from quillon.table import LazyTable


@pytest.fixture(scope="module")
def members(spark):
    rows = [("data_a", i % 7, float(i), 0.5 + i % 3) for i in range(70)] + [("mumu_b", i % 5, -float(i), 2.0) for i in range(40)] + [("ee_c", 1, None, None)]
    return spark.createDataFrame(rows, "process string, __event__ int, x double, w double")


def test_weights_are_kept(spark, members):
    t = LazyTable(members).weighted("w")
    some = t.query("x > 10").one_candidate(["__event__"], "x").select(["x"]).sort("x").scaled(2.0)
    assert some.columns == ["x", "w"] and some.count() == 7 and some.lineage[-1] == "scaled 2.0"
    counts, edges = some.hist("x", 4, (0, 80))
    assert counts.sum() == pytest.approx(sum(2 * (0.5 + i % 3) for i in range(63, 70))) and len(edges) == 5
    with pytest.raises(KeyError):
        LazyTable(members).weighted("none")
    assert type(t.groupby("process").count()) is LazyTable
    assert t.hist_frame("x", 2, (0, 100)).columns[-4:] == ["error", "n_eff", "centre", "width"]
    got = t.filter("process = 'data_a'").moments("x").first()
    x, w = np.arange(70.0), 0.5 + np.arange(70) % 3
    assert got["mean"] == pytest.approx((x * w).sum() / w.sum())
    events = generate(spark, "mumu", 20)
    assert "lumi_weight" in LazyTable(events).weighted_by_luminosity("5S_scan").delta_columns().query("mu1P > 0").columns
    assert histogram.default_range("M_bc", histogram.RANGES_WIDE) == (5.20, 5.30) and histogram.default_range("M_bc") is None


def test_watched_steps(members):
    seen = LazyTable(members).observed().query("x > 10").filter(F.col("x") < 50).one_candidate(["__event__"], "x")
    profile = seen.profile()
    assert [(p["step"], p["rows"]) for p in profile[:-1]] == [("start", 111), ("query x > 10", 59), ("filter 1", 39), ("one_candidate", 7)]
    assert profile[-1]["seconds"] > 0
    with pytest.raises(ValueError):
        LazyTable(members).profile()
    counts, _, info = histogram.hist_observed(members, "x", 5, (0.0, 20.0), "w")
    assert (info["rows"], info["null"], info["below"], info["above"], info["in_range"]) == (111, 1, 39, 49, 22)
    assert counts.sum() == pytest.approx(info["weight"])


def test_members_in_one_job(spark, members):
    p = Processes(members, names=["data_a", "mumu_b", "ee_c", "gone"])
    spark.sparkContext.setJobGroup("names", "names")
    assert p.names() == ["data_a", "ee_c", "gone", "mumu_b"] == list(p.query("x > @low", low=1e9).names()) and p.query("x > @text", text=5).names()
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("names")  # no scan
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert p.members("data") == ["data_a"] and len(p.group("data")) == 1 and "new" in p.add_process("new", members.drop("process"))
    found = p.describe(["x", "w"])
    assert set(found) == {"data_a", "mumu_b", "ee_c"}
    row = found["data_a"].where("column = 'x'").first()
    assert (row["count"], row["q25"], row["q50"], row["max"]) == (70, 17.25, 34.5, 69.0)
    got, errors = p.aggregate_each(n=F.count("x"), top=F.max("x"))
    assert got["gone"] == {"n": 0, "top": None} and got["mumu_b"] == {"n": 40, "top": 0.0} and not errors
    got, errors = p.aggregate_each(bad=F.max(F.when(F.col("x") == 69, F.raise_error(F.lit("no"))).otherwise(F.col("x"))))
    assert set(errors) == {"data_a"} and got["mumu_b"]["bad"] == 0.0
    profile = p.profile()
    assert profile["rows"] == 111 and profile["by_process"] == {"data_a": 70, "ee_c": 1, "gone": 0, "mumu_b": 40}


@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_near_strings(spark, most):
    rng = random.Random(most)
    left = ["".join(rng.choice("abé中") for _ in range(rng.randint(0, 6))) for _ in range(60)] + [None]
    right = ["".join(rng.choice("abé中") for _ in range(rng.randint(0, 6))) for _ in range(60)] + [None, None]
    a, b = (spark.createDataFrame([(v,) for v in x], f"{n} string") for n, x in (("l", left), ("r", right)))
    got = {tuple(x) for x in fuzzy.near(a, b, "l", "r", most).collect()}
    every = a.distinct().crossJoin(b.distinct()).withColumn("d", F.levenshtein("l", "r")).where(f"d <= {most}")
    assert got == {tuple(x) for x in every.collect()} and got


def test_names_of_many_texts(spark):
    names = spark.createDataFrame([("MuMu",), ("mumu_x",), ("tau",)], "process string")
    texts = spark.createDataFrame([("MUMU",), ("tua",), ("zzzzzz",)], "text string")
    got = sorted(tuple(r) for r in luminosity.search_all(names, texts).collect())
    assert got == [("MUMU", "MuMu", 0), ("MUMU", "mumu_x", 2), ("tua", "tau", 2)]


def test_jackknife_as_by_hand(spark):
    rng = random.Random(1)
    rows = [(1e6 + rng.lognormvariate(0, 1), rng.choice([0.5, 1.0, 3.0])) for _ in range(1000)]
    x, w = map(np.array, zip(*rows))
    for weights in (w, np.ones(1000)):
        left = np.array([(np.delete(x - 1e6, i) @ np.delete(weights, i)) / np.delete(weights, i).sum() for i in range(1000)])
        d = left.mean() - left
        want = (d**3).sum() / (6 * (d**2).sum() ** 1.5)
        df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, weights)], "x double, w double")
        got = statistics.jackknife_acceleration(df).first()
        assert got["acceleration"] == pytest.approx(want, rel=1e-4) and got["n"] == 1000
    one = statistics.bootstrap_mean(spark.createDataFrame(rows, "x double, w double"), "x", 300, weight="w").first()
    assert one["lower"] < one["mean"] < one["upper"] and one["mean"] == pytest.approx((x * w).sum() / w.sum())
    assert statistics.bootstrap_mean(spark.createDataFrame([], "x double, w double"), "x", 5).first()["lower"] is None


def test_methods(spark):
    df = spark.createDataFrame([(float(k), 40.0, float(k)) for k in range(31)], "k double, n double, ww double")
    low = statistics.auto_intervals(df, "k", "n")
    assert sorted(map(tuple, low.collect())) == sorted(map(tuple, statistics.intervals(df, "poisson_exact", "k", "n").collect()))
    weighted = statistics.auto_intervals(df, "k", "n", "ww").where("k = 9").first()
    assert weighted["lower"] == pytest.approx(statistics.intervals(df, "barlow_beeston", "k", "ww").where("k = 9").first()["lower"])
    with pytest.raises(ValueError, match="bootstrap_mean"):
        statistics.auto_intervals(df.withColumn("k", F.col("k") + 0.5), "k", "n", "ww")
    few = df.limit(10).withColumn("k", F.col("k") + 0.5)
    plain, wide = (statistics.auto_intervals(few, "k", "n", s).where("k = 4.5").first() for s in (None, "ww"))
    assert wide["upper"] - wide["lower"] > plain["upper"] - plain["lower"]
    assert statistics.method_info("wilson") == {"weights": False, "counts": True, "least": 1}
    with pytest.raises(ValueError):
        statistics.method_info("none")
    ks = [0, 0.5, 1, 2, 7.25, 9, 10, 11, 50, 1e5]
    got = spark.createDataFrame([(float(k),) for k in ks], "k double").select("k", statistics.log_factorial(F.col("k"))).collect()
    assert all(v == pytest.approx(math.lgamma(k + 1), rel=1e-13, abs=1e-13) for k, v in got)


def test_the_rest_of_the_surface(spark, members):
    t = LazyTable(members).ordered_by("x")
    assert t.partition(3, "x").df.rdd.getNumPartitions() == 3
    assert 0 < t.sample(0.5, seed=1).count() < 111 and t.head(3).count() == 3
    from quillon.operators.selection import tail

    assert sorted(r["x"] for r in tail(members.where("x IS NOT NULL"), ["x"], 2).collect()) == [68.0, 69.0]
    p = Processes(members)
    assert p.shape() == (111, 4) and p.group("mumu").shape()[0] == 40
    p["data_a"], p["data_a"], p["ee_c"]
    assert p.access_stats() == {"accesses": {"data_a": 2, "ee_c": 1}, "most": [("data_a", 2)], "lineage": 0}
    assert p.add_process("tau_d", members.drop("process").limit(5)).counts().where("process = 'tau_d'").first()["count"] == 5
    assert p.validate().count() == 0 and p.query("x > 0").explain().startswith("0: query")
    names = ["mc_mumu", "data_proc_x", "tau"]
    assert luminosity.reference(names) == "data_proc_x" and luminosity.reference(names, "tau") == "tau" and luminosity.reference(["a"]) == "data_proc_4S_on"
