"""Quantiles by rank against sorted lists, on values that are hard to bin."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from quillon.operators import aggregate, quantiles
from quillon.operators.quantiles import group_medians, group_quantiles, with_order

INF, NAN = float("inf"), float("nan")


def values():
    rng = random.Random(2)
    out = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 2.0, math.nextafter(2, 0), 4.0, math.nextafter(4, 0)]
    out += [s * 2.0**e for e in range(-1074, 1024, 7) for s in (1, -1)] + [math.nextafter(2.0**e, 0) for e in range(-1000, 1024, 11)]
    return out + [struct.unpack("d", struct.pack("q", rng.randrange(-(2**63), 2**63)))[0] for _ in range(2000)]


def test_numbers_keep_the_order(spark):
    every = sorted({v for v in values() if not math.isnan(v)} | {INF, -INF}) + [NAN]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(every)], "i int, x double").repartition(3)
    got = [r[0] for r in with_order(rows, "x", "key").orderBy("i").select("key").collect()]
    assert all(a < b for a, b in zip(got, got[1:]))
    assert got[every.index(0.0)] == 0


def plain(some, q):
    some = sorted(some)
    h = (len(some) - 1) * q
    lo, hi = some[math.floor(h)], some[math.ceil(h)]
    return lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)


@pytest.mark.parametrize("few", [1, 50, 100_000])
def test_quantiles_of_groups(spark, few):
    rng = random.Random(7)
    rows = [("hot", rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 9), 3.5, -1e-300]), rng.randrange(5)) for _ in range(4000)]
    rows += [(rng.choice(["a", "b", None]), rng.uniform(-1, 1), None) for _ in range(60)] + [("one", 7.0, 1), ("empty", None, None), ("odd", NAN, 2), ("odd", INF, 3)]
    df = spark.createDataFrame(rows, "g string, x double, k int").withColumn("_c", F.lit("clash")).repartition(5)
    at = (0.0, 0.01, 0.5, 0.9, 1.0)
    got = {(r["_g0"], r["_c"], r["_q"]): r["value"] for r in group_quantiles(df, ["g"], ["x", "k"], at, few=few).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for c in (0, 1):
            some = [float(r[1 + c]) for r in rows if r[0] == g and r[1 + c] is not None and math.isfinite(r[1 + c])]
            want |= {(g, c, k): plain(some, q) for k, q in enumerate(at) if some}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12, abs=0) for k in want)


def test_medians_by_either_way(spark):
    rows = [(g, float(i * 37 % 101), i) for i in range(900) for g in ("a", None)] + [("nan", NAN, 1), ("nan", 1.0, 2), ("nan", 2.0, 3), ("none", None, 4)]
    df = spark.createDataFrame(rows, "g string, x double, i int")
    spec = {"x": ["mean", "median"], "i": ["median", "max"]}
    one, two = (sorted(map(str, aggregate.group_dict(df, ["g"], spec, buffer=b).collect())) for b in (10**6, 3))
    assert one == two and len(one) == 4
    assert aggregate.group_dict(df, ["g"], spec, buffer=3).columns == ["g", "x_mean", "x_median", "i_median", "i_max"]
    named = aggregate.group_agg(df, ["g"], F.count("x").alias("n"), buffer=3, x="median", top=F.max("i"))
    assert named.columns == ["g", "n", "x_median", "top"] and named.count() == 4
    assert group_medians(df.where("false"), ["g"], {"m": "x"}).collect() == []


def test_describe_by_either_way(spark):
    df = spark.createDataFrame([(i, float(i) ** 3, None if i % 3 else -i, None) for i in range(3000)], "a int, b double, c int, d double")
    one, two = (sorted(map(str, aggregate.describe(df, buffer=b).collect())) for b in (10**6, 10))
    assert one == two and len(one) == 4
    assert aggregate.quantiles(df, ["b", "d"], (0.5,), buffer=10) == {"b": [(1499**3 + 1500**3) / 2], "d": [None]}
    assert aggregate.describe(df.where("false"), buffer=0).where("count = 0 AND q50 IS NULL").count() == 4
    assert aggregate.column_stat(df, "a", "median") == 1499.5


def test_describe_reads_what_is_not_settled(spark, monkeypatch, tmp_path):
    """One pass for the statistics, one for the parts, and one more only over the columns with a part of many values."""
    few = [f"CAST(id % {k + 2} AS double) AS few{k}" for k in range(3)]
    spark.range(3000).selectExpr(*few, "id / 3000 AS many").repartition(3).write.parquet(str(tmp_path / "t"))
    table, read, plans = spark.read.parquet(str(tmp_path / "t")), spark.sparkContext.accumulator(0), []

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    found = aggregate.describe(table.mapInArrow(counted, table.schema), buffer=10).orderBy("column").collect()
    assert read.value == 3 * 3000 and [r["q50"] for r in found] == [0.5, 1.0, 1.5, 2999 / 2 / 3000]

    def watched(df, tag, kept=quantiles.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, tag)

    monkeypatch.setattr(quantiles, "written", watched)
    assert sorted(map(str, aggregate.describe(table, buffer=10).collect())) == sorted(map(str, found))
    assert len(plans) == 3 and "many:double" in plans[0] and "few0:double" in plans[0]
    assert "many:double" in plans[2] and "few" not in plans[2]


def test_parts_of_any_width(spark):
    """Columns of hard values: of all sizes, near each other and far, around zero and next to one."""
    hard = [v for v in values() if math.isfinite(v)]
    near = [math.nextafter(1, 0), 1.0] * 50 + [1 + k * 2.0**-52 for k in range(300)] + [k * 5e-324 for k in range(-300, 300)]
    df = spark.createDataFrame([("h", v) for v in hard] + [("n", v) for v in near] + [("z", v) for v in (0.0, -0.0, 5e-324)], "g string, x double").repartition(3)
    at = (0.1, 0.25, 0.5, 0.77, 0.9)
    got = {(r["_g0"], r["_q"]): r["value"] for r in group_quantiles(df, ["g"], ["x"], at, few=1).collect()}
    for g, some in (("h", hard), ("n", near), ("z", [0.0, -0.0, 5e-324])):
        assert all(got[g, k] == pytest.approx(plain(some, q), rel=1e-12, abs=0) for k, q in enumerate(at))


def test_group_describe_by_either_way(spark):
    rows = [(g, float(i % 77) - 30, None if i % 3 else i) for i in range(500) for g in ("a", None)] + [("odd", NAN, None), ("odd", INF, None), ("odd", 2.0, None)]
    df = spark.createDataFrame(rows, "g string, x double, k int").repartition(3)
    one, two = (sorted(map(str, aggregate.group_describe(df, ["g"], ["x", "k"], buffer=b).collect())) for b in (10**6, 10))
    assert one == two and len(one) == 6
    odd = {r["column"]: r for r in aggregate.group_describe(df.where("g = 'odd'"), ["g"], ["x", "k"]).collect()}
    assert (odd["x"]["count"], odd["x"]["q50"], odd["k"]["null_count"], odd["k"]["q50"]) == (3, 2.0, 3, None)
