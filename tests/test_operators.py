import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import special
from quillon.operators import aggregate, derive, histogram, joins, luminosity, processes, selection, statistics
from quillon.sources import readers, sinks
from quillon.sources.synthetic import generate, generate_all
from quillon.streaming import histogram as streaming
from quillon.table import LazyTable


@pytest.mark.parametrize("bins, span, density", [(50, None, None), (100, (5.27, 5.29), None), (25, None, "in"), (200, (5.26, 5.30), None), (1, (5.0, 6.0), None), (10000, (5.0, 6.0), None)])
def test_hist_shapes(spark, bins, span, density):
    x = np.random.default_rng(1).normal(5.279, 0.003, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "M_bc double")
    h = histogram.hist(df, "M_bc", bins, span, density=density)
    counts, edges = histogram.counts_edges(h)
    assert len(counts) == bins and len(edges) == bins + 1
    if span:
        assert counts.sum() == ((x >= span[0]) & (x <= span[1])).sum()
    if density:
        assert h.agg(F.sum(F.col("density") * (F.col("hi") - F.col("lo")))).first()[0] == pytest.approx(1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=60), st.integers(1, 40))
def test_hist_agrees_with_numpy(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    counts, edges = histogram.counts_edges(histogram.hist(df, "x", bins, (-5.0, 5.0)))
    assert counts.sum() == len(values)
    assert edges[0] == -5 and edges[-1] == 5


def test_hist_of_nothing_and_of_odd_values(spark):
    empty = spark.createDataFrame([], "x double")
    assert histogram.counts_edges(histogram.hist(empty, "x", 10, (0.0, 1.0)))[0].sum() == 0
    odd = spark.createDataFrame([(None,), (math.nan,), (math.inf,), (1.0,), (0.0,), (2.0,)], "x double")
    assert histogram.counts_edges(histogram.hist(odd, "x", 2, (0.0, 1.0)))[0].tolist() == [1, 1]


def test_grouped_hist_keeps_empty_groups_and_null_keys(spark):
    df = spark.createDataFrame([("a", 0.5), ("b", 9.0), (None, 0.1)], "process string, x double")
    h = histogram.hist(df, "x", 2, (0.0, 1.0), by=["process"])
    assert h.count() == 6 and h.agg(F.sum("count")).first()[0] == 2


def test_hist_in_batches(spark):
    parts = [spark.range(10).select(F.col("id").cast("double").alias("x"))] * 4
    seen = []
    counts, edges, info = histogram.hist_batches(parts, "x", 5, (0.0, 9.0), progress=lambda p: seen.append(p.batches))
    assert counts.sum() == 40 and info.complete and seen == [1, 2, 3, 4] and len(edges) == 6
    counts, _, info = histogram.hist_batches(parts, "x", 5, (0.0, 9.0), time_budget_s=0.0)
    assert counts.sum() == 10 and not info.complete


def test_candidates(spark):
    rows = [(e, 1, q) for e in range(50) for q in range(5)]
    df = spark.createDataFrame(rows, "__event__ bigint, __run__ bigint, quality bigint")
    best = selection.one_candidate(df, sort_col="quality")
    assert best.count() == 50 and best.select("quality").distinct().collect()[0][0] == 4
    a, b = (selection.one_candidate(df.repartition(n), ["__event__"], "random").orderBy("__event__").collect() for n in (2, 7))
    assert a == b and len({r["quality"] for r in a}) > 1
    with pytest.raises(ValueError):
        selection.event_keys(df.select("quality"))
    nulls = spark.createDataFrame([(1, None), (1, 3), (2, None)], "k int, s int")
    assert selection.one_candidate(nulls, ["k"], "s").collect()[0].asDict() == {"k": 1, "s": 3}
    assert selection.one_candidate_any(df, ["__event__"]).count() == 50


def test_samples_keep_events_whole(spark):
    df = spark.range(2000).select((F.col("id") % 100).alias("__event__"))
    sizes = {r["count"] for r in selection.hash_sample(df, 0.3).groupBy("__event__").count().collect()}
    assert sizes == {20}


def test_delta_columns(spark):
    d = derive.delta_columns(generate(spark, "mumu", 300))
    worst = d.agg(F.max(F.abs(F.col("deltaMu1PRecoil") - F.col("absdAlpha1"))), F.max("absdPhi"), F.min("min_deltaMuPRecoil")).first()
    assert worst[0] < 1e-6 and worst[1] <= math.pi and worst[2] >= 0
    zero = generate(spark, "mumu", 3).withColumn("mu1P", F.lit(0.0))
    assert derive.delta_columns(zero).where("absdAlpha1 IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        derive.electron_id(d)


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z"), (2, "w"), (3, "q")], "k int, v string")
    assert joins.join(a, b, "k", "outer").columns == ["k", "v", "v_right"] and joins.join(a, b, "k", "outer").count() == 4
    with pytest.raises(ValueError):
        joins.merge(a, b, "k", validate="one_to_one")
    with pytest.raises(ValueError):
        joins.join(a, b, "k", "sideways")


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 4.0)], "g string, x double")
    rows = aggregate.group_dict(df, ["g"], {"x": ["count", "sum"]}).orderBy("g").collect()
    assert [tuple(r) for r in rows] == [("a", 2, 1.0), ("b", 1, 4.0)]
    assert aggregate.group_dict(df, ["g"], {"x": "count"}, count_rows=False).orderBy("g").collect()[0]["x_count"] == 1
    with pytest.raises(ValueError):
        aggregate.group_dict(df, ["g"], {"x": "mode"})
    assert aggregate.agg(df, "count") == {"total_count": 3} and aggregate.agg(df, "sum") == {"x": 5.0}


def test_weighted_correlation(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(400, 2)), rng.uniform(0.5, 2, 400)
    df = spark.createDataFrame([(float(a), float(a + b), float(c)) for (a, b), c in zip(x, w)], "x double, y double, w double")
    got = {(r["x"], r["y"]): r["corr"] for r in aggregate.correlations(df, ["x", "y"], "w").collect()}
    m = np.cov(np.stack([x[:, 0], x.sum(1)]), aweights=w, ddof=0)
    assert got["x", "y"] == pytest.approx(m[0, 1] / math.sqrt(m[0, 0] * m[1, 1]), rel=1e-9)


def test_special_functions():
    alpha = 1 - statistics.ONE_SIGMA
    assert special.gamma_quantile(1 - alpha / 2, 1.0) == pytest.approx(-math.log(alpha / 2))
    assert special.beta_quantile(alpha / 2, 1.0, 1.0) == pytest.approx(alpha / 2)
    k = np.arange(8)
    assert 1 - special.gamma_p(8.0, 3.3) == pytest.approx(sum(math.exp(-3.3) * 3.3**i / math.factorial(i) for i in k))
    assert 1 - special.beta_i(4.0, 7.0, 0.3) == pytest.approx(sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(4)))
    assert special.normal_quantile(0.975) == pytest.approx(1.959963985)


def test_intervals(spark):
    df = spark.createDataFrame([(0.0, 10.0), (1.0, 1.0), (5.0, 10.0), (10.0, 10.0), (None, 3.0), (0.0, 0.0)], "k double, n double")
    alpha = 1 - statistics.ONE_SIGMA
    cp = [r[0] for r in df.select(statistics.clopper_pearson("k", "n")).collect()]
    assert cp[0]["lower"] == 0 and cp[1]["lower"] == pytest.approx(alpha / 2) and cp[3]["upper"] == 1 and cp[4]["lower"] is None and tuple(cp[5]) == (0, 1)
    po = [r[0] for r in df.select(statistics.poisson_exact("k")).collect()]
    assert po[0]["upper"] == pytest.approx(-math.log(alpha / 2)) and po[2]["lower"] < 5 < po[2]["upper"]
    equal, short = ([r[0] for r in df.where("k = 5").select(statistics.beta_interval("k", "n", shortest=s)).collect()][0] for s in (False, True))
    assert short["upper"] - short["lower"] <= equal["upper"] - equal["lower"] + 1e-9
    pl = df.where("k = 5").select(statistics.profile_likelihood("k", "n")).first()[0]
    assert pl["lower"] < 0.5 < pl["upper"]
    scale = spark.createDataFrame([(12.0, 12.0)], "w double, ww double").select(statistics.barlow_beeston("w", "ww")).first()[0]
    assert scale["lower"] < 12 < scale["upper"]


def test_systematics_and_methods(spark):
    df = spark.createDataFrame([(100.0, 5.0, 102.0, 98.0)], "n double, s double, up double, down double")
    r = statistics.systematics(df, "n", "s", ["up", "down"]).first()
    assert r["syst"] == pytest.approx(math.sqrt(8)) and r["total"] == pytest.approx(math.sqrt(33))
    assert statistics.auto_method(10, True, False) == "clopper_pearson" and statistics.auto_method(500, False, True) == "bootstrap_bca"


def test_bootstrap_has_2000_replicas_by_default(spark):
    df = spark.range(60).select("id", (F.col("id") % 7 * 1.5).alias("x"))
    ends = lambda **o: tuple(statistics.bootstrap_mean(df, "x", key="id", **o).first())
    assert ends() == ends(replicas=2000) != ends(replicas=200)


def test_bootstrap_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 17).cast("double").alias("x"))
    a, b = (statistics.bootstrap_mean(df.repartition(n), "x", 50, key="id").first() for n in (2, 5))
    assert a["lower"] == pytest.approx(b["lower"]) and a["lower"] < a["mean"] < a["upper"]


def test_names_and_weights(spark):
    cases = {"test_mumu_v1": "mumu", "P16_mc_mu_mu_ISR": "mumu", "test_ee_v1": "ee", "mc_ee_gg": "ee", "test_ccbar_v1": "qqbar", "test_uubar_v1": "qqbar", "test_ddbar_mixed": "qqbar", "charged_B_decay": "BBbar", "mixed_B_decay": "BBbar", "tau_pair_production": "taupair", "eemumu_process": "llYY", "eeee_process": "llYY", "gg_fusion": "gg", "data_proc16_v1": "data"}
    names = spark.createDataFrame([(n,) for n in cases], "process string")
    got = {(r["process"], r["grp"]) for r in processes.classify(names).collect()}
    assert {(k, v) for k, v in cases.items()} <= got and {(k, "all") for k in cases} <= got
    parsed = {r["process"]: r for r in luminosity.batch_lookup(spark, ["P16M16rd_mc4S_uubar_p16_v1", "data_proc_4S_on", "mc5S_ccbar", "BBbar", "zzzzzzzzzz"]).collect()}
    assert parsed["P16M16rd_mc4S_uubar_p16_v1"]["physics"] == "uubar" and parsed["data_proc_4S_on"]["condition"] == "4S_on" and parsed["zzzzzzzzzz"]["found"] == "default"
    w = luminosity.mapping(luminosity.weights(spark.createDataFrame([("mc5S_mumu",), ("data_5S",), ("nothing",)], "process string"), "5S_scan"), "process", "weight")
    assert w["mc5S_mumu"] == pytest.approx(0.24999994) and w["data_5S"] == 1
    with pytest.raises(ZeroDivisionError):
        luminosity.Value(1.0) / luminosity.Value(0.0)
    assert (luminosity.Value(10, 1, 0) / luminosity.Value(5, 0, 0)).value == 2
    assert processes.classify_semantic("mumu_sample")[0] == "mumu"


def test_process_collection(spark, tmp_path):
    p = processes.Processes(generate_all(spark, 0.002))
    assert set(p) == {"mumu", "taupair", "ccbar", "data"} and "mumu" in p and p.members("qqbar") == ["ccbar"]
    with pytest.raises(KeyError, match="mumu"):
        p["mumuu"]
    hists = p.query("mu1P > 1").hist("pRecoil", bins=5, range=(0.0, 6.0))
    assert hists.count() == 20 and p.group_hist("pRecoil", bins=5, range=(0.0, 6.0)).where("grp = 'all'").count() == 5
    ok, bad = p.broadcast(lambda df: df.select("mu1P").count() if df.count() else 1)
    assert len(ok) == 4 and not bad
    assert set(p.broadcast(lambda df: df.select("nope"))[1]) == set(p)
    p2 = p.add_group("mine", ["mumu", "data"])
    p2.save_metadata(str(tmp_path / "m.json"))
    assert p.load_metadata(str(tmp_path / "m.json")).members("mine") == ["data", "mumu"] and p2.validate().count() == 0
    assert len(p.mumu) == 1
    with processes.Context().variation(bins=10) as c:
        assert c.bins == 10
    assert "| a | 1 |" in processes.report("t", {"a": 1})


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for kind in ("parquet", "csv", "json", "orc"):
        sinks.save(df.coalesce(1), str(tmp_path / f"t.{kind}"), kind)
        assert readers.scan(spark, str(tmp_path / f"t.{kind}")).orderBy("a").collect()[0]["a"] == 1
    with pytest.raises(ValueError):
        readers.scan(spark, "x.root")
    with pytest.raises(ValueError):
        sinks.save(df, str(tmp_path / "t.x"), "x")
    (tmp_path / "t.tsv").write_text("a\tb\n1\tNA\n")
    assert readers.scan(spark, str(tmp_path / "t.tsv")).first()["b"] is None
    assert sum(len(c) for c in sinks.iter_chunks(spark.range(25), 10)) == 25
    assert sinks.materialize(df, "arrow").num_rows == 2 and sinks.to_list(df.orderBy("a"), "a") == [1, 2]
    base = tmp_path / "d"
    base.mkdir()
    for n in ("mumu", "ee"):
        df.toPandas().to_parquet(base / f"{n}.parquet")
    assert {r[0] for r in readers.load_process_dir(spark, str(base)).select("process").distinct().collect()} == {"mumu", "ee"}
    assert readers.discover(spark, str(base), "manual") and readers.validate_files(spark, [str(base / "mumu.parquet")], least=1, required=["a", "zz"])
    with pytest.raises(TypeError):
        readers.from_memory(spark, [df, "x.csv"])
    assert readers.from_memory(spark, [df, df]).count() == 4


def test_loaders_by_layout(spark, tmp_path):
    flat, part = tmp_path / "flat", tmp_path / "part" / "mc5S_mumu"
    flat.mkdir()
    part.mkdir(parents=True)
    pdf = generate(spark, "x", 20).drop("process").toPandas()
    for n in ("data-prompt_vpho", "mc16-mumu-prompt_vpho"):
        pdf.to_parquet(flat / f"{n}.parquet")
    pdf.to_parquet(part / "a_vpho_1.parquet")
    assert {r[0] for r in readers.load_flat(spark, str(flat), "vpho").select("process").distinct().collect()} == {"data-prompt", "mumu-prompt"}
    got = readers.load_particle(spark, str(tmp_path / "part"), "vpho", ["mu1P", "pRecoil"])
    assert got.count() == 20 and got.first()["lumi_weight"] == pytest.approx(0.24999994)
    assert readers.load_flat(spark, str(flat), "vpho", "5S_scan").count() == 40  # none says it, so all
    found = readers.resolve_dirs(spark, str(tmp_path), ["flat", "none"])
    assert found["none"] == (None, None) and found["flat"][0] is None and found["flat"][1].endswith("/flat")


def test_samples_by_type(spark, tmp_path):
    pdf = generate(spark, "x", 30).drop("process").toPandas()
    quoted, plain, tasks = tmp_path / "'sample_name=mumu_1'", tmp_path / "ccbar_2", tmp_path / "tau_3" / "subtasks"
    for d in (quoted / "deep", plain, tasks):
        d.mkdir(parents=True)
    pdf.to_parquet(quoted / "deep" / "a_combined_vpho.parquet")
    pdf.to_parquet(quoted / "other_gamma.parquet")
    pdf.to_parquet(plain / "x y_vpho.parquet")
    pdf.to_parquet(plain / "luigi_tmp_vpho.parquet")
    pdf.to_parquet(tasks / "one_vpho.parquet")
    pdf.to_parquet(tasks / "two_vpho.parquet")
    dirs = readers.resolve_dirs(spark, str(tmp_path), ["mumu_1", "ccbar_2", "tau_3"])
    how = {n: readers.discover_by_type(spark, w, "vpho") for n, w in dirs.items()}
    assert {n: (len(f), h) for n, (f, h) in how.items()} == {"mumu_1": (1, "combined"), "ccbar_2": (1, "fallback"), "tau_3": (2, "subtasks")}
    assert readers.discover_by_type(spark, dirs["tau_3"], "muon")[1] == "subtasks" and readers.discover_by_type(spark, dirs["ccbar_2"], "gamma") == ([], "none")
    p = readers.load_samples(spark, str(tmp_path), ["mumu_1", "ccbar_2", "tau_3", "gone"], "vpho", ["mu1P", "zz"])
    assert {r["process"]: r["count"] for r in p.counts().collect()} == {"mumu_1": 30, "ccbar_2": 30, "tau_3": 60}
    assert p.list_groups() == {"mumu": 1, "qqbar": 1, "taupair": 1, "all": 3} and set(p.table.columns) == {"mu1P", "process"}
    with pytest.raises(FileNotFoundError):
        readers.load_samples(spark, str(tmp_path), ["gone"])


def test_scan_finds_the_kind(spark, tmp_path):
    df = spark.range(50).select("id", (F.col("id") * 2).alias("b"))
    df.repartition(3).write.parquet(str(tmp_path / "plain"))
    assert readers.scan(spark, str(tmp_path / "plain")).count() == 50 == readers.scan(spark, str(tmp_path / "pla*")).count()
    df.coalesce(1).write.csv(str(tmp_path / "c"), header=True)
    assert readers.load_table(spark, str(tmp_path / "c"), ["id"], ["b > 90"]).count() == 4
    (tmp_path / "f").mkdir()
    for k in range(2):
        df.where(f"id % 2 = {k}").toPandas().to_feather(tmp_path / "f" / f"{k}.feather")
    got = readers.scan(spark, str(tmp_path / "f"))
    assert got.columns == ["id", "b"] and got.count() == 50 and readers.scan(spark, str(tmp_path / "f" / "1.feather")).count() == 25
    (tmp_path / "mixed").mkdir()
    for n in ("a.csv", "b.json"):
        (tmp_path / "mixed" / n).write_text("{}")
    with pytest.raises(ValueError):
        readers.scan(spark, str(tmp_path / "mixed"))


def test_quantiles_beyond_the_buffer(spark):
    values = [float(v) for v in np.random.default_rng(7).normal(size=3000)] + [5.0] * 500 + [-1e300, 1e300]
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (math.nan, None), (math.inf, None)], "x double, y double").repartition(3)
    at = (0.0, 0.01, 0.37, 0.5, 0.9, 1.0)
    for buffer in (10, 400, 10_000):
        assert aggregate.quantiles(df, ["x", "y"], at, buffer) == {"x": pytest.approx(list(np.quantile(values, at))), "y": [None] * len(at)}


def test_moments_far_from_zero(spark):
    x = np.random.default_rng(1).normal(size=4000)
    df = spark.createDataFrame([(float(1e9 + v), float(1e9 + v + 1), 1.0, None) for v in x], "x double, y double, w double, k string")
    assert aggregate.weighted_moments(df, "x", "w").first()["var"] == pytest.approx(np.var(x, ddof=1), rel=1e-5)
    assert aggregate.weighted_moments(df, "x", "w", ["k"]).first()["var"] == pytest.approx(np.var(x, ddof=1), rel=1e-5)
    assert aggregate.correlations(df, ["x", "y"]).where("x != y").first()["corr"] == pytest.approx(1)
    narrow = histogram.moments(histogram.hist(df, "x", 100, (1e9 - 5, 1e9 + 5))).first()
    assert narrow["sigma"] == pytest.approx(x.std(), rel=0.01)


def test_names_by_meaning():
    say = processes.classify_semantic
    assert say("mc_generic_bbbar_charged_v1")[::2] == ("BBbar", "sure") and say("continuum_uubar")[:2] == ("qqbar", 0.90)
    assert say("sample_name='P16_mumu_combined'")[0] == "mumu" and say("mc_p16_v1")[0] == "other"
    assert say("taupaire_x")[0] == "taupair" and say("qwertz")[2] == "unknown"


def test_methods_by_name(spark):
    df = spark.createDataFrame([(3.0, 10.0), (5.0, 20.0)], "k double, n double")
    auto = [tuple(r) for r in statistics.auto_intervals(df).collect()]
    assert auto == [tuple(r) for r in statistics.intervals(df, "clopper_pearson").collect()]
    h = histogram.hist(spark.range(100).select((F.col("id") / 10).alias("x")), "x", 5, (0.0, 10.0))
    for method in ("poisson_exact", "jeffreys_poisson", "wilson"):
        rows = statistics.hist_uncertainty(h, method=method).collect()
        assert len(rows) == 5 and all(r["lower"] < r["upper"] for r in rows)
    with pytest.raises(ValueError):
        statistics.intervals(df, "guess")
    assert luminosity.calculated_weights(luminosity.batch_lookup(spark, ["mumu"]), 5.0).first()["weight"] > 0
    passed, base = (histogram.hist(spark.range(100).where(w).select((F.col("id") / 10).alias("x")), "x", 5, (0.0, 10.0)) for w in ("id % 2 = 0", "id >= 0"))
    assert {r["efficiency"] for r in histogram.efficiency_counts(passed, base).collect()} == {0.5}


def test_table(spark):
    df = spark.createDataFrame([(i, 100 + i, "XYZ"[i % 3]) for i in range(100)], "a bigint, b bigint, c string")
    t = LazyTable(df, order=["a"])
    chain = t.query("a > 10").query("b < 180").select(["a", "c"]).query("c == 'X'")
    assert chain.count() == sum(1 for i in range(11, 80) if i % 3 == 0) and len(chain.lineage) == 4
    assert [r["a"] for r in t[10:20:3].sort("a").collect()] == [10, 13, 16, 19]
    assert t[t["a"] > 97].count() == 2 and t["a"].max() == 99
    assert [r["a"] for r in t[np.array([5, 1, -1])].collect()] == [5, 1, 99]
    for k in (slice(-5, None), slice(None, None, -1), slice(-3, 5, -30), slice(90, None), slice(None, -97), slice(5, 2), slice(3, -90, 2)):
        assert [r["a"] for r in t[k].collect()] == list(range(100))[k], k
    with pytest.raises(IndexError):
        t[np.array([100])]
    flagged = LazyTable(df.withColumn("f", F.col("a") % 10 == 0))
    assert flagged[flagged["f"]].count() == 10 and flagged.sum("a") == {"a": 4950}
    assert t.query("a > @text & b < @columns", text=95, columns=199).count() == 3
    assert [tuple(r) for r in df.where("a = 3").select(2 * t["a"], -t["a"], 1 - t["a"], 6 / t["a"], t["a"] % 2).collect()] == [(6, -3, -2, 2.0, 1)]
    with pytest.raises(KeyError):
        t.select(["zz"])
    with pytest.raises(KeyError):
        t.query("zz > 1")
    with pytest.raises(ValueError):
        LazyTable(df)[1:2]
    counts, edges = t.hist("a", 10, (0, 99))
    assert counts.sum() == 100 and len(edges) == 11


def test_streaming_hist_equals_batch(spark, tmp_path):
    df = spark.range(200).select((F.col("id") / 10).alias("x"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_hist(streaming.read_stream(spark, str(tmp_path / "in"), "x double"), "x", 5, 0.0, 20.0)
    q = stream.writeStream.format("memory").queryName("h").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = {r["bin"]: r["count"] for r in histogram.hist(df, "x", 5, (0.0, 20.0)).collect()}
    assert {r["bin"]: r["count"] for r in spark.table("h").collect()} == batch
