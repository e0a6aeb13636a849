"""Queries on candidates, derived columns, histograms, processes, weights and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import derive, histogram, luminosity, processes, selection, statistics
from ..table import LazyTable
from .base import EVENTS, bin_sql, dense_sql, query

TIES = ("__candidate__", "partkey")
_KEYS = ["__event__"]
_TIE_SQL = '"__candidate__", partkey'


def _best_sql(order: str, where: str = "true", keys: str = '"__event__"', columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}, {_TIE_SQL}) AS nr FROM ({EVENTS}) WHERE {where}) WHERE nr = 1"


# --- flagship: selection, one candidate an event, histogram ------------------------

_CUT = "l_quantity > 5 & 45 > l_quantity & (l_discount > 0.02 | l_tax > 0.04)"
_CUT_SQL = "l_quantity > 5 AND 45 > l_quantity AND (l_discount > 0.02 OR l_tax > 0.04)"
_FLAG = (
    f"SELECT l_discount, {bin_sql('l_extendedprice', 0.0, 110000.0, 50)} AS bin FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS nr "
    f"FROM lineitem WHERE {_CUT_SQL}) WHERE nr = 1"
)


@query(dense_sql(_FLAG, 50, sums="count(*) AS count, sum(1 - l_discount) AS sumw", columns="coalesce(count, 0) AS count, round(coalesce(sumw, 0), 6) AS sumw"))
def flagship(t):
    """Selection string, best candidate of each order, weighted histogram of its price."""
    df = t.lineitem.withColumn("w", 1 - F.col("l_discount"))
    ties = ("l_linenumber", "l_partkey", "l_suppkey")
    h = processes.quick_analysis(df, [_CUT], ["l_orderkey"], "l_extendedprice", "l_extendedprice", 50, (0.0, 110000.0), ties, weights="w", decisive=True)
    return h.select("bin", "count", F.round("sumw", 6).alias("sumw"))


# --- candidates ------------------------------------------------------------------------


@query(_best_sql("quality DESC", columns='"__event__", "__candidate__", partkey, quality'))
def one_cand_ranked(t):
    return selection.one_candidate(t.events_mu, _KEYS, "quality", tiebreak=TIES).select("__event__", "__candidate__", "partkey", "quality")


@query(_best_sql('"mu1P"', columns='"__event__", "__candidate__", partkey, "mu1P"'))
def one_cand_ascending(t):
    return selection.one_candidate(t.events_mu, _KEYS, "mu1P", ascending=True, tiebreak=TIES).select("__event__", "__candidate__", "partkey", "mu1P")


@query(_best_sql("q DESC", "q IS NOT NULL", columns='"__event__", partkey').replace(f"({EVENTS})", f"(SELECT *, CASE WHEN partkey % 3 <> 0 THEN quality END AS q FROM ({EVENTS}))"))
def one_cand_null(t):
    """A null value never wins, and events with none but nulls disappear."""
    df = t.events_mu.withColumn("q", F.when(F.col("partkey") % 3 != 0, F.col("quality")))
    return selection.one_candidate(df, _KEYS, "q", tiebreak=TIES).select("__event__", "partkey")


@query(f'SELECT "__event__", "__candidate__", partkey FROM (SELECT *, row_number() OVER (PARTITION BY "__event__" ORDER BY {_TIE_SQL}) AS nr FROM ({EVENTS})) WHERE nr = 1')
def one_cand_first(t):
    return selection.one_candidate(t.events_mu, tiebreak=TIES).select("__event__", "__candidate__", "partkey")


@query(_best_sql("md5(concat_ws(':', '42', \"__event__\", \"__candidate__\", partkey))", columns='"__event__", "__candidate__", partkey'))
def one_cand_random(t):
    return selection.one_candidate(t.events_mu, _KEYS, "random", tiebreak=TIES).select("__event__", "__candidate__", "partkey")


@query(_best_sql("quality DESC", columns='"__event__", quality AS "chiProb"'))
def one_cand_physics(t):
    df = t.events_mu.withColumnRenamed("quality", "chiProb")
    return selection.one_candidate_by_mode(df, "B_meson", _KEYS).select("__event__", "chiProb")


@query(f'SELECT "__event__", max(quality) AS quality FROM ({EVENTS}) GROUP BY ALL')
def one_cand_aggregate(t):
    return selection.best_by(t.events_mu, _KEYS, "quality").select("__event__", "quality")


# --- derived columns ----------------------------------------------------------------------

_PI = "pi()"


def _dphi(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} - {b}) > {_PI} THEN 2 * {_PI} - abs({a} - {b}) ELSE abs({a} - {b}) END"


def _angle_sql(p1, t1, f1, p2, t2, f2, clip: bool = True) -> str:
    dot = f"({p1}*sin({t1})*cos({f1})*{p2}*sin({t2})*cos({f2}) + {p1}*sin({t1})*sin({f1})*{p2}*sin({t2})*sin({f2}) + {p1}*cos({t1})*{p2}*cos({t2}))"
    c = f"{dot} / nullif(abs({p1}) * abs({p2}), 0)"
    return f"acos(least(greatest({c}, -1), 1))" if clip else f"acos({c})"


_R = ('"pRecoil"', '"pRecoilTheta"', '"pRecoilPhi"')
_DELTA = {"absdPhi": _dphi('"mu1Phi"', '"mu2Phi"'), "pTRecoil": '"pRecoil" * sin("pRecoilTheta")'}
for _i in "12":
    _p, _t, _f, _ct, _cf = (f'"mu{_i}{c}"' for c in ("P", "Theta", "Phi", "clusterTheta", "clusterPhi"))
    _DELTA |= {
        f"absdPhiMu{_i}": _dphi(_cf, '"pRecoilPhi"'), f"absdThetaMu{_i}": f'abs({_ct} - "pRecoilTheta")', f"mu{_i}Pt": f"{_p} * sin({_t})",
        f"dRMu{_i}": f'sqrt(pow({_dphi(_cf, _R[2])}, 2) + pow({_ct} - "pRecoilTheta", 2))',
        f"absdAlpha{_i}": _angle_sql(_p, _t, _f, *_R),
        f"deltaMu{_i}PRecoil": _angle_sql(f"({_p}*sin({_t}))", _t, _f, f"({_R[0]}*sin({_R[1]}))", *_R[1:]),
        f"deltaMu{_i}ClusterPRecoil": _angle_sql(f"({_p}*sin({_t}))", _t, _cf, f"({_R[0]}*sin({_R[1]}))", *_R[1:]),
    }
_LEAST = {f"min_deltaMu{k}PRecoil": f'least("deltaMu1{k}PRecoil", "deltaMu2{k}PRecoil")' for k in ("", "Cluster")}
_DELTA_SQL = f'SELECT *, {", ".join(f"{e} AS {chr(34)}{c}{chr(34)}" for c, e in _LEAST.items())} FROM (SELECT *, {", ".join(f"{e} AS {chr(34)}{c}{chr(34)}" for c, e in _DELTA.items())} FROM ({EVENTS}))'
_ID = ("__event__", "__candidate__", "partkey")


@query(f'SELECT "__event__", "__candidate__", partkey, {", ".join(f"round({chr(34)}{c}{chr(34)}, 5) AS {chr(34)}{c}{chr(34)}" for c in (*_DELTA, *_LEAST))} FROM ({_DELTA_SQL})')
def delta_columns(t):
    # As doubles: F.round goes through decimals.
    return derive.delta_columns(t.events_mu).select(*_ID, *[(F.rint(F.col(c) * 1e5) / 1e5).alias(c) for c in (*_DELTA, *_LEAST)])


@query(
    f'SELECT count(*) AS n, round(sum("mu1P"), 3) AS p FROM ({_DELTA_SQL}) WHERE "absdPhi" > 1.5 AND "min_deltaMuPRecoil" > 0.3 AND ("absdPhiMu1" > 0.4 OR "absdThetaMu1" > 0.4)',
)
def query_derives(t):
    """A selection on columns that are derived first."""
    q = LazyTable(t.events_mu).query("absdPhi>1.5&min_deltaMuPRecoil>0.3&(absdPhiMu1>0.4|absdThetaMu1>0.4)")
    return q.df.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("mu1P"), 3).alias("p"))


@query(f'SELECT "__event__", "__candidate__", partkey, "mu1P" - "pRecoil" AS "delta_pRecoil_mu1P", "mu2P" - "pRecoil" AS "delta_pRecoil_mu2P" FROM ({EVENTS})')
def delta_simple(t):
    return derive.delta_simple(t.events_mu, "pRecoil", ["mu1P", "mu2P"]).select(*_ID, "delta_pRecoil_mu1P", "delta_pRecoil_mu2P")


_SEP = f"coalesce(CASE WHEN isnan(a) THEN 4.0 ELSE a END, 4.0)"
_PHOTON = f'SELECT *, {_SEP} AS sep FROM (SELECT *, {_angle_sql(*_R, chr(34) + "E" + chr(34), "theta", "phi", clip=False)} AS a FROM ({EVENTS}) WHERE "E" <> 0)'


@query(
    f'SELECT "__event__", partkey, round(coalesce("E" / nullif("pRecoil", 0), 0), 6) AS "EoPRecoil" FROM (SELECT *, row_number() OVER (PARTITION BY "__event__" ORDER BY sep, {_TIE_SQL}) AS nr FROM ({_PHOTON})) WHERE nr = 1 AND ("E" > 0.075 OR "E" IS NULL)',
)
def best_photon(t):
    b = derive.best_photon(t.events_mu.where("E != 0"), tiebreak=TIES)
    return b.select("__event__", "partkey", F.round("EoPRecoil", 6).alias("EoPRecoil"))


@query(
    f'SELECT "__event__", "__candidate__", partkey, round("pRecoil" * sin("pRecoilTheta"), 6) AS "pTRecoil", round(sqrt("eRecoil"), 6) AS "sqrtERecoil", round("m2Recoil" / nullif("mRecoil", 0), 6) AS "m2_over_m_recoil" FROM ({EVENTS})',
)
def recoil_properties(t):
    return derive.recoil_properties(t.events_mu).select(*_ID, *[F.round(c, 6).alias(c) for c in ("pTRecoil", "sqrtERecoil", "m2_over_m_recoil")])


@query(
    f'SELECT "__event__", "__candidate__", partkey, "E" * 0.3::DOUBLE + theta * 0.3::DOUBLE AS electron_id, partkey % 14 / 14 * 0.5::DOUBLE + ("mu1P" + "mu2P") / 20 * 0.5::DOUBLE AS muon_id FROM ({EVENTS})',
)
def particle_id(t):
    df = t.events_mu.withColumns({"E_over_p": F.col("E"), "track_match": F.col("theta"), "klm": (F.col("partkey") % 14).cast("double")})
    return derive.muon_id(derive.electron_id(df)).select(*_ID, "electron_id", "muon_id")


@query(
    f'SELECT "__event__", "__candidate__", partkey, round(sqrt(pow(e1 + e2, 2) - pow("mu1P"*sin("mu1Theta")*cos("mu1Phi") + "mu2P"*sin("mu2Theta")*cos("mu2Phi"), 2) - pow("mu1P"*sin("mu1Theta")*sin("mu1Phi") + "mu2P"*sin("mu2Theta")*sin("mu2Phi"), 2) - pow("mu1P"*cos("mu1Theta") + "mu2P"*cos("mu2Theta"), 2)), 5) AS mass FROM (SELECT *, sqrt("mu1P" * "mu1P" + 0.0111637) AS e1, sqrt("mu2P" * "mu2P" + 0.0111637) AS e2 FROM ({EVENTS}))',
)
def invariant_mass(t):
    energy = lambda p: F.sqrt(F.col(p) * F.col(p) + F.lit(0.0111637))
    df = t.events_mu.withColumns({"mu1E": energy("mu1P"), "mu2E": energy("mu2P")})
    return derive.invariant_mass(df, ["mu1", "mu2"], "mass").select(*_ID, F.round("mass", 5).alias("mass"))


# --- histograms ---------------------------------------------------------------------------------

_BIN = bin_sql("l_extendedprice", 1000.0, 100000.0, 40)
_HCOLS = "coalesce(count, 0) AS count, round(coalesce(sumw, 0), 6) AS sumw, round(coalesce(sumw2, 0), 6) AS sumw2"
_HSUMS = "count(*) AS count, sum(1 - l_discount) AS sumw, sum(pow(1 - l_discount, 2)) AS sumw2"


def _w():
    return 1 - F.col("l_discount")


def _rounded(h, *keys):
    return h.select(*keys, "bin", "count", F.round("sumw", 6).alias("sumw"), F.round("sumw2", 6).alias("sumw2"))


@query(dense_sql(f"SELECT {_BIN} AS bin FROM lineitem", 40))
def hist(t):
    return histogram.hist(t.lineitem, "l_extendedprice", 40, (1000.0, 100000.0)).select("bin", "count")


@query(dense_sql(f"SELECT {_BIN} AS bin FROM lineitem", 40))
def hist_batches(t):
    """The histogram summed over three parts of the table."""
    parts = [t.lineitem.where(F.col("l_orderkey") % 3 == k) for k in range(3)]
    counts, _, _ = histogram.hist_batches(parts, "l_extendedprice", 40, (1000.0, 100000.0))
    return t.rows([(i, int(c)) for i, c in enumerate(counts)], "bin int, count long")


@query(dense_sql(f"SELECT l_discount, {_BIN} AS bin FROM lineitem", 40, sums=_HSUMS, columns=_HCOLS))
def hist_weighted(t):
    return _rounded(histogram.hist(t.lineitem, "l_extendedprice", 40, (1000.0, 100000.0), _w()))


@query(dense_sql(f"SELECT l_returnflag, l_discount, {_BIN} AS bin FROM lineitem", 40, "l_returnflag", _HSUMS, _HCOLS))
def hist_broadcast(t):
    return _rounded(histogram.hist(t.lineitem, "l_extendedprice", 40, (1000.0, 100000.0), _w(), by=["l_returnflag"]), "l_returnflag")


@query(dense_sql(f"SELECT {_BIN} AS bin FROM lineitem", 40, columns="round(coalesce(count, 0) / ((SELECT count(*) FROM r WHERE bin IS NOT NULL) * 2475.0::DOUBLE), 12) AS density"))
def hist_density(t):
    return histogram.hist(t.lineitem, "l_extendedprice", 40, (1000.0, 100000.0), density="in").select("bin", F.round("density", 12).alias("density"))


@query(dense_sql(f"SELECT {_BIN} AS bin FROM lineitem", 40, columns="round(coalesce(count, 0) / ((SELECT count(*) FROM r) * 2475.0::DOUBLE), 12) AS density"))
def hist_density_all(t):
    return histogram.hist(t.lineitem, "l_extendedprice", 40, (1000.0, 100000.0), density="all").select("bin", F.round("density", 12).alias("density"))


@query(
    dense_sql(f"SELECT {bin_sql('x', 0.0, 50.0, 25)} AS bin FROM (SELECT CASE WHEN l_linenumber % 4 <> 1 AND l_linenumber % 4 <> 2 THEN l_quantity END AS x FROM lineitem)", 25)
)
def hist_finite(t):
    x = F.when(F.col("l_linenumber") % 4 == 1, F.lit(float("nan"))).when(F.col("l_linenumber") % 4 == 2, F.lit(float("inf"))).otherwise(F.col("l_quantity"))
    return histogram.hist(t.lineitem.withColumn("x", x), "x", 25, (0.0, 50.0)).select("bin", "count")


@query("SELECT i::INT AS bin, round(-0.3::DOUBLE + i * (0.6::DOUBLE / 12), 12) AS lo FROM range(12) r(i)")
def hist_edges(t):
    e = histogram.edges(-0.3, 0.3, 12)
    rows = t.rows([(i, float(x)) for i, x in enumerate(e[:-1])], "bin int, lo double")
    return rows.select("bin", F.round("lo", 12).alias("lo"))


@query(
    "SELECT round(lo - (hi - lo) * 0.1::DOUBLE, 4) AS lo, round(hi + (hi - lo) * 0.1::DOUBLE, 4) AS hi, round(a, 4) AS least, round(b, 4) AS most FROM (SELECT quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.99) AS hi, min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem)"
)
def hist_range(t):
    lo, hi = histogram.range_of(t.lineitem, "l_extendedprice")
    least, most = histogram.minmax_range(t.lineitem, "l_extendedprice")
    return t.rows([(lo, hi, least, most)], "lo double, hi double, least double, most double").select(*[F.round(c, 4).alias(c) for c in ("lo", "hi", "least", "most")])


@query(
    dense_sql(
        f"SELECT l_discount, {_BIN} AS bin FROM lineitem",
        40,
        sums=_HSUMS,
        columns="round(sqrt(coalesce(sumw2, 0)), 6) AS error, round(sumw * sumw / nullif(sumw2, 0), 4) AS n_eff, round(1000.0::DOUBLE + (b.bin + 0.5::DOUBLE) * 2475, 4) AS centre",
    ),
)
def hist_sumw2(t):
    h = histogram.with_errors(histogram.hist(t.lineitem, "l_extendedprice", 40, (1000.0, 100000.0), _w()))
    return h.select("bin", F.round("error", 6).alias("error"), F.round("n_eff", 4).alias("n_eff"), F.round("centre", 4).alias("centre"))


@query(dense_sql(f"SELECT {_BIN} AS bin FROM lineitem", 40, columns="coalesce(count, 0) * 0.25::DOUBLE AS sumw, coalesce(count, 0) * 0.0625::DOUBLE AS sumw2"))
def hist_weight_scalar(t):
    return histogram.scaled(histogram.hist(t.lineitem, "l_extendedprice", 40, (1000.0, 100000.0)), 0.25).select("bin", "sumw", "sumw2")


_GRP = "CASE process WHEN 'AF' THEN 'mumu' WHEN 'AO' THEN 'mumu' WHEN 'NF' THEN 'qqbar' WHEN 'NO' THEN 'qqbar' WHEN 'RF' THEN 'gg' ELSE 'data' END"
_GB = bin_sql("quality", 0.0, 110000.0, 20)
_GSQL = dense_sql(
    f"SELECT {_GRP} AS grp, weight, {_GB} AS bin FROM ({EVENTS})",
    20,
    "grp",
    "count(*) AS count, sum(weight) AS sumw, sum(weight * weight) AS sumw2",
    "coalesce(count, 0) AS count, coalesce(sumw, 0) AS sumw, coalesce(sumw2, 0) AS sumw2",
)


def _groups(t):
    h = histogram.hist(t.events_mu, "quality", 20, (0.0, 110000.0), "weight", by=["process"])
    return histogram.grouped(h.withColumn("grp", F.expr(_GRP)))


@query(f"SELECT grp, bin, count, round(sumw, 6) AS sumw, round(sumw2, 6) AS sumw2 FROM ({_GSQL})")
def hist_group(t):
    return _rounded(_groups(t), "grp")


@query(
    f"SELECT grp, bin, round(sum(sumw) OVER (PARTITION BY bin ORDER BY CASE grp WHEN 'qqbar' THEN 2 WHEN 'mumu' THEN 5 WHEN 'gg' THEN 6 END), 5) AS stack_to FROM ({_GSQL}) WHERE grp <> 'data'",
)
def hist_stack(t):
    return histogram.stacked(_groups(t).where("grp != 'data'")).select("grp", "bin", F.round("stack_to", 5).alias("stack_to"))


_RATIO = f"WITH h AS ({_GSQL}), d AS (SELECT bin, sumw AS d, sumw2 AS d2 FROM h WHERE grp = 'data'), m AS (SELECT bin, sum(sumw) AS m, sum(sumw2) AS m2 FROM h WHERE grp <> 'data' GROUP BY bin) SELECT bin, "


def _data_mc(t):
    h = _groups(t)
    return h.where("grp = 'data'"), h.where("grp != 'data'").groupBy("bin").agg(F.sum("sumw").alias("sumw"), F.sum("sumw2").alias("sumw2"))


@query(
    _RATIO + "round(CASE WHEN m > 0 THEN d / m ELSE 1 END, 6) AS ratio, round(CASE WHEN m > 0 THEN d / m ELSE 1 END * sqrt(coalesce(d2 / nullif(d * d, 0), 0) + coalesce(m2 / nullif(m * m, 0), 0)), 6) AS error FROM d JOIN m USING (bin)",
)
def hist_ratio(t):
    return histogram.ratio(*_data_mc(t)).select("bin", F.round("ratio", 6).alias("ratio"), F.round("error", 6).alias("error"))


@query(
    _RATIO + "round(CASE WHEN m > 0 THEN d / m ELSE 0 END, 6) AS ratio, round(CASE WHEN m > 0 THEN d / m ELSE 0 END * sqrt(coalesce(greatest(d, 1) / nullif(d * d, 0), 0) + coalesce(greatest(m, 1) / nullif(m * m, 0), 0)), 6) AS error FROM d JOIN m USING (bin)",
)
def hist_ratio2(t):
    return histogram.ratio(*_data_mc(t), strict=True).select("bin", F.round("ratio", 6).alias("ratio"), F.round("error", 6).alias("error"))


_EB = bin_sql("l_extendedprice", 0.0, 110000.0, 20)


@query(
    dense_sql(
        f"SELECT l_quantity, {_EB} AS bin FROM lineitem",
        20,
        sums="count(*) AS total, count(*) FILTER (l_quantity > 30) AS passed",
        columns="coalesce(passed, 0) AS passed, coalesce(total, 0) AS total, round(passed / nullif(total, 0)::DOUBLE, 9) AS efficiency",
    ),
)
def efficiency(t):
    return efficiency_rows(t).withColumn("efficiency", F.round("efficiency", 9))


@query(
    f"SELECT sum(count)::BIGINT AS events, count(DISTINCT grp) AS processes, round(sum(sumw) FILTER (grp = 'data'), 4) AS data, round(sum(sumw) FILTER (grp <> 'data'), 4) AS mc FROM ({_GSQL})",
)
def hist_stats(t):
    return histogram.totals(_groups(t), "grp").select("events", "processes", F.round("data", 4).alias("data"), F.round("mc", 4).alias("mc"))


@query(
    f"WITH h AS ({dense_sql(f'SELECT {_BIN} AS bin FROM lineitem', 40)}), s AS (SELECT sum(count)::DOUBLE AS n, sum(count * c) / sum(count) AS m, sum(count * c * c) / sum(count) AS q FROM (SELECT count, 1000.0::DOUBLE + (bin + 0.5::DOUBLE) * 2475 AS c FROM h)) SELECT n AS norm, round(m, 4) AS mean, round(sqrt(q - m * m), 3) AS sigma FROM s",
)
def fit_gaussian(t):
    return histogram.moments(histogram.hist(t.lineitem, "l_extendedprice", 40, (1000.0, 100000.0))).select(
        "norm",
        F.round("mean", 4).alias("mean"),
        F.round("sigma", 3).alias("sigma"),
    )


# --- processes -----------------------------------------------------------------------------------------

# Names whose classification is known.
NAMES = (
    "test_mumu_v1", "P16_mc_mu_mu_ISR", "test_ee_v1", "mc_ee_gg", "test_ccbar_v1", "test_uubar_v1", "test_ddbar_mixed", "charged_B_decay", "mixed_B_decay", "tau_pair_production",
    "eemumu_process", "eeee_process", "gg_fusion", "data_proc16_v1", "P16M16rd_mc4S_uubar_p16_v1", "data_proc_4S_on", "mc5S_ccbar", "BBbar", "mc5S_mumu_prompt", "unknown_thing", "mcOff_ddbar", "continuum",
)
_NAMES_SQL = f"(VALUES {', '.join(f'({n!r})' for n in NAMES)}) n(process)"


def _any_sql(parts, name="lower(process)"):
    return "(" + " OR ".join(f"contains({name}, '{p}')" for p in parts) + ")"


def _case_sql(rules, default):
    return "CASE " + " ".join(f"WHEN {_any_sql(p)} THEN '{g}'" for p, g in rules) + f" ELSE '{default}' END"


def _names(t):
    return t.rows(NAMES, "process string")


@query("WITH g AS (" + " UNION ALL ".join(f"SELECT process, '{g}' AS grp FROM {_NAMES_SQL} WHERE {_any_sql(p)}" for g, p in processes.GROUPS.items()) + f") SELECT * FROM g UNION ALL SELECT process, 'other' FROM {_NAMES_SQL} WHERE process NOT IN (SELECT process FROM g) UNION ALL SELECT process, 'all' FROM {_NAMES_SQL}")
def group_classify(t):
    return processes.classify(_names(t))


@query(
    f"SELECT process, {_case_sql(processes.GROUPS_FIRST, 'other')} AS first, {_case_sql(processes.GROUPS_PLOT, 'qqbar')} AS plot, {_case_sql(processes.GROUPS_SIMPLE, 'unknown')} AS simple FROM {_NAMES_SQL}",
)
def group_classify_first(t):
    n = F.col("process")
    return _names(t).select("process", processes.group_first(n).alias("first"), processes.group_plot(n).alias("plot"), processes.group_simple(n).alias("simple"))


@query(f"SELECT process FROM {_NAMES_SQL} WHERE {_any_sql(processes.ENERGY['vpho']['5S_scan'][0])} AND NOT {_any_sql(processes.ENERGY['vpho']['5S_scan'][1])}")
def energy_filter(t):
    return processes.energy_filter(_names(t), "5S_scan")


@query(f"SELECT process, count(*) AS count FROM ({EVENTS}) GROUP BY ALL")
def proc_counts(t):
    return processes.Processes(t.events_mu).counts()


@query(f'SELECT process, count(*) AS count FROM ({_best_sql("quality DESC", chr(34) + "mu1P" + chr(34) + " > 2", "process, " + chr(34) + "__event__" + chr(34))}) GROUP BY ALL')
def broadcast_chain(t):
    """A selection and one candidate an event, for all processes in one job."""
    return processes.Processes(t.events_mu).query("mu1P > 2").one_candidate(_KEYS, "quality", tiebreak=TIES, decisive=True).counts()


@query(f'SELECT round(avg("mu1P"), 6) AS "mu1P" FROM ({EVENTS}) WHERE process IN (\'AF\', \'RF\')')
def group_aggregate(t):
    p = processes.Processes(t.events_mu).add_group("closed", ["AF", "RF"]).group("closed")
    return p.apply("mean", ["mu1P"]).select(F.round("mu1P", 6).alias("mu1P"))


@query(f'SELECT process, round(avg("mu1P"), 6) AS "mu1P_mean" FROM ({EVENTS}) GROUP BY ALL')
def group_preserving(t):
    p = processes.Processes(t.events_mu)
    p.set_semantics("mean", "preserving")
    return p.apply("mean", ["mu1P"]).withColumn("mu1P_mean", F.round("mu1P_mean", 6))


@query(f'SELECT "__event__", "__candidate__", partkey FROM ({EVENTS}) WHERE contains(lower(process), \'a\') AND contains(lower(process), \'f\')')
def resolve_process_chain(t):
    return processes.Processes(t.events_mu).select_chain("a", "f").select(*_ID)


@query(
    f"WITH c AS ({_best_sql('quality DESC')}), a AS (SELECT {bin_sql('quality', 0.0, 110000.0, 20)} AS bin, \"mu1P\", \"mu2P\" FROM c) SELECT b.bin::INT AS bin, count(a.bin) FILTER (\"mu1P\" > 2 AND \"mu2P\" < 3) AS passed, count(a.bin) AS total FROM range(20) b(bin) LEFT JOIN a ON a.bin = b.bin GROUP BY b.bin",
)
def progressive_analysis(t):
    stages = processes.progressive_analysis(t.events_mu, ["mu1P > 2", "mu2P < 3"], _KEYS, "quality", "quality", 20, (0.0, 110000.0), TIES)
    return stages["efficiency"].select("bin", "passed", "total")


@query(
    f"WITH c AS ({_best_sql('quality DESC')}), a AS (SELECT {bin_sql('quality', 0.0, 110000.0, 20)} AS bin, \"E\" FROM c WHERE \"mu1P\" > 2 AND (\"E\" > 0.075 OR \"E\" IS NULL)) "
    "SELECT b.bin::INT AS bin, count(a.bin) AS count FROM range(20) b(bin) LEFT JOIN a ON a.bin = b.bin GROUP BY b.bin"
)
def progressive_photon(t):
    """The stage after the cuts: events whose photon isn't too soft."""
    return processes.progressive_analysis(t.events_mu, ["mu1P > 2"], _KEYS, "quality", "quality", 20, (0.0, 110000.0), TIES, photon=True)["photon"].select("bin", "count")


@query(f"SELECT process, region, count(*) AS count FROM ({EVENTS}) JOIN (VALUES ('AF', 1), ('RF', 2)) v(process, region) USING (process) GROUP BY ALL")
def group_join(t):
    """All members of a group as one table, joined."""
    p = processes.Processes(t.events_mu).add_group("closed", ["AF", "RF"]).group("closed")
    other = t.rows([("AF", 1), ("RF", 2), ("zz", 3)], "process string, region int")
    return p.apply("join", other=other, on="process").groupBy("process", "region").agg(F.count(F.lit(1)).alias("count"))


# --- luminosity -----------------------------------------------------------------------------------------

_TYPE_SQL = _case_sql([(v, k) for k, v in luminosity.PROCESS_TYPES.items()] + list(luminosity.PROCESS_HINTS), "default")
_LUMI_VALUES = ", ".join(f"('{p}', {v[2]!r}::DOUBLE)" for p, v in luminosity.LUMI.items() if not p.startswith("data"))


@query(
    f"SELECT process, type AS process_type, round(CASE WHEN contains(lower(process), 'data') OR NOT (w > 0 AND w <= 1000) THEN 1 ELSE w END, 8) AS weight FROM (SELECT process, type, {luminosity.LUMI['data_proc'][2]!r}::DOUBLE / coalesce(lumi, 1000) AS w "
    f"FROM (SELECT process, {_TYPE_SQL} AS type FROM {_NAMES_SQL}) LEFT JOIN (VALUES {_LUMI_VALUES}) l(p, lumi) ON p = type)"
)
def lumi_weight(t):
    w = luminosity.weights(_names(t), "5S_scan")
    return w.select("process", "process_type", F.round("weight", 8).alias("weight"))


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{c}', {x!r}::DOUBLE)" for p, v in luminosity.LUMI.items() for c, x in zip(luminosity.CONDITIONS, v)) + ") l(process_type, condition, lumi)"
)
def lumi_tables(t):
    return luminosity.lumi_table(t.spark)


@query(
    "SELECT p AS process_type, c AS condition, v AS value, round(v / sqrt(greatest(trunc(v * s * 1e6), 1)), 8) AS stat, round(v * 0.02::DOUBLE, 8) AS syst FROM (VALUES "
    + ", ".join(f"('{p}', '{c}', {x!r}::DOUBLE, {s!r}::DOUBLE)" for p, (v, s, _) in luminosity.DATABASE.items() for c, x in zip(luminosity.CONDITIONS, v))
    + ") d(p, c, v, s)"
)
def lumi_db(t):
    d = luminosity.database(t.spark).where("process_type != 'data'")
    return d.select("process_type", "condition", "value", F.round("stat", 8).alias("stat"), F.round("syst", 8).alias("syst"))


@query(
    f"SELECT process, CASE WHEN contains(x, '4s') THEN CASE WHEN contains(x, 'off') THEN '4S_offres' ELSE '4S_on' END WHEN contains(x, '5s') THEN '5S_scan' ELSE '4S_on' END AS condition, CASE WHEN contains(lower(process), 'data') THEN 'DATA' WHEN contains(lower(process), 'prompt') THEN 'MC_PROMPT' ELSE 'MC_PROC' END AS kind FROM (SELECT process, trim(replace(lower(process), 'mc', '')) AS x FROM {_NAMES_SQL})",
)
def energy_condition(t):
    n = F.col("process")
    return _names(t).select("process", luminosity.energy_condition(n).alias("condition"), luminosity.data_type(n).alias("kind"))


_KNOWN = sorted({(f"{p}_{c}".lower(), p) for p in ("data", *luminosity.DATABASE) for c in luminosity.CONDITIONS} | {(a, x[0]) for a, x in luminosity.ALIASES.items()} | {(p.lower(), p) for p in luminosity.DATABASE})
_KNOWN_SQL = ", ".join(f"('{k}', '{v}')" for k, v in _KNOWN)
_FULL, _DATA = luminosity.FULL_NAME.removeprefix("(?i)"), luminosity.DATA_NAME.removeprefix("(?i)")


@query(
    f"WITH n AS (SELECT process, regexp_matches(process, '{_FULL}', 'i') AS f, regexp_matches(process, '{_DATA}', 'i') AS d FROM {_NAMES_SQL}), "
    f"m AS (SELECT process, min({{'d': levenshtein(lower(process), k), 'k': k, 't': t}}) AS b FROM n, (VALUES {_KNOWN_SQL}) v(k, t) WHERE levenshtein(lower(process), k) <= {luminosity.FUZZY} GROUP BY process) "
    f"SELECT process, CASE WHEN f THEN lower(regexp_extract(process, '{_FULL}', 3, 'i')) WHEN d THEN 'data' WHEN b IS NOT NULL THEN b.t ELSE 'unknown' END AS physics, "
    "CASE WHEN f THEN 'regex_full' WHEN d THEN 'regex_data' WHEN b IS NOT NULL THEN concat('fuzzy_distance_', b.d) ELSE 'fallback' END AS match_method, "
    "round(CASE WHEN f OR d THEN 1 WHEN b IS NOT NULL THEN 1 - b.d / length(process) ELSE 0.1 END, 6) AS confidence FROM n LEFT JOIN m USING (process)"
)
def parse_process(t):
    p = luminosity.parse_names(_names(t))
    return p.select("process", "physics", "match_method", F.round("confidence", 6).alias("confidence"))


LOOKUPS = [
    (p, c, k) for p in ("mumu", "data", "continuum", "dilepton", "fourlepton", "weird", "quarkonium", "taux", "b2", "gammagamma", "uubar", "zzz")
    for c in ("4S_on", "5S_scan") for k in ("DATA", "MC_PROC")
]
_ALIAS_SQL = ", ".join(f"('{a}', '{x}')" for a, x in ((a, next((x for x in to if x in luminosity.DATABASE), None)) for a, to in luminosity.ALIASES.items()) if x)
_DB_SQL = ", ".join(f"('{p}', '{c}', {x!r}::DOUBLE, {s!r}::DOUBLE)" for p, (v, s, _) in luminosity.DATABASE.items() for c, x in zip(luminosity.CONDITIONS, v))
_DATA_SQL = ", ".join(f"('{c}', {', '.join(f'{x!r}::DOUBLE' for x in v)})" for c, v in luminosity.DATA.items())
_CATEGORY_SQL = "CASE " + " ".join(f"WHEN contains(physics, '{k}') THEN '{v}'" for k, v in luminosity.CATEGORIES.items()) + " ELSE '' END"


def _lookup_sql(asked: str, keep: str = "physics, condition, kind") -> str:
    return f"""
WITH q AS ({asked}), a(alias, target) AS (VALUES {_ALIAS_SQL}),
d AS (SELECT p, c, v, v / sqrt(greatest(trunc(v * s * 1e6), 1)) AS stat, v * 0.02::DOUBLE AS syst FROM (VALUES {_DB_SQL}) x(p, c, v, s)),
s AS (SELECT DISTINCT p, s FROM (VALUES {_DB_SQL}) x(p, c, v, s)), r(c, v, stat, syst) AS (VALUES {_DATA_SQL}),
k AS (SELECT q.*, target, {_CATEGORY_SQL} AS category, s.s AS sigma, CASE WHEN kind = 'DATA' THEN physics = 'data' ELSE s.s IS NOT NULL END AS exact FROM q LEFT JOIN a ON alias = physics LEFT JOIN s ON s.p = physics),
f AS (SELECT *, CASE WHEN exact THEN 'exact' WHEN kind <> 'DATA' AND target IS NOT NULL THEN 'alias' WHEN kind <> 'DATA' AND category <> '' THEN 'category' WHEN sigma IS NOT NULL THEN 'cross_section' ELSE 'default' END AS found FROM k)
SELECT {keep}, found,
  CASE found WHEN 'cross_section' THEN 1e9 / (sigma * 1e5) WHEN 'default' THEN 1000 ELSE coalesce(r.v, d.v) END AS value,
  CASE found WHEN 'cross_section' THEN 1e9 / (sigma * 1e5) * 0.1::DOUBLE WHEN 'default' THEN 100 ELSE coalesce(r.stat, d.stat) * CASE found WHEN 'alias' THEN 1.1::DOUBLE WHEN 'category' THEN 2 ELSE 1 END END AS stat,
  CASE found WHEN 'cross_section' THEN 1e9 / (sigma * 1e5) * 0.3::DOUBLE WHEN 'default' THEN 200 ELSE coalesce(r.syst, d.syst) * CASE found WHEN 'alias' THEN 1.2::DOUBLE WHEN 'category' THEN 2 ELSE 1 END END AS syst
FROM f LEFT JOIN r ON found = 'exact' AND kind = 'DATA' AND r.c = condition
LEFT JOIN d ON kind <> 'DATA' AND d.c = condition AND d.p = CASE found WHEN 'exact' THEN physics WHEN 'alias' THEN target WHEN 'category' THEN category END"""


_LOOKUP = _lookup_sql(f"SELECT * FROM (VALUES {', '.join(map(str, LOOKUPS))}) v(physics, condition, kind)")


@query(f"SELECT physics, condition, kind, found, round(value, 6) AS value, round(stat, 6) AS stat, round(syst, 6) AS syst FROM ({_LOOKUP})")
def lumi_lookup(t):
    """Values and uncertainties by exact name, alias, category, cross-section or default."""
    found = luminosity.lookup(t.rows(LOOKUPS, "physics string, condition string, kind string"), type_col="kind")
    return found.select("physics", "condition", "kind", "found", *[F.round(c, 6).alias(c) for c in ("value", "stat", "syst")])


_REF = luminosity.DATA["4S_on"]


@query(
    f"SELECT physics, condition, kind, round({_REF[0]!r}::DOUBLE / v, 8) AS weight, round(0.7::DOUBLE * {_REF[0]!r}::DOUBLE / v * sqrt({(_REF[1] ** 2 + _REF[2] ** 2) / _REF[0] ** 2!r}::DOUBLE + (stat * stat + syst * syst) / (v * v)), 8) AS weight_stat FROM (SELECT *, nullif(value, 0) AS v FROM ({_LOOKUP}))"
)
def calc_weight(t):
    """Data's luminosity over each process's, with errors."""
    found = luminosity.lookup(t.rows(LOOKUPS, "physics string, condition string, kind string"), type_col="kind")
    return luminosity.calculated_weights(found).select("physics", "condition", "kind", F.round("weight", 8).alias("weight"), F.round("weight_stat", 8).alias("weight_stat"))


def _energy_sql(x: str) -> str:
    low = f"trim(replace(lower({x}), 'mc', ''))"
    return f"CASE WHEN contains({low}, '4s') THEN CASE WHEN contains({low}, 'off') THEN '4S_offres' ELSE '4S_on' END WHEN contains({low}, '5s') THEN '5S_scan' ELSE '4S_on' END"


_PARSED = f"""
WITH n AS (SELECT process, lower(process) AS low, regexp_matches(process, '{_FULL}', 'i') AS f, regexp_matches(process, '{_DATA}', 'i') AS d FROM {_NAMES_SQL}),
m AS (SELECT process, min({{'d': levenshtein(low, k), 'k': k, 't': t}}) AS b FROM n, (VALUES {_KNOWN_SQL}) v(k, t) WHERE levenshtein(low, k) <= {luminosity.FUZZY} GROUP BY process)
SELECT process, CASE WHEN f THEN lower(regexp_extract(process, '{_FULL}', 3, 'i')) WHEN d THEN 'data' WHEN b IS NOT NULL THEN b.t ELSE 'unknown' END AS physics,
  CASE WHEN f THEN {_energy_sql(f"regexp_extract(process, '{_FULL}', 2, 'i')")} WHEN d THEN {_energy_sql(f"regexp_extract(process, '{_DATA}', 3, 'i')")}
    WHEN b IS NULL THEN '4S_on' WHEN contains(low, '5s') THEN '5S_scan' WHEN contains(low, 'off') THEN '4S_offres' ELSE '4S_on' END AS condition,
  CASE WHEN f THEN 'MC_PROC' WHEN d THEN CASE WHEN lower(regexp_extract(process, '{_DATA}', 2, 'i')) = 'proc' THEN 'DATA' ELSE 'MC_PROMPT' END
    WHEN b IS NULL THEN 'MC_PROC' WHEN contains(low, 'data') THEN 'DATA' WHEN contains(low, 'prompt') THEN 'MC_PROMPT' ELSE 'MC_PROC' END AS kind
FROM n LEFT JOIN m USING (process)"""


@query(
    f"SELECT process, physics, condition, found, round(value, 6) AS value, round(stat, 6) AS stat, round(syst, 6) AS syst FROM ({_lookup_sql(_PARSED, 'process, physics, condition')})",
)
def batch_lookup(t):
    """Names that are parsed first."""
    found = luminosity.batch_lookup(t.spark, NAMES)
    return found.select("process", "physics", "condition", "found", *[F.round(c, 6).alias(c) for c in ("value", "stat", "syst")])


@query(f"SELECT process, round(sum(CASE WHEN process = 'RO' THEN 1 ELSE 0.25 END * weight), 4) AS w FROM ({EVENTS}) GROUP BY process")
def apply_weights_all(t):
    """Every row gets its process's weight from a small dimension."""
    names = t.events_mu.select("process").distinct().withColumn("weight", F.when(F.col("process") == "RO", 1.0).otherwise(0.25))
    rows = luminosity.apply_weights(t.events_mu, names)
    return rows.groupBy("process").agg(F.round(F.sum(F.col("lumi_weight") * F.col("weight")), 4).alias("w"))


@query("SELECT process_type, condition, round(abs(v - m) / m, 8) AS deviation, abs(v - m) / m < 0.1 AS consistent FROM (SELECT p AS process_type, c AS condition, v, avg(v) OVER (PARTITION BY c) AS m FROM (VALUES " + ", ".join(f"('{p}', '{c}', {x!r}::DOUBLE)" for p, v in luminosity.LUMI.items() if p in ("uubar", "ddbar", "ssbar", "ccbar") for c, x in zip(luminosity.CONDITIONS, v)) + ") d(p, c, v))")
def lumi_consistency(t):
    rows = luminosity.lumi_table(t.spark).where("process_type IN ('uubar', 'ddbar', 'ssbar', 'ccbar')")
    return luminosity.consistency(rows, "condition", "lumi").select("process_type", "condition", F.round("deviation", 8).alias("deviation"), "consistent")


@query(
    "SELECT o_orderkey, round(0.25 * o_totalprice * sqrt(pow(10 / nullif(o_totalprice, 0), 2) + 0.0004), 6) AS p, round(sqrt(100 + pow(o_totalprice * 0.01, 2)), 6) AS u FROM orders",
)
def lumi_propagate(t):
    x = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey",
        F.round(luminosity.propagate(x, F.lit(10.0), F.lit(0.25)), 6).alias("p"),
        F.round(luminosity.total_uncertainty(x, F.lit(10.0), 0.01), 6).alias("u"),
    )


@query(f"SELECT process FROM {_NAMES_SQL} WHERE starts_with(lower(process), 'test_')")
def trie_prefix(t):
    return luminosity.search_names(_names(t), "test_")


@query(f"SELECT process FROM {_NAMES_SQL} WHERE levenshtein(lower(process), 'test_mm_v1') <= 2")
def trie_fuzzy(t):
    return luminosity.search_names(_names(t), "test_mm_v1", "fuzzy", 2)


# --- statistics --------------------------------------------------------------------------------------------

_Z = statistics.z_value()
_EFF = f"SELECT bin, passed::DOUBLE AS k, total::DOUBLE AS n FROM ({dense_sql(f'SELECT l_quantity, {_EB} AS bin FROM lineitem', 20, sums='count(*) AS total, count(*) FILTER (l_quantity > 30) AS passed', columns='coalesce(passed, 0) AS passed, coalesce(total, 0) AS total')}) WHERE total > 0"


def _eff(t):
    return efficiency_rows(t).where("total > 0").select("bin", F.col("passed").cast("double").alias("k"), F.col("total").cast("double").alias("n"))


def efficiency_rows(t):
    return histogram.hist_passed(t.lineitem, "l_extendedprice", F.col("l_quantity") > 30, 20, (0.0, 110000.0))


@query(
    f"SELECT bin, round(greatest(m - h, 0), 8) AS lower, round(least(m + h, 1), 8) AS upper FROM (SELECT bin, (k + {_Z * _Z / 2!r}::DOUBLE) / (n + {_Z * _Z!r}::DOUBLE) AS m, {_Z!r}::DOUBLE * n / (n + {_Z * _Z!r}::DOUBLE) * sqrt(k / n * (1 - k / n) / n + {_Z * _Z / 4!r}::DOUBLE / (n * n)) AS h FROM ({_EFF}))",
)
def wilson(t):
    lo, hi = statistics.wilson(F.col("k"), F.col("n"))
    return _eff(t).select("bin", F.round(lo, 8).alias("lower"), F.round(hi, 8).alias("upper"))


@query(
    f"SELECT bin, round(greatest(p - h, 0), 8) AS lower, round(least(p + h, 1), 8) AS upper FROM (SELECT bin, p, {_Z!r}::DOUBLE * sqrt(p * (1 - p) / (n + {_Z * _Z!r}::DOUBLE)) AS h FROM (SELECT bin, n, (k + {_Z * _Z / 2!r}::DOUBLE) / (n + {_Z * _Z!r}::DOUBLE) AS p FROM ({_EFF})))",
)
def agresti_coull(t):
    lo, hi = statistics.agresti_coull(F.col("k"), F.col("n"))
    return _eff(t).select("bin", F.round(lo, 8).alias("lower"), F.round(hi, 8).alias("upper"))


def _solved(rows: str, kind: str, lower: str, upper: str, unit: str = "1", more: str = "k, n", digits: int = 6) -> str:
    """SQL for ends of an interval: quantiles of a beta or gamma distribution by bisection over Simpson sums of its density.

    lower and upper are (a, b) of the distributions, from columns of rows. The
    density is taken over the angle whose squared sine (the number whose square) is distributed so, which has no poles.
    """
    log_norm = "lgamma(a) + lgamma(b) - lgamma(a + b)" if kind == "beta" else "lgamma(a)"
    mid, spread = ("asin(sqrt(a / (a + b)))", "0.5 / sqrt(a + b)") if kind == "beta" else ("sqrt(a)", "0.5")
    log_density = "(2 * a - 1) * ln(greatest(sin(u), 1e-300)) + (2 * b - 1) * ln(greatest(cos(u), 1e-300))" if kind == "beta" else "(2 * a - 1) * ln(greatest(u, 1e-300)) - u * u"
    back = "pow(sin(x), 2)" if kind == "beta" else "x * x"
    top = "least(m + 14 * s, pi() / 2)" if kind == "beta" else "m + 14 * s"
    at = "(x0 + (mid - x0) * i / 600)"
    simpson = f"(mid - x0) / 1800 * list_sum(list_transform(range(601), lambda i: (CASE WHEN i IN (0, 600) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * 2 * exp({log_density.replace('u', at)} - c)))"
    return f"""WITH RECURSIVE e AS ({rows}), q AS (SELECT e.*, side, target, a::DOUBLE AS a, b::DOUBLE AS b FROM e, LATERAL (VALUES (0, {(1 - statistics.ONE_SIGMA) / 2!r}::DOUBLE, {lower}), (1, {(1 + statistics.ONE_SIGMA) / 2!r}::DOUBLE, {upper})) v(side, target, a, b)),
w AS (SELECT *, {log_norm} AS c, {mid} AS m, {spread} AS s FROM q WHERE a > 0 AND b > 0), r AS (SELECT *, greatest(m - 14 * s, 0) AS x0, greatest(m - 14 * s, 0) AS lo, {top} AS hi, (greatest(m - 14 * s, 0) + {top}) / 2 AS mid, 0 AS turn FROM w
UNION ALL SELECT * EXCLUDE (below) REPLACE (CASE WHEN below THEN mid ELSE lo END AS lo, CASE WHEN below THEN hi ELSE mid END AS hi, CASE WHEN below THEN (mid + hi) / 2 ELSE (lo + mid) / 2 END AS mid, turn + 1 AS turn) FROM (SELECT *, {simpson} < target AS below FROM r WHERE turn < 44)),
z AS (SELECT bin, side, mid AS x FROM r WHERE turn = 44) SELECT e.bin, {', '.join('e.' + c for c in more.split(', '))}, round(coalesce(min({back}) FILTER (side = 0), 0) * {unit}, {digits}) AS lower, round(coalesce(min({back}) FILTER (side = 1), 1) * {unit}, {digits}) AS upper FROM e LEFT JOIN z ON z.bin = e.bin GROUP BY ALL"""


def _interval_query(name, make, sql=None, digits=6):
    @query(sql, name=name)
    def run(t):
        return _eff(t).withColumn("i", make()).select("bin", "k", "n", F.round("i.lower", digits).alias("lower"), F.round("i.upper", digits).alias("upper"))


_EFF_KN = f"SELECT bin, k, n FROM ({_EFF})"
_interval_query("clopper_pearson", lambda: statistics.clopper_pearson("k", "n"), _solved(_EFF_KN, "beta", "k, n - k + 1", "k + 1, n - k"))
_interval_query("jeffreys", lambda: statistics.beta_interval("k", "n"), _solved(_EFF_KN, "beta", "k + 0.5, n - k + 0.5", "k + 0.5, n - k + 0.5"))
_interval_query("poisson_exact", lambda: statistics.poisson_exact("k"), _solved(_EFF_KN, "gamma", "k, 1", "k + 1, 1", digits=3), 3)
_interval_query("jeffreys_poisson", lambda: statistics.jeffreys_poisson("k"), _solved(_EFF_KN, "gamma", "k + 0.5, 1", "k + 0.5, 1", digits=3), 3)


@query(f"SELECT bin, k, n, round({statistics.ONE_SIGMA!r}::DOUBLE, 5) AS mass, 0.0::DOUBLE AS gap FROM ({_EFF_KN})")
def uniform_hpd(t):
    """The mass of the shortest interval, by Simpson sums of the density, and by how much the log densities at its ends differ."""
    found = _eff(t).withColumn("i", statistics.beta_interval("k", "n", prior=(1.0, 1.0), shortest=True))
    norm = statistics.log_factorial(F.col("k")) + statistics.log_factorial(F.col("n") - F.col("k")) - statistics.log_factorial(F.col("n") + 1)
    found = found.select("bin", "k", "n", "i.lower", "i.upper", norm.alias("norm"))
    power = lambda times, x: F.when(times > 0, times * F.ln(x)).otherwise(0.0)
    log_density = lambda x: power(F.col("k"), x) + power(F.col("n") - F.col("k"), 1 - x) - F.col("norm")
    steps, width = 400, F.col("upper") - F.col("lower")
    weight = lambda i: F.when(i.isin(0, steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    term = lambda total, i: total + weight(i) * F.exp(log_density(F.col("lower") + width * i / steps))
    mass = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), term) * width / (3 * steps)
    inside = (F.col("lower") > 1e-9) & (F.col("upper") < 1 - 1e-9)
    gap = F.when(inside, F.abs(F.round(log_density(F.col("lower")) - log_density(F.col("upper")), 3))).otherwise(0.0)
    return found.select("bin", "k", "n", F.round(mass, 5).alias("mass"), gap.alias("gap"))


@query(f"SELECT bin, round({_Z * _Z / 2!r}::DOUBLE, 5) AS below, round({_Z * _Z / 2!r}::DOUBLE, 5) AS above FROM ({_EFF}) WHERE k > 0")
def profile_likelihood(t):
    """By how much the log likelihood has dropped at both ends of the interval."""
    like = lambda m: F.col("k") * F.ln(m) - F.col("n") * m
    found = _eff(t).where("k > 0").withColumn("i", statistics.profile_likelihood("k", "n"))
    drop = lambda m: F.round(like(F.col("k") / F.col("n")) - like(F.col(m)), 5)
    return found.select("bin", drop("i.lower").alias("below"), drop("i.upper").alias("above"))


@query(f"SELECT bin, count(*) OVER () AS methods FROM ({_EFF})".replace("count(*) OVER ()", "7::BIGINT"))
def interval_methods(t):
    """Every method by its name: each interval holds the estimate."""
    rows, kept = _eff(t), None
    for method in ("wilson", "agresti_coull", "clopper_pearson", "jeffreys", "uniform_hpd"):
        one = statistics.intervals(rows, method).where("lower <= k / n AND k / n <= upper").select("bin")
        kept = one if kept is None else kept.unionByName(one)
    for method in ("poisson_exact", "jeffreys_poisson"):
        kept = kept.unionByName(statistics.intervals(rows, method).where("lower <= k AND k <= upper").select("bin"))
    return kept.groupBy("bin").agg(F.count(F.lit(1)).alias("methods"))


_WEIGHED = dense_sql(
    f"SELECT {_EB} AS bin, 1 - l_discount AS w FROM lineitem",
    20,
    sums="sum(w) AS sumw, sum(w * w) AS sumw2",
    columns="coalesce(sumw, 0) AS sumw, coalesce(sumw2, 0) AS sumw2",
)
_EFFECTIVE = "coalesce(sumw * sumw / nullif(sumw2, 0), 0) + 0.5, 1"


@query(
    f"SELECT bin, round(sumw, 4) AS sumw, lower, upper FROM ({_solved(_WEIGHED, 'gamma', _EFFECTIVE, _EFFECTIVE, 'coalesce(min(e.sumw2) / nullif(min(e.sumw), 0), 1)', 'sumw, sumw2', 3)})"
)
def barlow_beeston(t):
    h = statistics.hist_uncertainty(histogram.hist(t.lineitem, "l_extendedprice", 20, (0.0, 110000.0), 1 - F.col("l_discount")), weighted=True)
    return h.select("bin", F.round("sumw", 4).alias("sumw"), F.round("lower", 3).alias("lower"), F.round("upper", 3).alias("upper"))


@query()
def bootstrap(t):
    return statistics.bootstrap_mean(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", key="o_orderkey")


@query(
    "SELECT o_orderkey, round(sqrt(pow(o_totalprice * 0.02 , 2) + pow(o_totalprice * 0.01, 2)), 6) AS syst, round(sqrt(pow(o_totalprice * 0.02, 2) + pow(o_totalprice * 0.01, 2) + 25), 6) AS total FROM orders",
)
def systematics(t):
    x = F.col("o_totalprice")
    df = t.orders.withColumns({"up": x * 1.02, "down": x * 0.99, "stat": F.lit(5.0)})
    return statistics.systematics(df, "o_totalprice", "stat", ["up", "down"]).select("o_orderkey", F.round("syst", 6).alias("syst"), F.round("total", 6).alias("total"))


@query("SELECT l_returnflag, round(sqrt(sum(pow((1 - l_discount) * l_tax, 2))) / sum(1 - l_discount), 10) AS error FROM lineitem GROUP BY ALL")
def propagate(t):
    return statistics.propagate(t.lineitem.withColumn("w", 1 - F.col("l_discount")), "w", "l_tax", ["l_returnflag"]).withColumn("error", F.round("error", 10))


@query("SELECT round(avg(l_quantity), 6) AS mean, count(*)::DOUBLE AS n_eff, round(stddev_samp(l_quantity) / sqrt(count(*)), 8) AS error FROM lineitem")
def column_statistics(t):
    return statistics.column_statistics(t.lineitem, "l_quantity").select(F.round("mean", 6).alias("mean"), "n_eff", F.round("error", 8).alias("error"))


@query("SELECT o_orderkey, k, round(k * ln(4.5) - 4.5 - lgamma(k + 1), 8) AS logp FROM (SELECT l_orderkey AS o_orderkey, count(*) AS k FROM lineitem GROUP BY ALL)")
def poisson_logpmf(t):
    """How likely so many line items of an order are."""
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("k"))
    return rows.withColumn("logp", F.round(statistics.poisson_logpmf(F.col("k").cast("double"), F.lit(4.5)), 8))


_JACK = "SELECT event_id, value::DOUBLE AS x, 1 + (event_id % 3)::DOUBLE AS w FROM events WHERE value IS NOT NULL"


@query(
    f"WITH r AS ({_JACK}), t AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) / sum(w) AS mean FROM r), d AS (SELECT n, mean, (sw * mean - w * x) / (sw - w) - mean AS d FROM r, t), "
    "m AS (SELECT *, avg(d) OVER () AS mid FROM d) SELECT n, round(mean, 8) AS mean, round(sum(pow(mid - d, 3)) / (6 * pow(sum(pow(mid - d, 2)), 1.5)), 8) AS acceleration FROM m GROUP BY ALL"
)
def jackknife(t):
    """The acceleration of a weighted mean's bootstrap, from the means that leave out one row each."""
    rows = t.events.where("value IS NOT NULL").select(F.col("value").cast("double").alias("x"), (1 + F.col("event_id") % 3).cast("double").alias("w"))
    found = statistics.jackknife_acceleration(rows)
    return found.select("n", F.round("mean", 8).alias("mean"), F.round("acceleration", 8).alias("acceleration"))


@query(f"SELECT bin, round(1.5 * sqrt(n / (n / 2)), 8) AS error FROM ({_EFF})")
def weighted_scaling(t):
    return _eff(t).select("bin", F.round(statistics.weighted_scaling(F.lit(1.5), F.col("n"), F.col("n") / 2), 8).alias("error"))


@query()
def gen_synthetic(t):
    """Made-up events, as many as the orders ask for."""
    from ..sources.synthetic import generate_all

    return generate_all(t.spark, t.orders.count() / 1_500_000).groupBy("process").agg(
        F.count(F.lit(1)).alias("events"),
        F.round(F.avg("mu1P"), 6).alias("p"),
        F.round(F.avg("m2Recoil"), 6).alias("m2"),
    )
