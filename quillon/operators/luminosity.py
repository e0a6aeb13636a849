"""Luminosity weights: names of processes, tables, lookups and their uncertainties.

The tables are small by nature (a few dozen rows), so they are literals of the
plan, and every lookup is one broadcast join or CASE expression over the names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from math import sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import safe_div
from ..session import small
from .fuzzy import near as fuzzy_near

CONDITIONS = ("4S_on", "4S_offres", "5S_scan")

# Integrated luminosity (1/fb) by process, for 4S_on, 4S_offres, 5S_scan.
LUMI = {
    "data_proc": (357.30651809174, 41.64267813217, 19.63477002990),
    "data_prompt": (129.52826011600, 17.67914933099, 0.0),
    "uubar": (1368.4666, 158.4068, 78.5391),
    "ddbar": (1429.2255, 168.4762, 78.5391),
    "ssbar": (1429.2255, 168.4762, 78.5391),
    "ccbar": (1368.4666, 158.4068, 78.5391),
    "taupair": (1368.4666, 158.4068, 78.5391),
    "mumu": (1368.4666, 158.4068, 78.5391),
    "gg": (684.2325, 79.2034, 39.2695),
    "ee": (34.2116, 3.9602, 1.9635),
    "eeee": (341.6712, 38.7110, 19.6348),
    "eemumu": (342.1162, 38.7110, 19.6348),
    "llXX": (874.7212, 114.0483, 19.6348),
    "hhISR": (357.3065, 42.1190, 19.6348),
}
DEFAULT_DATA = 19.6348

# Name parts of process types, first match counts.
PROCESS_TYPES = {
    "mumu": ("mumu", "mu+mu-", "muon"), "ee": ("ee", "e+e-", "electron", "bhabha"), "taupair": ("taupair", "tau", "tautau"),
    "uubar": ("uubar", "uu"), "ddbar": ("ddbar", "dd"), "ssbar": ("ssbar", "ss"), "ccbar": ("ccbar", "cc"), "gg": ("gg", "gamma", "photon"),
    "hhISR": ("hhisr", "hh_isr", "hadron_isr", "hh"), "eeee": ("eeee", "4e"), "eemumu": ("eemumu", "2e2mu"), "llXX": ("llxx", "llyy", "four_lepton"),
    "charged": ("charged", "b+b-", "bplus"), "mixed": ("mixed", "b0b0bar", "bneutral"),
}
PROCESS_HINTS = (
    (("continuum", "cont"), "uubar"), (("quark", "qqbar", "hadron"), "ccbar"), (("lepton", "lep"), "mumu"),
    (("photon", "gamma"), "gg"), (("tau",), "taupair"), (("electron",), "ee"),
)

# Value (4S_on, 4S_offres, 5S_scan), cross section in nb, correction factor.
DATABASE = {
    "uubar": ((1368.47, 158.41, 78.54), 1.61, 1.0),
    "ddbar": ((1429.23, 168.48, 78.54), 0.40, 1.0),
    "ssbar": ((1429.23, 168.48, 78.54), 0.38, 1.0),
    "ccbar": ((1368.47, 158.41, 78.54), 1.30, 1.0),
    "mumu": ((1368.47, 158.41, 78.54), 1.148, 1.0),
    "ee": ((34.21, 3.96, 1.96), 40.0, 1.0),
    "taupair": ((1368.47, 158.41, 78.54), 0.919, 1.0),
    "gg": ((684.23, 79.20, 39.27), 2.0, 1.2),
    "BBbar": ((340.0, 0.0, 0.0), 1.05, 1.0),
}
# Value, statistical and systematic uncertainty of data.
DATA = {"4S_on": (357.3065, 0.036, 0.357), "4S_offres": (41.6427, 0.004, 0.042), "5S_scan": (19.6348, 0.002, 0.020)}
# Other names of processes, and what a part of a name stands for.
ALIASES = {
    "continuum": ("uubar", "ddbar", "ssbar", "ccbar"), "qqbar": ("uubar", "ddbar", "ssbar", "ccbar"), "dilepton": ("mumu", "ee", "taupair"), "ll": ("mumu", "ee"),
    "tautau": ("taupair",), "mu+mu-": ("mumu",), "e+e-": ("ee",), "twophoton": ("gg",), "gammagamma": ("gg",), "gamma_gamma": ("gg",),
    "bmeson": ("BBbar",), "b0b0bar": ("BBbar",), "bpbm": ("BBbar",), "fourlepton": ("llXX", "eeee", "eemumu", "mumumumu"), "llxx": ("llXX",), "isr": ("hhISR",), "hhisr": ("hhISR",),
}
CATEGORIES = {"b": "BBbar", "tau": "taupair", "mu": "mumu", "e": "ee", "quark": "uubar", "photon": "gg"}
# Formats of process names, and the greatest edit distance of a fuzzy match.
FULL_NAME = r"(?i)^(P\d+M\d+\w*)_(mc[45]S?)_(\w+)_(p\d+)_(v\d+)"
DATA_NAME = r"(?i)^(data)_(proc|prompt)_([45]S_\w+)"
FUZZY = 3


def contains_any(name: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [name.contains(p) for p in parts])


def first_match(name: Column, rules: Sequence[tuple[Sequence[str], str]], default: str) -> Column:
    """The label of the first rule of which the name has a part."""
    out = None
    for parts, label in rules:
        hit = contains_any(name, parts)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(F.lit(default))


def process_type(name: Column) -> Column:
    return first_match(F.lower(name), [(v, k) for k, v in PROCESS_TYPES.items()] + list(PROCESS_HINTS), "default")


def energy_condition(text: Column) -> Column:
    """4S_on, 4S_offres or 5S_scan, from a text."""
    t = F.trim(F.replace(F.lower(text), F.lit("mc"), F.lit("")))
    return F.when(t.contains("4s"), F.when(t.contains("off"), "4S_offres").otherwise("4S_on")).when(t.contains("5s"), "5S_scan").otherwise("4S_on")


def data_type(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n.contains("data"), "DATA").when(n.contains("prompt"), "MC_PROMPT").otherwise("MC_PROC")


def lumi_table(spark: SparkSession) -> DataFrame:
    """(process_type, condition, lumi)."""
    rows = [(p, c, v) for p, values in LUMI.items() for c, v in zip(CONDITIONS, values, strict=True)]
    return small(spark, rows, "process_type string, condition string, lumi double")


def database(spark: SparkSession) -> DataFrame:
    """(process_type, condition, value, stat, syst, cross_section, k_factor); statistics from the simulated events, 2 % systematic."""
    rows = [("data", c, *v, None, 1.0) for c, v in DATA.items()]
    for p, (values, sigma, k) in DATABASE.items():
        rows += [(p, c, v, v / sqrt(max(int(v * sigma * 1e6), 1)), v * 0.02, sigma, k) for c, v in zip(CONDITIONS, values, strict=True)]
    return small(spark, rows, "process_type string, condition string, value double, stat double, syst double, cross_section double, k_factor double")


def weights(names: DataFrame, condition: str, name_col: str = "process") -> DataFrame:
    """names with process_type, data_lumi, mc_lumi, weight and method.

    Data weigh 1. Simulation weighs data over simulated luminosity; a process
    without one gets 1000; weights not in (0, 1000] become 1.
    """
    at = CONDITIONS.index(condition)
    name = F.col(name_col)
    is_data = F.lower(name).contains("data")
    prompt = LUMI["data_prompt"][at] or LUMI["data_proc"][at]
    known = F.create_map(*[x for p, v in LUMI.items() if not p.startswith("data") for x in (F.lit(p), F.lit(v[at]))])
    rows = names.withColumns({"process_type": process_type(name), "data_lumi": F.when(name.contains("prompt"), F.lit(prompt)).otherwise(F.lit(LUMI["data_proc"][at]))})
    found = F.element_at(known, F.col("process_type"))
    rows = rows.withColumn("mc_lumi", F.when(found > 0, found).otherwise(F.lit(1000.0)))
    w = F.col("data_lumi") / F.col("mc_lumi")
    fine = (w > 0) & (w <= 1000)
    method = F.when(is_data, "data_unity").when(~fine, "sanity_fallback").when(
        F.coalesce(found, F.lit(0.0)) > 0,
        F.when(name.contains("prompt"), "prompt_calculation").otherwise("proc_calculation"),
    ).otherwise("cross_database_fallback")
    return rows.withColumns({"weight": F.when(is_data | ~fine, F.lit(1.0)).otherwise(w), "method": method})


def apply_weights(df: DataFrame, names: DataFrame, name_col: str = "process", weight_col: str = "lumi_weight") -> DataFrame:
    """Rows of all processes with their process's weight, from a small dimension that Spark broadcasts by its size."""
    dim = names.select(name_col, F.col("weight").alias(weight_col))
    return df.join(dim, name_col, "left")


def parse_names(names: DataFrame, name_col: str = "process") -> DataFrame:
    """names with campaign, condition, physics, version, data_type, confidence and match_method.

    The full format and the data format are read by pattern; other names take the
    known name within an edit distance of FUZZY, else `unknown`.
    """
    spark = names.sparkSession
    known = [(f"{p}_{c}".lower(), p) for p in ("data", *DATABASE) for c in CONDITIONS] + [(a, t[0]) for a, t in ALIASES.items()] + [(p.lower(), p) for p in DATABASE]
    table = small(spark, known, "known string, target string")
    name, low = F.col(name_col), F.lower(F.col(name_col))
    full, data = name.rlike(FULL_NAME), name.rlike(DATA_NAME)
    others = names.where(~(full | data)).select(low.alias("_low"))
    near = fuzzy_near(others, table, "_low", "known", FUZZY).join(table, "known")
    best = near.groupBy("_low").agg(F.min(F.struct(F.col("distance").alias("_d"), "known", "target")).alias("_m"))
    part = lambda pattern, k: F.regexp_extract(name, pattern, k)
    inferred = F.when(low.contains("5s"), "5S_scan").when(low.contains("off"), "4S_offres").otherwise("4S_on")
    rows = names.withColumn("_low", low).join(best, "_low", "left").drop("_low")
    fuzzy = F.col("_m").isNotNull()
    out = {
        "campaign": F.when(full, part(FULL_NAME, 1)),
        "condition": F.when(full, energy_condition(part(FULL_NAME, 2))).when(data, energy_condition(part(DATA_NAME, 3))).when(fuzzy, inferred).otherwise("4S_on"),
        "physics": F.when(full, F.lower(part(FULL_NAME, 3))).when(data, "data").when(fuzzy, F.col("_m.target")).otherwise("unknown"),
        "version": F.when(full, part(FULL_NAME, 5)),
        "data_type": F.when(full, "MC_PROC").when(
            data,
            F.when(F.lower(part(DATA_NAME, 2)) == "proc", "DATA").otherwise("MC_PROMPT"),
        ).when(fuzzy, data_type(name)).otherwise("MC_PROC"),
        "confidence": F.when(full | data, 1.0).when(fuzzy, 1.0 - F.col("_m._d") / F.length(name)).otherwise(0.1),
        "match_method": F.when(full, "regex_full").when(data, "regex_data").when(fuzzy, F.concat(F.lit("fuzzy_distance_"), F.col("_m._d").cast("string"))).otherwise("fallback"),
    }
    return rows.withColumns(out).drop("_m")


def lookup(rows: DataFrame, physics_col: str = "physics", condition_col: str = "condition", type_col: str | None = None) -> DataFrame:
    """rows with value, stat, syst and found: exact, alias, category, cross_section or default.

    Data and simulation have a database each, chosen by type_col (DATA or another);
    without it only the process `data` is data. A process that its database lacks
    but whose cross-section is known gets an estimate for 1e9 events at an efficiency of 10 %,
    with 10 % and 30 % of it as errors.
    """
    db = database(rows.sparkSession)
    alias = {a: next((t for t in targets if t in DATABASE), None) for a, targets in ALIASES.items()}
    alias_of = F.create_map(*[F.lit(x) for a, t in alias.items() if t for x in (a, t)])
    sigma_of = F.create_map(*[F.lit(x) for p, (_, sigma, _) in DATABASE.items() for x in (p, sigma)])
    p = F.col(physics_col)
    data = F.col(type_col) == "DATA" if type_col else p == "data"
    category = first_match(p, [((k,), v) for k, v in CATEGORIES.items()], "")
    exact = F.when(data, p == "data").otherwise(p.isin(*DATABASE))
    how = F.when(exact, "exact").when(~data & F.element_at(alias_of, p).isNotNull(), "alias").when(~data & (category != ""), "category")
    how = how.when(F.element_at(sigma_of, p).isNotNull(), "cross_section").otherwise("default")
    key = F.when(exact, p).when(F.col("found") == "alias", F.element_at(alias_of, p)).when(F.col("found") == "category", category)
    known = db.select(F.col("process_type").alias("_p"), F.col("condition").alias("_c"), "value", "stat", "syst")
    joined = rows.withColumn("found", how).withColumn("_key", key).join(known, (F.col("_key") == F.col("_p")) & (F.col(condition_col) == F.col("_c")), "left")
    wider = lambda a, c: F.when(F.col("found") == "alias", a).when(F.col("found") == "category", c).otherwise(1.0)
    guess = F.when(F.col("found") == "cross_section", 1e9 / (F.element_at(sigma_of, p) * 1e6 * 0.1))
    stat = F.coalesce(F.col("stat") * wider(1.1, 2.0), guess * 0.1, F.lit(100.0))
    syst = F.coalesce(F.col("syst") * wider(1.2, 2.0), guess * 0.3, F.lit(200.0))
    return joined.withColumns({"stat": stat, "syst": syst, "value": F.coalesce("value", guess, F.lit(1000.0))}).drop("_key", "_p", "_c")


def calculated_weights(rows: DataFrame, against: Value | float | None = None, condition: str = "4S_on") -> DataFrame:
    """Rows of `lookup` with weight (reference over own luminosity) and its errors weight_stat and weight_syst.

    The reference is a number, a value with errors, or that of data at `condition`.
    """
    ref = Value(*DATA[condition]) if against is None else against if isinstance(against, Value) else Value(float(against))
    w = safe_div(F.lit(ref.value), F.col("value"))
    own = F.sqrt(F.col("stat") * F.col("stat") + F.col("syst") * F.col("syst"))
    error = F.abs(w) * F.sqrt(F.lit((ref.total / ref.value) ** 2 if ref.value else 0.0) + F.pow(safe_div(own, F.col("value")), 2))
    return rows.withColumns({"weight": w, "weight_stat": error * 0.7, "weight_syst": error * 0.7})


@dataclass(frozen=True)
class Value:
    """A luminosity with statistical and systematic uncertainty."""

    value: float
    stat: float = 0.0
    syst: float = 0.0

    @property
    def total(self) -> float:
        return sqrt(self.stat**2 + self.syst**2)

    def __mul__(self, k: float) -> Value:
        return replace(self, value=self.value * k, stat=self.stat * abs(k), syst=self.syst * abs(k))

    def __truediv__(self, other: Value) -> Value:
        """A ratio: relative errors in quadrature, shared evenly between the two kinds."""
        if other.value == 0:
            raise ZeroDivisionError("division by a luminosity of zero")
        r = self.value / other.value
        own = self.total / self.value if self.value else 0.0
        error = abs(r) * sqrt(own**2 + (other.total / other.value) ** 2)
        return Value(r, 0.7 * error, 0.7 * error)


def reference(names: Sequence[str], wanted: str | None = None) -> str:
    """The process that others are weighed against."""
    if wanted in names:
        return wanted
    return next((n for n in names if "data" in n.lower()), "data_proc_4S_on")


def propagate(value: Column, error: Column, weight: Column, share: float = 0.02) -> Column:
    """Error of a weighted value whose weight is known to a share."""
    return weight * value * F.sqrt(F.pow(F.coalesce(safe_div(error, value), F.lit(0.0)), 2) + share**2)


def consistency(rows: DataFrame, key: str = "process_type", value: str = "value", most: float = 0.1) -> DataFrame:
    """rows with the mean of their class, the relative deviation, and whether it is small."""
    mean = rows.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    off = F.abs(safe_div(F.col(value) - F.col("mean"), F.col("mean")))
    return rows.join(mean, key).withColumn("deviation", off).withColumn("consistent", F.coalesce(F.col("deviation") < most, F.lit(True)))


def total_uncertainty(x: Column, stat: Column, relative: float) -> Column:
    return F.sqrt(stat * stat + F.pow(x * relative, 2))


def search_all(names: DataFrame, texts: DataFrame, distance: int = 2, name_col: str = "process", text_col: str = "text") -> DataFrame:
    """(text_col, name_col, distance): for many texts the names that nearly equal them, by case-folded deletion neighbourhoods."""
    low = names.select(F.col(name_col), F.lower(name_col).alias("_low"))
    asked = texts.select(F.col(text_col), F.lower(text_col).alias("_text"))
    pairs = fuzzy_near(asked, low, "_text", "_low", distance)
    return pairs.join(low, "_low").join(asked, "_text").select(text_col, name_col, "distance").distinct()


def search_names(names: DataFrame, text: str, how: str = "prefix", distance: int = 2, name_col: str = "process") -> DataFrame:
    """Names that begin with, equal or nearly equal a text; for many texts at once see search_all."""
    n = F.lower(F.col(name_col))
    t = text.lower()
    found = {"prefix": n.startswith(t), "exact": n == t, "fuzzy": F.levenshtein(n, F.lit(t), distance) >= 0}
    return names.where(found[how])


def batch_lookup(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    return lookup(parse_names(small(spark, [(n,) for n in names], "process string")), type_col="data_type")


def mapping(rows: DataFrame, key: str, value: str) -> Mapping[str, float]:
    """A small dimension as a dict."""
    return {r[key]: r[value] for r in rows.select(key, value).collect()}
