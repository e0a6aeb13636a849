"""Many processes at once: one long table with a process column, and groups.

What the analysis applies to every process is one job over the long table, and
groups are a small dimension (process, grp) that may list a process several
times. The mapping view only names parts of that table.
"""

from __future__ import annotations

import difflib
import json
import time
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.expressions import compile_query
from ..functions.scalar import finite, safe_div
from ..session import small
from . import aggregate, derive, histogram, joins, selection
from .luminosity import contains_any, first_match

# Parts of names by group. A process is in every group of which its name has a part.
GROUPS = {
    "mumu": ("mumu", "mu_mu", "muon", "dimuon", "mu+mu-"),
    "ee": ("_ee_", "_ee", "ee_", "electron", "dielectron", "e+e-"),
    "qqbar": ("ccbar", "uubar", "ddbar", "ssbar", "bbbar", "quark"),
    "BBbar": ("charged_b", "mixed_b", "bmeson", "b_decay"),
    "taupair": ("tau", "ditau", "tau+tau-"),
    "llYY": ("eemumu", "eeee", "mumumumu", "llxx", "fourlepton", "4l"),
    "gg": ("gg_fusion", "_gg_", "_gg", "gg_", "twophoton", "diphoton", "gamma"),
    "data": ("data", "proc16", "real", "onpeak", "offpeak"),
    "hhISR": ("hhisr", "hh_isr"),
}
# By priority, first match.
GROUPS_FIRST = (
    (("data", "data_5s", "data_4s", "data_off", "proc"), "data"), (("mumu", "mu_mu"), "mumu"), (("ee", "e_e", "bhabha"), "ee"),
    (("ccbar", "uubar", "ddbar", "ssbar", "bbbar"), "qqbar"), (("charged", "mixed"), "BBbar"), (("taupair", "tau"), "taupair"),
    (("eemumu", "eeee", "llxx"), "llYY"), (("gg",), "gg"), (("hhisr", "hh_isr"), "hhISR"),
)
GROUPS_PLOT = (
    (("mumu", "muon"), "mumu"), (("ee", "electron", "bhabha"), "ee"), (("tau",), "taupair"), (("uubar", "ddbar", "ssbar", "ccbar", "qqbar", "continuum"), "qqbar"),
    (("bbbar", "bb_", "charged", "mixed"), "BBbar"), (("gg", "gamma", "photon"), "gg"),
)
GROUPS_SIMPLE = (
    (("mixed", "all"), "mixed"), (("charged", "charge"), "charged"), (("uu", "uubar", "up"), "uubar"), (("dd", "ddbar", "down"), "ddbar"), (("ss", "ssbar", "strange"), "ssbar"),
    (("cc", "ccbar", "charm"), "ccbar"), (("bb", "bbbar", "bottom", "beauty"), "bbbar"), (("tau", "tauon"), "tau"), (("muon", "mu"), "muon"), (("electron", "e"), "electron"),
)
# Parts that a name of an energy condition must have, and mustn't.
ENERGY = {
    "vpho": {
        "5S_scan": (("5s", "mc5s", "data5s", "scan5s", "scan_5s", "mc-5s", "data-5s"), ("off", "4s", "off_resonance", "offres")),
        "4S_on": (("4s", "mc4s", "data4s", "on_resonance", "onres", "mc-4s", "data-4s"), ("off", "5s", "scan", "off_resonance")),
        "4S_offres": (("off", "mcoff", "dataoff", "off_resonance", "offres"), ("5s", "on_resonance", "onres", "4s_on")),
    },
    "gamma": {"5S_scan": (("5s", "scan"), ("off", "4s")), "4S_on": (("4s", "on"), ("off", "5s")), "4S_offres": (("off",), ("5s", "on"))},
}
#: How an operation treats a group: all members as one, one value, or each by itself.
UNIFYING = {"join", "merge", "concat", "append"}
AGGREGATING = {"mean", "sum", "std", "var", "count", "min", "max", "median", "describe"}


def classify(names: DataFrame, name_col: str = "process", rules: Mapping[str, Sequence[str]] = GROUPS) -> DataFrame:
    """(process, grp): each group a name belongs to, `other` for none, and `all` always."""
    low = F.lower(F.col(name_col))
    hits = F.filter(F.array(*[F.when(contains_any(low, parts), F.lit(g)) for g, parts in rules.items()]), lambda x: x.isNotNull())
    groups = F.concat(F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit("other"))), F.array(F.lit("all")))
    return names.select(F.col(name_col).alias("process"), F.explode(groups).alias("grp"))


def group_first(name: Column) -> Column:
    return first_match(F.lower(name), GROUPS_FIRST, "other")


def group_plot(name: Column) -> Column:
    return first_match(F.lower(name), GROUPS_PLOT, "qqbar")


def group_simple(name: Column) -> Column:
    return first_match(F.lower(name), GROUPS_SIMPLE, "unknown")


def energy_filter(df: DataFrame, condition: str, particle: str = "vpho", name_col: str = "process") -> DataFrame:
    """Rows of processes whose names say the energy condition."""
    include, exclude = ENERGY.get(particle, ENERGY["vpho"])[condition]
    low = F.lower(F.col(name_col))
    return df.where(contains_any(low, include) & ~contains_any(low, exclude))


def says_energy(name: str, condition: str, particle: str = "vpho") -> bool:
    """Whether energy_filter keeps a process of that name; for choosing files before they are read."""
    include, exclude = ENERGY.get(particle, ENERGY["vpho"])[condition]
    low = name.lower()
    return any(p in low for p in include) and not any(p in low for p in exclude)


# Words of names by group, words that say nothing of physics, and groups of words that decide together.
LEXICON = {
    "data": ("data", "proc", "real", "onpeak", "offpeak"),
    "mumu": ("mumu", "mu", "muon", "dimuon"),
    "ee": ("ee", "electron", "bhabha", "dielectron"),
    "gg": ("gg", "gamma", "photon", "diphoton"),
    "hhISR": ("hhisr", "hh", "isr"),
    "llYY": ("eemumu", "eeee", "llxx", "llyy", "fourlepton"),
    "qqbar": ("ccbar", "uubar", "ddbar", "ssbar", "continuum"),
    "BBbar": ("bbbar", "bb", "bmeson", "charged", "mixed"),
    "taupair": ("taupair", "tau", "ditau"),
}
TECHNICAL = ("mc", "p16", "p14", "p15", "v1", "v2", "sample", "name", "combined", "gamma", "vpho")
TOGETHER = (
    (("generic", "bbbar", "charged"), "BBbar", 0.95), (("generic", "bbbar", "mixed"), "BBbar", 0.95), (("continuum", "uubar"), "qqbar", 0.90),
    (("continuum", "ccbar"), "qqbar", 0.90), (("continuum", "ddbar"), "qqbar", 0.90), (("continuum", "ssbar"), "qqbar", 0.90),
)
#: Likeness from which a word counts as one of the lexicon.
ALIKE = 0.8


def name_words(name: str) -> list[str]:
    """Words of two letters or more of a sample's name, without endings of files and technical words."""
    low = name.lower().replace("sample_name=", "").replace("'", "")
    for ending in ("_gamma", "_vpho", "_muon", "_combined", ".parquet", ".root"):
        low = low.removesuffix(ending)
    words = "".join(c if c.isalpha() else " " for c in low).split()
    return [w for w in words if len(w) > 1 and w not in TECHNICAL]


def semantic_scores(name: str) -> dict[str, float]:
    """For each group 0 to 1: a rule's confidence, else the best likeness of one of its words to one of the name's."""
    words = name_words(name)
    ruled = {g: c for parts, g, c in TOGETHER if all(any(p in w for w in words) for p in parts)}
    if ruled:
        return {g: ruled.get(g, 0.0) for g in LEXICON}
    alike = lambda w, p: 1.0 if w == p else difflib.SequenceMatcher(None, w, p).ratio()
    best = {g: max((alike(w, p) for w in words for p in parts), default=0.0) for g, parts in LEXICON.items()}
    # Several words of the lexicon make a name surer than one.
    known = sum(any(alike(w, p) > ALIKE for parts in LEXICON.values() for p in parts) for w in words)
    sure = {0: 0.5, 1: 0.8}.get(known, 1.0)
    return {g: v * sure for g, v in best.items()}


def classify_semantic(name: str, sure: float = 0.8, least: float = 0.5) -> tuple[str, float, str]:
    """(group, confidence, verdict) by words of a name; ties go by the groups' order in the lexicon."""
    scores = semantic_scores(name)
    group = max(scores, key=scores.get)
    c = scores[group]
    return (group, c, "sure") if c >= sure else (group, c, "likely") if c >= least else ("other", c, "unknown")


@dataclass
class Step:
    operation: str
    arguments: dict = field(default_factory=dict)
    parent: int | None = None


class Processes:
    """A mapping view over a long table: names, groups, and operations on all members at once."""

    def __init__(
        self,
        table: DataFrame,
        groups: DataFrame | None = None,
        lineage: Sequence[Step] = (),
        custom: Mapping[str, Sequence[str]] | None = None,
        names: Sequence[str] | None = None,
    ):
        """names: those of all members where they are known, as from files; else they are read from the table when they are asked for.

        Members keep their names whatever a selection leaves of their rows.
        """
        if "process" not in table.columns:
            raise ValueError("the table has no column `process`")
        self.table, self.lineage, self.custom = table, list(lineage), dict(custom or {})
        self._groups, self._names, self.access = groups, None if names is None else sorted(set(names)), Counter()
        self.semantics: dict[str, str] = {}

    @classmethod
    def from_tables(cls, tables: Mapping[str, DataFrame]) -> Processes:
        """Tables by process name; their columns may differ."""
        if not tables:
            raise ValueError("no tables")
        long = None
        for name, df in tables.items():
            one = df.withColumn("process", F.lit(name))
            long = one if long is None else long.unionByName(one, allowMissingColumns=True)
        return cls(long, names=list(tables))

    # names and groups --------------------------------------------------------

    def names(self) -> list[str]:
        if self._names is None:
            self._names = sorted(r[0] for r in self.table.select("process").distinct().collect())  # one row a process
        return self._names

    def _named(self) -> DataFrame:
        """(process): a row for each member, without a scan where names are known."""
        if self._names is None:
            return self.table.select("process").distinct()
        return small(self.table.sparkSession, [(n,) for n in self._names], "process string")

    def groups(self) -> DataFrame:
        base = self._groups if self._groups is not None else classify(self._named())
        if not self.custom:
            return base
        rows = [(p, g) for g, members in self.custom.items() for p in members]
        return base.unionByName(small(self.table.sparkSession, rows, "process string, grp string"))

    def members(self, group: str) -> list[str]:
        if group in self.custom:
            return sorted(self.custom[group])
        return sorted(r[0] for r in self.groups().where(F.col("grp") == group).select("process").distinct().collect())

    def list_groups(self) -> dict[str, int]:
        return {r["grp"]: r["count"] for r in self.groups().groupBy("grp").count().collect()}

    def add_group(self, name: str, members: Sequence[str]) -> Processes:
        missing = set(members) - set(self.names())
        if missing:
            raise KeyError(f"no such processes: {sorted(missing)}")
        return self._with(self.table, "add_group", name=name, custom=self.custom | {name: tuple(members)})

    def add_process(self, name: str, df: DataFrame) -> Processes:
        out = self._with(self.table.unionByName(df.withColumn("process", F.lit(name)), allowMissingColumns=True), "add_process", name=name)
        if self._names is not None:
            out._names = sorted({*self._names, name})
        return out

    def group(self, name: str) -> Processes:
        """Only a group's members."""
        members = self.members(name)
        if not members:
            raise KeyError(name)
        out = self._with(self.table.where(F.col("process").isin(members)), "group", name=name, custom={name: members})
        out._names = members if self._names is None else [n for n in self._names if n in set(members)]
        return out

    def __getitem__(self, key: str) -> DataFrame:
        self.access[key] += 1
        if key in self.names():
            return self.table.where(F.col("process") == key)
        members = self.members(key)
        if members:
            return self.table.where(F.col("process").isin(members))
        near = difflib.get_close_matches(key, [*self.names(), *self.list_groups()])
        raise KeyError(f"{key!r}" + (f"; did you mean {', '.join(near)}?" if near else ""))

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.group(name)
        except KeyError as error:
            raise AttributeError(name) from error

    def __iter__(self) -> Iterator[str]:
        return iter(self.names())

    def __len__(self) -> int:
        return len(self.names())

    def __contains__(self, key: object) -> bool:
        return key in self.names()

    def select_chain(self, particle: str, process: str = "") -> DataFrame:
        """The union of all processes whose names have both parts."""
        low = F.lower(F.col("process"))
        return self.table.where(low.contains(particle.lower()) & low.contains(process.lower()))

    # operations on all members -----------------------------------------------

    def _with(self, table: DataFrame, operation: str, custom: Mapping | None = None, **arguments) -> Processes:
        step = Step(operation, {k: str(v) for k, v in arguments.items()}, len(self.lineage) - 1 if self.lineage else None)
        out = type(self)(table, self._groups, [*self.lineage, step], self.custom if custom is None else custom, self._names)
        out.semantics = dict(self.semantics)
        return out

    def query(self, text: str, /, **variables) -> Processes:
        return self._with(self.table.where(compile_query(text, self.table.columns, **variables)), "query", text=text)

    def one_candidate(
        self,
        keys: Sequence[str] | None = None,
        sort_col: str | None = None,
        ascending: bool = False,
        tiebreak: Sequence[str] = (),
        decisive: bool = False,
    ) -> Processes:
        keys = ["process", *(keys or selection.event_keys(self.table))]
        best = selection.one_candidate(self.table, keys, sort_col, ascending, tiebreak, decisive=decisive)
        return self._with(best, "one_candidate", keys=keys)

    def delta_columns(self) -> Processes:
        return self._with(derive.delta_columns(self.table), "delta_columns")

    def transform(self, f: Callable[[DataFrame], DataFrame]) -> Processes:
        return self._with(f(self.table), "transform")

    def hist(self, column: str, **options) -> DataFrame:
        """Histograms of all processes, one job."""
        return histogram.hist(self.table, column, by=["process"], **options)

    def group_hist(self, column: str, **options) -> DataFrame:
        """Histograms of groups (a process counts in each of its groups)."""
        h = self.hist(column, **options)
        return histogram.grouped(h.join(self.groups(), "process"))

    def counts(self) -> DataFrame:
        return aggregate.group_count(self.table, ["process"])

    def describe(self, columns: Sequence[str] = ()) -> dict[str, DataFrame]:
        """aggregate.describe of each process, all from the same passes over the table."""
        spark, wanted = self.table.sparkSession, columns or aggregate.numeric_columns(self.table, ["process"])
        rows = defaultdict(list)
        found = aggregate.group_describe(self.table, ["process"], wanted)
        for r in found.collect():  # a row for each process and column
            rows[r["process"]].append(tuple(r)[1:])
        return {n: spark.createDataFrame(some, found.drop("process").schema) for n in self.names() if (some := rows.get(n))}

    def broadcast(self, f: Callable[[DataFrame], object]) -> tuple[dict[str, object], dict[str, str]]:
        """f of each process's table; errors are returned by name, not raised. For aggregates use aggregate_each, which takes one job."""
        results, errors = {}, {}
        for n in self.names():
            try:
                results[n] = f(self[n])
            except Exception as error:  # errors by member are part of the result
                errors[n] = f"{type(error).__name__}: {error}"
        return results, errors

    def aggregate_each(self, **aggregates: Column) -> tuple[dict[str, dict[str, object]], dict[str, str]]:
        """Aggregates of each process by name, in one job; a process without rows has those of no rows.

        If the job fails, each process is aggregated by itself, and those that fail are returned with their errors.
        """
        named = [c.alias(k) for k, c in aggregates.items()]
        try:
            got = {r["process"]: {k: r[k] for k in aggregates} for r in self.table.groupBy("process").agg(*named).collect()}
        except PySparkException:
            return self.broadcast(lambda df: df.agg(*named).first().asDict())
        empty = None
        for n in self.names():
            if n not in got:
                empty = empty or self.table.limit(0).agg(*named).first().asDict()
                got[n] = dict(empty)
        return got, {}

    def apply(self, operation: str, columns: Sequence[str] = (), other: DataFrame | None = None, **options):
        """By the operation's kind: one table or value over all members, or one for each process.

        Unifying ones take all members as one table: join and merge join it with
        `other` (options as of joins.join and joins.merge), concat and append add its rows.
        """
        kind = self.semantics.get(operation) or ("aggregating" if operation in AGGREGATING else "unifying" if operation in UNIFYING else "preserving")
        if kind == "unifying":
            if operation in ("join", "merge"):
                if other is None:
                    raise ValueError(f"{operation} needs another table")
                return getattr(joins, operation)(self.table, other, **options)
            return self.table if other is None else self.table.unionByName(other, allowMissingColumns=True)
        if operation == "describe":
            return aggregate.describe(self.table, columns)
        if kind == "aggregating":
            return aggregate.agg_frame(self.table, operation, columns)
        return aggregate.group_all(self.table, ["process"], operation, columns)

    def set_semantics(self, operation: str, kind: str) -> None:
        if kind not in ("unifying", "aggregating", "preserving"):
            raise ValueError(kind)
        self.semantics[operation] = kind

    def shape(self) -> tuple[int, int]:
        return self.table.count(), len(self.table.columns)

    def validate(self) -> DataFrame:
        """Rows of the group dimension whose process the table lacks."""
        return self.groups().join(self._named(), "process", "left_anti")

    def access_stats(self) -> dict[str, object]:
        return {"accesses": dict(self.access), "most": self.access.most_common(1), "lineage": len(self.lineage)}

    def observed(self) -> tuple[Processes, Observation]:
        """The same processes, which tell how many rows of each one passed here, from the job that uses them (see metrics)."""
        watch = Observation()
        counts = [F.count_if(F.col("process") == n).alias(n) for n in self.names()]
        return self._with(self.table.observe(watch, F.count(F.lit(1)).alias("rows"), *counts), "observed"), watch

    def profile(self) -> dict[str, object]:
        """What one run of the table's plan takes and gives: seconds, and rows of each process, none of it kept."""
        seen, watch = self.observed()
        start = time.monotonic()
        seen.table.write.format("noop").mode("overwrite").save()
        got = watch.get
        return {"seconds": time.monotonic() - start, "rows": got["rows"], "by_process": {n: got[n] for n in self.names()}, "steps": len(self.lineage)}

    def save_metadata(self, path: str) -> None:
        Path(path).write_text(json.dumps({"names": self.names(), "custom": {k: list(v) for k, v in self.custom.items()}, "lineage": [vars(s) for s in self.lineage]}))

    def load_metadata(self, path: str) -> Processes:
        got = json.loads(Path(path).read_text())
        out = Processes(self.table, self._groups, [Step(**s) for s in got["lineage"]], got["custom"])
        return out

    def explain(self) -> str:
        lines = [f"{i}: {s.operation} {s.arguments}" for i, s in enumerate(self.lineage)]
        return "\n".join(lines)


@dataclass(frozen=True)
class Context:
    """Settings of an analysis."""

    condition: str = "5S_scan"
    beam_energy: float = 10.87
    bins: int = 50
    level: float = 0.6827

    @contextmanager
    def variation(self, **changes):
        """The context with some settings changed, for a block."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        yield replace(self, **changes)


def quick_analysis(
    df: DataFrame, cuts: Sequence[str], keys: Sequence[str], sort_col: str, column: str, bins: int, range: tuple[float, float],
    tiebreak: Sequence[str] = (), by: Sequence[str] = (), weights: str | Column | None = None, decisive: bool = False,
) -> DataFrame:
    """Cuts, one candidate an event, histogram; decisive as of selection.one_candidate."""
    for cut in cuts:
        df = df.where(compile_query(cut, df.columns))
    best = selection.one_candidate(df, keys, sort_col, tiebreak=tiebreak, decisive=decisive)
    return histogram.hist(best, column, bins, range, weights, by=by)


def progressive_analysis(
    df: DataFrame,
    cuts: Sequence[str],
    keys: Sequence[str],
    sort_col: str,
    column: str,
    bins: int,
    range: tuple[float, float],
    tiebreak: Sequence[str] = (),
    photon: bool = False,
) -> dict[str, DataFrame]:
    """Histograms of the stages, and the cuts' efficiency per bin: baseline, candidates, cuts, and photon if asked.

    Each row carries which stages keep it, so all stages come from one scan and one
    aggregation. An event has one candidate, so its best photon is that row's, if it isn't too soft.
    """
    order = [F.col(sort_col).desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tiebreak]]
    nr = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = F.lit(True)
    for cut in cuts:
        kept = kept & F.coalesce(compile_query(cut, df.columns), F.lit(False))
    flags = {"_candidates": F.col(sort_col).isNotNull() & (nr == 1), "_kept": kept}
    stages = {"baseline": F.lit(True), "candidates": F.col("_candidates"), "cuts": F.col("_candidates") & F.col("_kept")}
    if photon:
        flags["_photon"] = derive.hard_enough()
        stages["photon"] = stages["cuts"] & F.col("_photon")
    x = F.col(column).cast("double")
    rows = df.withColumns(flags).where(finite(F.col(column))).withColumn("bin", histogram.bin_index(x, *map(float, range), bins))
    counts = rows.where("bin IS NOT NULL").groupBy("bin").agg(*[F.count_if(c).alias(s) for s, c in stages.items()])
    dense = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").fillna(0)
    width = (range[1] - range[0]) / bins
    edge = lambda k: F.lit(float(range[0])) + k * F.lit(width)
    out = {s: dense.select(
        "bin",
        edge(F.col("bin")).alias("lo"),
        edge(F.col("bin") + 1).alias("hi"),
        F.col(s).alias("count"),
        F.col(s).cast("double").alias("sumw"),
        F.col(s).cast("double").alias("sumw2"),
    ) for s in stages}
    found = dense.select("bin", F.col("cuts").alias("passed"), F.col("candidates").alias("total"))
    return out | {"efficiency": found.withColumn("efficiency", safe_div(F.col("passed"), F.col("total")))}


def report(title: str, stats: Mapping[str, object]) -> str:
    """A short Markdown report."""
    return "\n".join([f"# {title}", "", "| item | value |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in stats.items())]) + "\n"
