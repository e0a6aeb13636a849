"""Readers: typed files, directories of processes, name-based discovery.

Files are listed through Hadoop's file systems, so paths may be in any store that
Spark reads; what a name rules out isn't read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from fnmatch import fnmatch
from pathlib import Path, PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.expressions import compile_query, query_columns
from ..operators import luminosity, processes, selection
from ..session import small
from . import files

NULLS = ("", "NULL", "null", "NA", "N/A", "nan", "NaN")


def _csv(sep: str) -> Callable[[SparkSession, str], DataFrame]:
    def read(spark: SparkSession, path: str) -> DataFrame:
        df = spark.read.options(header=True, inferSchema=True, sep=sep, mode="PERMISSIVE", nullValue="").csv(path)
        texts = {c: F.when(F.col(c).isin(*NULLS), None).otherwise(F.col(c)).alias(c) for c, t in df.dtypes if t == "string"}
        return df.withColumns(texts) if texts else df

    return read


@dataclass(frozen=True)
class File:
    """A file or directory of any store."""

    path: str
    size: int
    directory: bool = False

    @property
    def parts(self) -> tuple[str, ...]:
        return PurePosixPath(re.sub(r"^[A-Za-z0-9+.-]+:", "", self.path)).parts

    name = property(lambda self: self.parts[-1])
    stem = property(lambda self: PurePosixPath(self.name).stem)
    suffix = property(lambda self: PurePosixPath(self.name).suffix.lower())


def _statuses(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    return fs, list(fs.globStatus(at) or [])


def listing(spark: SparkSession, path: str, pattern: str = "*", directories: bool = False) -> list[File]:
    """Files (or directories) at or below a path or glob whose names match, by path; hidden ones are left out."""
    fs, todo = _statuses(spark, path)
    out, level = [], 0
    while todo:
        below = []
        for status in todo:
            name = status.getPath().getName()
            if level and name.startswith(("_", ".")):
                continue
            if status.isDirectory():
                below += list(fs.listStatus(status.getPath()))
            if status.isDirectory() == directories and fnmatch(name, pattern) and (level or not directories):
                out.append(File(status.getPath().toString(), status.getLen(), directories))
        todo, level = below, level + 1
    return sorted(out, key=lambda f: f.path)


def _arrow(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Feather and Arrow files by record batch; the schema is that of the first file.

    In a store that only Spark reads, a task gets a whole file as one row instead, 2 GB at most.
    """
    paths = [f.path for f in listing(spark, path) if f.suffix in (".feather", ".arrow", ".ipc")]
    if not paths:
        raise FileNotFoundError(path)
    return files.arrow_batches(spark, paths, columns) if all(map(files.reachable, paths)) else _whole_arrow(spark, paths, columns)


def _whole_arrow(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None) -> DataFrame:
    binary = lambda paths: spark.read.format("binaryFile").load(paths).select("content")

    def opened(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for content in batch.column(0):
                yield pa.ipc.open_file(pa.py_buffer(content.as_py()))

    def header(batches):
        for file in opened(batches):
            yield pa.RecordBatch.from_pydict({"schema": [file.schema.remove_metadata().serialize().to_pybytes()]})

    schema = pa.ipc.read_schema(pa.py_buffer(bytes(binary(paths[:1]).mapInArrow(header, "schema binary").first()[0])))
    schema = schema if columns is None else pa.schema([schema.field(c) for c in columns])

    def read(batches):
        for file in opened(batches):
            for k in range(file.num_record_batches):
                yield from pa.Table.from_batches([file.get_batch(k)]).select(schema.names).cast(schema).to_batches()

    return binary(list(paths)).mapInArrow(read, from_arrow_schema(schema))


#: Reader by suffix. Formats that need other jars or packages are refused by name.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".parquet": lambda spark, path: spark.read.parquet(path), ".csv": _csv(","), ".tsv": _csv("\t"), ".txt": _csv("\t"),
    ".json": lambda spark, path: spark.read.json(path), ".jsonl": lambda spark, path: spark.read.json(path), ".ndjson": lambda spark, path: spark.read.json(path),
    ".orc": lambda spark, path: spark.read.orc(path), ".feather": _arrow, ".arrow": _arrow, ".ipc": _arrow,
}
ARROW = (".feather", ".arrow", ".ipc")
REFUSED = {".root": "ROOT files", ".delta": "Delta tables", ".xlsx": "Excel files", ".xls": "Excel files"}


def _kind(spark: SparkSession, path: str) -> str:
    """The suffix that says how to read a path: its own, or that of the files below it."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix in READERS or suffix in REFUSED:
        return suffix
    if any(f.name == "_delta_log" for s in _statuses(spark, path.rstrip("/") + "/_delta_log")[1] for f in [File(s.getPath().toString(), 0)]):
        return ".delta"
    kinds = {f.suffix for f in listing(spark, path)} & {*READERS, *REFUSED}
    if len(kinds) > 1:
        raise ValueError(f"files of several kinds below {path}: {sorted(kinds)}")
    return kinds.pop() if kinds else ".csv"


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file, a glob or a directory, by its suffix or that of the files below; unknown kinds are read as csv."""
    kind = _kind(spark, path)
    if kind in REFUSED:
        raise ValueError(f"{REFUSED[kind]} can't be read here: {path}")
    if schema and kind == ".parquet":
        return spark.read.schema(schema).parquet(path)
    return READERS[kind](spark, path)


def from_memory(spark: SparkSession, source) -> DataFrame:
    """A table from a DataFrame, a pandas frame, a path, or a list of one kind of these."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, pd.DataFrame):
        return spark.createDataFrame(source)
    if isinstance(source, (str, Path)):
        return scan(spark, str(source))
    if isinstance(source, (list, tuple)) and source:
        if len({type(s) for s in source}) > 1:
            raise TypeError("a list of different kinds")
        out = from_memory(spark, source[0])
        for s in source[1:]:
            out = out.unionByName(from_memory(spark, s))
        return out
    raise TypeError(f"no table: {type(source).__name__}")


def load_table(spark: SparkSession, path: str, columns: Sequence[str] = (), filters: Sequence[str] = ()) -> DataFrame:
    """scan, then selections, then columns; both reach the file scan (of Arrow files the columns that either needs)."""
    if columns and _kind(spark, path) in ARROW:
        df = _arrow(spark, path, list(dict.fromkeys([*columns, *(c for text in filters for c in query_columns(text))])))
    else:
        df = scan(spark, path)
    for text in filters:
        df = df.where(compile_query(text, df.columns))
    return df.select(*columns) if columns else df


def _plain(path: Column) -> Column:
    """A path without scheme and repeated slashes, as names of one file differ in these."""
    return F.regexp_replace(F.regexp_replace(path, "^[A-Za-z0-9+.-]+:", ""), "^/+", "/")


def read_named(spark: SparkSession, by_name: dict[str, Sequence[str]]) -> DataFrame:
    """Parquet files of each process as one table with a column `process`; columns may differ."""
    rows = [(name, path) for name, paths in by_name.items() for path in paths]
    if not rows:
        raise FileNotFoundError("no files")
    uri = lambda path: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().toString()
    named = small(spark, [(name, uri(path)) for name, path in rows], "process string, _file string").withColumn("_file", _plain(F.col("_file")))
    df = spark.read.option("mergeSchema", "true").parquet(*dict.fromkeys(path for _, path in rows))
    df = df.withColumn("_file", _plain(F.col("_metadata.file_path")))
    # A file that two processes list has its rows in both.
    return df.join(named, "_file").drop("_file")


def _process_files(found: Iterable[File]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = defaultdict(list)
    for f in found:
        out[f.stem].append(f.path)
    return out


def load_process_dir(spark: SparkSession, base: str, pattern: str = "*.parquet", only: Sequence[str] = ()) -> DataFrame:
    """Every file below a directory as a process named after it; `only` names parts, and other files aren't read. No file is an error."""
    found = listing(spark, base, pattern)
    if only:
        found = [f for f in found if any(o.lower() in f.stem.lower() for o in only)]
    return read_named(spark, _process_files(found))


def load_flat(spark: SparkSession, base: str, kind: str, condition: str | None = None) -> DataFrame:
    """Files data-{res}_{kind} and mc16-{proc}-{res}_{kind}: processes data-{res} and {proc}-{res}.

    With a condition only the files of it are read, or all if none says it.
    """
    found: dict[str, list[str]] = defaultdict(list)
    for f in listing(spark, base, f"*_{kind}.parquet"):
        found[re.sub(rf"^(?:mc\d+-)?(.+?)_{re.escape(kind)}$", r"\1", f.stem)].append(f.path)
    kept = {n: p for n, p in found.items() if condition and processes.says_energy(n, condition)}
    return read_named(spark, kept or found)


#: Columns that an analysis of a particle needs, beside the identity of the event.
PARTICLE_COLUMNS = {"vpho": (*processes.derive.RECOIL_COLUMNS, *processes.derive.MUON_COLUMNS), "gamma": ("E", "theta", "phi")}


def load_particle(spark: SparkSession, base: str, particle: str, columns: Sequence[str] | None = None, condition: str = "5S_scan", fraction: float | None = None) -> DataFrame:
    """Subdirectories as processes: their files of a particle, of the energy condition, sampled by event, with weights.

    columns: None for those that the particle needs (all, if none is known), empty for all.
    """
    found: dict[str, list[str]] = defaultdict(list)
    for f in listing(spark, base, f"*{particle}*.parquet"):
        if "tmp" not in f.name:
            found[f.parts[-2]].append(f.path)
    if not found:
        raise FileNotFoundError(f"no {particle} files below {base}")
    df = read_named(spark, {n: p for n, p in found.items() if processes.says_energy(n, condition, particle)})
    wanted = columns if columns is not None else [*selection.EVENT_KEYS, *PARTICLE_COLUMNS[particle]] if particle in PARTICLE_COLUMNS else ()
    if wanted:
        df = df.select(*[c for c in wanted if c in df.columns], "process")
    if fraction is not None:
        df = selection.hash_sample(df, fraction)
    names = luminosity.weights(small(spark, [(n,) for n in sorted(found)], "process string"), condition)
    return luminosity.apply_weights(df, names)


#: Directory parts that say how files are laid out.
LAYOUTS = ("combined", "subtasks")
#: Parts of names of files and directories that are being written.
UNFINISHED = ("tmp", "temp", "_temporary")


def discover(spark: SparkSession, base: str, strategy: str = "auto", pattern: str = "*.parquet") -> dict[str, list[str]]:
    """Files by process: combined (a file each), subtasks (a directory each), manual (as it lies), auto (the first that finds some)."""
    by: dict[str, dict[str, list[str]]] = {s: defaultdict(list) for s in (*LAYOUTS, "manual")}
    roots = _statuses(spark, base)[1]
    depth = len(File(roots[0].getPath().toString(), 0).parts) if roots else 0
    for f in listing(spark, base, pattern):
        if "tmp" in f.name:
            continue
        above = f.parts[depth:-1]
        if any(x.lower() == "combined" for x in above):
            by["combined"][f.stem].append(f.path)
        elif any("sub" in x.lower() for x in above):
            by["subtasks"][next((x for x in reversed(f.parts[:-1]) if "sub" not in x.lower()), f.stem)].append(f.path)
        by["manual"][above[-1] if above else f.stem].append(f.path)
    if strategy == "auto":
        return dict(next((by[s] for s in (*LAYOUTS, "manual") if by[s]), {}))
    return dict(by[strategy])


def load_discovered(spark: SparkSession, base: str, strategy: str = "auto", least: int = 1024, pattern: str = "*.parquet") -> processes.Processes:
    """discover, without files that are unfit (validate_files), as processes of one table."""
    found = discover(spark, base, strategy, pattern)
    unfit = validate_files(spark, [p for paths in found.values() for p in paths], least)
    fit = {n: [p for p in paths if p not in unfit] for n, paths in found.items()}
    fit = {n: p for n, p in fit.items() if p}
    return processes.Processes(read_named(spark, fit), names=list(fit))


def resolve_dirs(spark: SparkSession, base: str, names: Sequence[str]) -> dict[str, tuple[str | None, str | None]]:
    """For each sample the directory called sample_name=..., in quotes or not, and the one of the plain name."""
    prefixed: dict[str, str] = {}
    plain: dict[str, str] = {}
    for f in listing(spark, base, directories=True):
        name = f.name.replace("%3D", "=").replace("%27", "'").strip("'\"").lower()
        if name.startswith("sample_name="):
            prefixed.setdefault(name.removeprefix("sample_name=").strip("'\""), f.path)
        else:
            plain.setdefault(name, f.path)
    return {n: (prefixed.get(n.lower()), plain.get(n.lower())) for n in names}


#: Words in names of files of a kind, in the order in which they are tried.
FILE_KINDS = {"gamma": ("gamma",), "vpho": ("vpho",), "muon": ("muon", "vpho"), "auto": ("",)}


def discover_by_type(spark: SparkSession, directories: tuple[str | None, str | None], kind: str = "auto", least: int = 1) -> tuple[list[str], str]:
    """A sample's files of a kind and how they were found.

    Combined files anywhere below the prefixed directory, else those in `subtasks`
    of the plain one, else all below the plain one. Of these the first that fit.
    """
    words, (prefixed, plain) = FILE_KINDS[kind], directories
    places = [
        (prefixed, "combined", lambda f, w: "combined" in f.name and w in f.name),
        (plain, "subtasks", lambda f, w: f.parts[-2] == "subtasks" and w in f.name),
        (plain, "fallback", lambda f, w: w in f.name),
    ]
    for base, how, fits in places:
        there = listing(spark, base, "*.parquet") if base else []
        for word in words:
            some = [f for f in there if fits(f, word) and f.size >= least and not any(x in f.name for x in UNFINISHED)]
            if some:
                return [f.path for f in some], how
    return [], "none"


def load_samples(spark: SparkSession, base: str, names: Sequence[str], kind: str = "auto", columns: Sequence[str] = (), least: int = 1) -> processes.Processes:
    """Samples found by resolve_dirs and discover_by_type, with the named columns as far as there are, each sample in one group."""
    found = {n: discover_by_type(spark, where, kind, least)[0] for n, where in resolve_dirs(spark, base, names).items()}
    missing = [n for n, some in found.items() if not some]
    if len(missing) == len(found):
        raise FileNotFoundError(f"no files of {missing} below {base}")
    df = read_named(spark, {n: some for n, some in found.items() if some})
    if columns:
        df = df.select(*[c for c in columns if c in df.columns], "process")
    groups = small(spark, [(n,) for n in found if n not in missing], "process string")
    first = groups.select("process", processes.group_first(F.col("process")).alias("grp"))
    return processes.Processes(df, first.unionByName(groups.withColumn("grp", F.lit("all"))), names=[n for n in found if n not in missing])


def validate_files(
    spark: SparkSession, paths: Sequence[str], least: int = 1024, most: int | None = None, required: Sequence[str] = (), exclude: Sequence[str] = UNFINISHED
) -> dict[str, str]:
    """Why files are unfit, by path: name, size, no parquet file, or missing columns.

    One job for all files, whose tasks read sizes and ends of files; the driver gets the unfit ones.
    In a store that only Spark reads, the driver asks for sizes and schemas one by one.
    """
    out = {p: "temporary" for p in paths if any(x in PurePosixPath(p).name.lower() for x in exclude)}
    rest = [p for p in paths if p not in out]
    if not all(map(files.reachable, rest)):
        return out | _validate_by_driver(spark, rest, least, most, required)
    if rest:
        facts = files.parquet_facts(spark, rest)
        lacking = F.array_except(F.array(*map(F.lit, sorted(set(required)))), F.col("columns")) if required else F.array().cast("array<string>")
        why = F.when(F.coalesce("size", F.lit(-1)) < least, "too small").when(F.col("size") > (2**63 - 1 if most is None else most), "too large")
        why = why.when(F.col("columns").isNull(), "no parquet file").when(F.size(lacking) > 0, F.concat(F.lit("lacks ['"), F.array_join(lacking, "', '"), F.lit("']")))
        out |= {r["path"]: r["why"] for r in facts.select("path", why.alias("why")).where("why IS NOT NULL").collect()}  # the unfit ones
    return {p: out[p] for p in paths if p in out}


def _validate_by_driver(spark: SparkSession, paths: Sequence[str], least: int, most: int | None, required: Sequence[str]) -> dict[str, str]:
    def check(path: str) -> tuple[str, str]:
        there = _statuses(spark, path)[1]
        if not there or there[0].getLen() < least:
            return path, "too small"
        if most is not None and there[0].getLen() > most:
            return path, "too large"
        missing = set(required) - set(spark.read.parquet(path).columns) if required else set()
        return path, f"lacks {sorted(missing)}" if missing else ""

    with ThreadPoolExecutor(8) as pool:
        return {p: why for p, why in pool.map(check, paths) if why}


def count_rows(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, rows) of parquet files, from their ends; in a store that only Spark reads, by a scan without columns."""
    if all(map(files.reachable, paths)):
        return files.parquet_facts(spark, paths).select("path", "rows")
    df = spark.read.parquet(*paths)
    return df.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
