"""Loaders by directory layout, each on files that its query writes from the tables first."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.processes import Processes
from ..scratch import place
from ..sources import files, readers
from .base import EVENTS, Tables, query


def _lay(t: Tables, df: DataFrame, paths: Mapping[str, str], column: str = "l_returnflag") -> str:
    """A directory with parquet files for each value of a column, at the paths that say where; {} in a path is a file's number.

    A value has a file from each task that reads the table, so none gets all rows of a value.
    """
    base = place(t.spark, "layout")
    hadoop = t.spark.sparkContext._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(base).getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration())
    for value, path in paths.items():
        parts = hadoop.Path(f"{base}-parts")
        df.where(F.col(column) == value).drop(column).write.parquet(parts.toString())
        for k, part in enumerate(fs.globStatus(hadoop.Path(parts, "part-*"))):
            to = hadoop.Path(f"{base}/{path.format(k)}")
            fs.mkdirs(to.getParent())
            fs.rename(part.getPath(), to)
        fs.delete(parts, True)
    return base


def _lines(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_orderkey", "l_quantity", "l_extendedprice")


@query(
    "SELECT CASE l_returnflag WHEN 'A' THEN 'mumu_A' ELSE 'ccbar_R' END AS process, count(*) AS count, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL",
)
def load_processes(t):
    """Files of a directory as processes, chosen by parts of their names; others aren't read."""
    base = _lay(t, _lines(t), {"A": "{}/mumu_A.parquet", "N": "{}/tau_N.parquet", "R": "deep/{}/ccbar_R.parquet"})
    df = readers.load_process_dir(t.spark, base, only=["MuMu", "bar_r"])
    return df.groupBy("process").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'data-5S' WHEN 'N' THEN 'mumu-5S' ELSE 'qqbar-off' END AS process, count(*) AS count FROM lineitem GROUP BY ALL")
def load_flat(t):
    """Flat files that are named by process, resolution and kind."""
    base = _lay(t, _lines(t), {"A": "{}/data-5S_vpho.parquet", "N": "{}/mc16-mumu-5S_vpho.parquet", "R": "{}/mc16-qqbar-off_vpho.parquet"})
    return Processes(readers.load_flat(t.spark, base, "vpho")).counts()


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'data-5S' ELSE 'mumu-5S' END AS process, count(*) AS count FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL")
def load_flat_energy(t):
    """Of flat files only those of an energy condition."""
    base = _lay(t, _lines(t), {"A": "{}/data-5S_vpho.parquet", "N": "{}/mc16-mumu-5S_vpho.parquet", "R": "{}/mc16-qqbar-off_vpho.parquet"})
    return Processes(readers.load_flat(t.spark, base, "vpho", "5S_scan")).counts()


@query(
    f"SELECT CASE process WHEN 'AF' THEN 'mc5S_mumu' ELSE 'mc5S_taupair' END AS process, count(*) AS count, round(sum(\"mu1P\"), 4) AS momentum FROM ({EVENTS}) WHERE process IN ('AF', 'NO') GROUP BY ALL",
)
def load_particle(t):
    """Directories as processes: their files of a particle and energy condition, with the columns that it needs and weights."""
    rows = t.events_mu.withColumnRenamed("process", "kind").where("kind IN ('AF', 'NO', 'RF')")
    base = _lay(t, rows, {"AF": "mc5S_mumu/a_vpho_{}.parquet", "NO": "mc5S_taupair/b_vpho_{}.parquet", "RF": "mc4S_mumu/c_vpho_{}.parquet"}, "kind")
    df = readers.load_particle(t.spark, base, "vpho").where("lumi_weight > 0")
    return df.groupBy("process").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("mu1P"), 4).alias("momentum"))


@query(
    "SELECT CASE l_returnflag WHEN 'A' THEN 'mumu_1' WHEN 'N' THEN 'ccbar_2' ELSE 'tau_3' END AS process, CASE l_returnflag WHEN 'A' THEN 'mumu' WHEN 'N' THEN 'qqbar' ELSE 'taupair' END AS grp, count(*) AS count FROM lineitem GROUP BY ALL",
)
def load_samples(t):
    """Samples by quoted and plain directories, combined files and subtasks, with their groups."""
    paths = {"A": "'sample_name=mumu_1'/deep/x_combined_vpho_{}.parquet", "N": "ccbar_2/y_vpho_{}.parquet", "R": "tau_3/subtasks/z_vpho_{}.parquet"}
    found = readers.load_samples(t.spark, _lay(t, _lines(t), paths), ["mumu_1", "ccbar_2", "tau_3"], "vpho", ["l_quantity"])
    return found.counts().join(found.groups().where("grp <> 'all'"), "process")


@query("SELECT CASE l_returnflag WHEN 'A' THEN 'a' WHEN 'N' THEN 'n' ELSE 'r' END AS name, count(*) AS rows, 'lacks [''nowhere'']' AS why FROM lineitem GROUP BY ALL")
def validate_files(t):
    """Rows and missing columns of files, from their ends, one job for all."""
    base = _lay(t, _lines(t), {"A": "a/{}.parquet", "N": "n/{}.parquet", "R": "r/{}.parquet"})
    paths = [f.path for f in readers.listing(t.spark, base)]
    unfit = readers.validate_files(t.spark, paths, 1, required=["l_quantity", "nowhere"])
    why = t.rows([(p, w) for p, w in unfit.items()], "path string, why string")
    found = readers.count_rows(t.spark, paths).join(why, "path").withColumn("name", F.regexp_extract("path", r"(\w+)/\w+\.parquet$", 1))
    return found.groupBy("name", "why").agg(F.sum("rows").alias("rows"))


@query("SELECT l_returnflag, count(*) AS count, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def scan_arrow(t):
    """Arrow files by record batch, of which two columns are read."""
    import pyarrow as pa

    path = place(t.spark, "arrow")

    def save(batches):
        first, out, fs, at = next(batches, None), None, *files._place(path)
        if first is not None:
            fs.create_dir(at)
            with fs.open_output_stream(f"{at}/{first.column('part')[0].as_py()}.arrow") as sink, pa.ipc.new_file(sink, first.schema) as out:
                out.write_batch(first)
                for batch in batches:
                    out.write_batch(batch)
            yield pa.RecordBatch.from_pydict({"done": [1]})

    t.lineitem.withColumn("part", F.spark_partition_id()).mapInArrow(save, "done long").count()
    df = readers.load_table(t.spark, path, ["l_returnflag", "l_quantity"])
    return df.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("count"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
