"""Files read by tasks: record batches, columns and ends of files."""

import resource

import pandas as pd
import pyarrow as pa
import pytest

from quillon.sources import files, readers


def save(path, batches, rows, fields=("a", "b", "c"), start=0):
    columns = {n: pa.array(range(start, start + rows), pa.int64() if n != "b" else pa.float64()) for n in fields}
    batch = pa.RecordBatch.from_pydict(columns)
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_file(sink, batch.schema) as out:
        for _ in range(batches):
            out.write_batch(batch)


def test_arrow_by_record_batch(spark, tmp_path):
    save(tmp_path / "one file.arrow", 40, 100)
    save(tmp_path / "two.arrow", 3, 10, ("c", "b", "a", "more"))
    save(tmp_path / "none.arrow", 0, 10)
    df = readers.scan(spark, str(tmp_path))
    assert df.count() == 4030 and set(df.columns) == {"a", "b", "c"}
    some = readers.load_table(spark, str(tmp_path), ["b"], ["a >= 50"])
    assert some.columns == ["b"] and some.count() == 2000
    tasks = files.arrow_batches(spark, [str(tmp_path / "one file.arrow")]).rdd.getNumPartitions()
    assert tasks >= spark.sparkContext.defaultParallelism  # one file, several tasks
    with pytest.raises(Exception, match="zz"):
        readers.load_table(spark, str(tmp_path), ["zz"])


def test_whole_files_say_the_same(spark, tmp_path):
    save(tmp_path / "x.arrow", 5, 20)
    paths = [f"file:{tmp_path}/x.arrow"]
    whole = readers._whole_arrow(spark, paths, ["c", "a"])
    assert whole.columns == ["c", "a"] and sorted(whole.collect()) == sorted(files.arrow_batches(spark, paths, ["c", "a"]).collect())


def test_batches_are_read_in_place(tmp_path):
    save(tmp_path / "large.arrow", 64, 200_000)  # 300 MB
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with files.opened(str(tmp_path / "large.arrow")) as file:
        reader = pa.ipc.open_file(file, options=pa.ipc.IpcReadOptions(included_fields=[1]))
        assert sum(reader.get_batch(k).num_rows for k in range(4)) == 800_000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 150_000  # KB


def test_ends_of_many_files_in_one_job(spark, tmp_path):
    paths = [str(tmp_path / f"f {k}.parquet") for k in range(60)]
    for k, p in enumerate(paths):
        pd.DataFrame({"a": range(k)} | ({"b": range(k)} if k % 2 else {})).to_parquet(p)
    (tmp_path / "bad.parquet").write_text("not parquet " * 200)
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ends", "ends")
    got = readers.validate_files(spark, [*paths, str(tmp_path / "bad.parquet"), str(tmp_path / "gone.parquet"), str(tmp_path / "x_tmp.parquet")], 10, 1_000_000, ["a", "b"])
    jobs = len(seen.getJobIdsForGroup("ends"))
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert jobs <= 2
    assert {p: w for p, w in got.items() if p in paths} == {p: "lacks ['b']" for p in paths[::2]}
    assert [got[str(tmp_path / n)] for n in ("bad.parquet", "gone.parquet", "x_tmp.parquet")] == ["no parquet file", "too small", "temporary"]
    assert {r["path"]: r["rows"] for r in readers.count_rows(spark, paths).collect()} == {p: k for k, p in enumerate(paths)}
    driver = readers._validate_by_driver(spark, paths, 10, 1_000_000, ["a", "b"])
    assert driver == {p: "lacks ['b']" for p in paths[::2]}
    assert readers.validate_files(spark, [], 1) == {} and not files.reachable("viewfs://store/x") and files.reachable("s3a://b/x")
