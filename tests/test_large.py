"""What only shows on large tables, on few rows."""

from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np

from quillon.llm import neighbours
from quillon.operators import derive, luminosity
from quillon.operators.processes import Processes
from quillon.plans import loaders
from quillon.plans.base import QUERIES, Tables
from quillon.session import small
from quillon.sources import readers


def test_photon_along_the_recoil(spark):
    """Rounding puts the cosine of the first photon over 1, as products from left to right do, so it isn't the nearest."""
    columns = "__event__ long, partkey int, pRecoil double, pRecoilTheta double, pRecoilPhi double, E double, theta double, phi double"
    recoil = (1.8, 3.0044999999999997)
    rows = [(1, 1, 5.181289499999999, *recoil, 0.1, *recoil), (1, 2, 1.3820000000000001, *recoil, 0.1, 0.8719999999999999, -1.3565000000000003), (1, 3, 1.181621, *recoil, 0.6, 1.612, -2.1825)]
    best = derive.best_photon(spark.createDataFrame(rows, columns), tiebreak=["partkey"]).collect()
    assert [r["partkey"] for r in best] == [3]


def test_small_tables_are_broadcast(spark):
    """Joins with processes' names, weights and files don't deal the large table by them."""
    big = spark.range(100).selectExpr("concat('p', id % 2) AS process", "id").repartition(3)
    weighted = luminosity.apply_weights(big, luminosity.weights(small(spark, [("p0",), ("p1",)], "process string"), "5S_scan"))
    region = Tables(spark, "").rows([("p0", 1)], "process string, region int")
    for joined in (weighted, Processes(big).apply("join", other=region, on="process")):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert weighted.count() == 100 and small(spark, [], "a string, b double").collect() == []
    assert small(spark, [("x", None, 1), (None, 2, 3)], "a string, b double, c int").collect() == [("x", None, 1), (None, 2.0, 3)]


def test_files_of_a_process(spark, tmp_path):
    """Files are as many as the tasks that read the table, and no task gets all rows of a value."""
    spark.range(4000).selectExpr("id", "CASE WHEN id % 10 < 9 THEN 'a' ELSE 'b' END AS k").repartition(8).write.parquet(str(tmp_path / "t.parquet"))
    df = spark.read.parquet(str(tmp_path / "t.parquet")).repartition(8)
    base = loaders._lay(Tables(spark, ""), df, {"a": "{}/a.parquet", "b": "b_{}.parquet"}, "k")
    paths = [f.path for f in readers.listing(spark, base)]
    rows = [r["rows"] for r in readers.count_rows(spark, paths).collect()]
    assert len(rows) == 16 and sum(rows) == 4000 and max(rows) < 1000
    named = readers.load_process_dir(spark, base, only=["a"])
    assert named.count() == 3600 and "BroadcastHashJoin" in named._jdf.queryExecution().executedPlan().toString()


def test_arrow_files_grow_with_the_table(spark, tmp_path):
    """scan_arrow writes a file in each task that reads the table."""
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(9).write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", 1 << 27)
    try:
        df = QUERIES["scan_arrow"](spark, str(tmp_path))
        at = sorted(Path(unquote(urlparse(spark.conf.get("spark.checkpoint.dir")).path)).glob("arrow-*"), key=lambda p: p.stat().st_mtime)[-1]
        assert len(list(at.glob("*.arrow"))) == 9 and sum(r["count"] for r in df.collect()) == 6000
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_all_queries_walk_with_one_beam(spark, monkeypatch):
    """The checked queries find how wide beams have to be; the others don't walk with narrower ones before."""
    x = np.random.default_rng(3).normal(size=(1500, 16))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    graph, seen = neighbours.Graph(rows, 16, width=8), set()

    def watched(df, tag, kept=neighbours.materialise):
        out = kept(df, tag)
        if tag == "ann-beams":
            some = out.selectExpr("sum(length(ids)) / 8 AS n", "max(length(mets) / length(ids)) AS width").first()
            seen.add((some["n"] > neighbours.CHECKED, some["width"]))
        return out

    monkeypatch.setattr(neighbours, "materialise", watched)
    found = graph.search(rows.where("id % 4 = 0").selectExpr("id AS query_id", "vec", "id AS at"), beam=24, recall=0.9).collect()
    assert graph.recall >= 0.9 and graph.beam > 24 and len({r["query_id"] for r in found}) == 375
    assert {width for many, width in seen if many} == {graph.beam} and (False, 24) in seen
