"""Times the headline queries; prints one JSON line.

Each query runs once to warm up and then three times into a sink that computes
every row; the median counts. `large` has the same for a histogram and a sum over
LARGE rows or more, copies of the line items, of which no query of the total reads any; `load` is
what the machine had to do before and after, per CPU.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quillon.plans import catalog
from quillon.session import session

HEADLINES = (
    "flagship", "hist", "hist_weighted", "hist_broadcast", "hist_group", "query_string", "q_math", "apply_cuts", "one_cand_ranked", "delta_columns", "join_inner",
    "groupby_dict_agg", "agg_sum", "weighted_mean_var", "describe", "broadcast_chain", "efficiency", "wilson", "sort",
)


LARGE = 10_000_000


def timed(run) -> float:
    """Seconds: the median of three runs after one."""
    times = []
    for _ in range(4):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return round(statistics.median(times[1:]), 4)


def large(spark, sf_dir: str) -> dict[str, float]:
    """A histogram and sums over LARGE rows."""
    from pyspark.sql import functions as F

    from quillon.operators import histogram
    from quillon.scratch import place
    from quillon.session import load

    lines, path = load(spark, sf_dir, "lineitem").select("l_extendedprice", "l_discount"), place(spark, "bench")
    copies = -(-LARGE // lines.count())
    lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy").write.parquet(path)
    df = spark.read.parquet(path)
    out = {"rows": df.count()}
    out["hist"] = timed(lambda: histogram.counts_edges(histogram.hist(df, "l_extendedprice", 100, (0.0, 110000.0))))
    out["sum"] = timed(lambda: df.agg(F.sum("l_extendedprice"), F.sum("l_discount")).collect())
    return out | {"hist_rows_per_sec": round(out["rows"] / out["hist"]), "sum_rows_per_sec": round(out["rows"] / out["sum"])}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", spark__master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    load = [round(os.getloadavg()[0] / os.cpu_count(), 2)]
    queries, took = catalog.queries(), {}
    for name in HEADLINES:
        took[name] = timed(lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    more = large(spark, sf_dir)
    load.append(round(os.getloadavg()[0] / os.cpu_count(), 2))
    line = {"metric": "headline queries, warm medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(line | {"lineitem_rows": rows, "hist_rows_per_sec": round(rows / took["hist"]), "large": more, "load": load}))
    spark.stop()


if __name__ == "__main__":
    main()
