"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: a warm-up run, then the median of five.

Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakeloom.queries import Tables, queries  # noqa: E402

# Shapes of the baseline at the size of lineitem: a join with orders, a sum by key, a window over all lines.
LARGE = {
    "join_orders_lineitem": "SELECT l_orderkey, l_linenumber, l_extendedprice, o_custkey, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "group_by_lineitem": "SELECT l_suppkey, sum(l_extendedprice) AS total, count(*) AS n FROM lineitem GROUP BY l_suppkey",
    "window_lineitem": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem",
}
HEADLINE = ("filter_range_ops", "group_by_agg", "pricing_summary", "join_inner", "join_multiway", "sort_external", "topk", "win_row_number", "distinct", "agg_count_distinct", "vector_topk_cosine")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_HEAP", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, times = queries(), {}
    made |= {name: lambda spark, d, text=text: Tables(spark, d).sql(text).df for name, text in LARGE.items()}
    for name in (*HEADLINE, *LARGE):
        runs = []
        for i in range(RUNS + 1):
            start = time.perf_counter()
            made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 4)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "cores": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
