"""Time every registered query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs after one warm-up, default 3), BENCH_QUERIES (comma list),
BENCH_SECONDS (default 300): queries that come when their share of this time is used up
get one timed run.
Prints one JSON line: per query the median seconds of a full materialisation, and
their sum.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from tablewright import configure, intermediate_tables
from tablewright.plans import QUERIES


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablewright-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    budget = float(os.environ.get("BENCH_SECONDS", "300"))
    began, seconds = time.perf_counter(), {}
    for i, name in enumerate(names):
        taken = []
        for run in range(runs + 1):
            if run > 1 and time.perf_counter() - began > budget * (i + 1) / len(names):
                break
            start = time.perf_counter()
            with intermediate_tables(spark):
                QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 4)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
