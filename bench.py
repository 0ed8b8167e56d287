"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the tables (default sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_RUNS: timed runs per query after one warm-up, of which the median counts (default 2).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from farpoint.plans.queries import QUERIES

HEADLINE = [
    "window_status",
    "window_status_wide",
    "window_status_ordered",
    "window_status_keyed",
    "cell_outliers",
    "cell_outliers_wide",
    "status_timeline",
    "parameter_sweep",
    "range_join_mixed",
    "neighbor_counts",
    "neighbor_counts_ordered",
    "pivot_range_join",
    "box_pairs",
    "box_join_regions",
    "tiled_total_hits",
    "kd_partition",
    "bucket_means_minute",
    "first_difference",
    "stream_window_status",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in chosen:
        run(name)
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
