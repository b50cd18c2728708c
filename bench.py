"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], each by the middle one of three runs; one JSON line."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from gavelstream.plans.catalogue import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Single runs of a second or two differ by a fifth.
RUNS = 3
HEADLINE = [f"q{k}" for k in range(23)] + ["q5_many_windows", "q7_rewrite", *(f"q{k}" for k in range(101, 107))]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["q4"](spark, SF_DIR).write.format("noop").mode("overwrite").save()  # start the workers and compile
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(median(runs), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
