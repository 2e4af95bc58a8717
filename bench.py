"""Time every query once at ``$BENCH_SF_DIR`` and print one JSON line.

Each result is consumed in full by the no-op sink. ``BENCH_KEYS`` may hold key
prefixes, separated by commas, to time some of the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from pyspark.sql import SparkSession

    from riskframe.plans.catalog import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    prefixes = [p for p in os.environ.get("BENCH_KEYS", "").split(",") if p]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("riskframe-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the executors' Python workers and read paths before timing
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    seconds, failed = {}, {}
    for key, (run, _) in catalog().items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        start = time.perf_counter()
        try:
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:  # a broken query must not hide the others
            failed[key] = f"{type(error).__name__}: {str(error)[:200]}"
            continue
        seconds[key] = round(time.perf_counter() - start, 3)
    report = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    if failed:
        report["failed"] = failed
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
