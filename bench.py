"""Time the headline queries; prints one JSON line.

The test data has no loan table. It is derived and stored once, as the views expect to
find it; `load_loans` reports that step and the total includes it. Then each query reads
the stored table and is timed twice, the better time counting. Some views first look up the
names of a column by a job of their own; `name_lookups` reports these jobs.

BENCH_SF_DIR names the test data (default /root/testdata/sf0.1), BENCH_CPUS the cores, and
BENCH_BOOK_DIR a folder for the stored table that all executors share (default: a new one of
this machine, since the session is local).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession

from lendscope.operators.categories import coded
from lendscope.plans.catalog import HEADLINE
from lendscope.sources.loans import load_loans, read_loans


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lendscope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def lookups(loans: DataFrame) -> float:
    start = time.perf_counter()
    for column in ("product_type", "channel"):
        coded(loans, column)
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus)
    base = os.environ.get("BENCH_BOOK_DIR")
    with tempfile.TemporaryDirectory(prefix="lendscope-bench-", dir=base) as scratch:
        path = os.path.join(scratch, "loans")
        seconds(HEADLINE["customer_segmentation"](load_loans(spark, sf_dir)))  # warm the JVM up
        start = time.perf_counter()
        load_loans(spark, sf_dir).repartition(int(cpus)).write.parquet(path)
        timings = {"load_loans": round(time.perf_counter() - start, 3)}
        timings["name_lookups"] = round(lookups(read_loans(spark, path)), 3)
        for name, query in HEADLINE.items():
            best = min(seconds(query(read_loans(spark, path))) for _ in range(2))
            timings[name] = round(best, 3)
    report = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
