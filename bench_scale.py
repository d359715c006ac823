"""Repeats the given tables, with shifted keys or a hot one, and times queries over them.

BENCH_SF_DIR    folder of the Parquet tables (default /root/testdata/sf0.1)
BENCH_TIMES     how many times the rows are repeated (default 100)
BENCH_HOT       1: a third of the rows of every repeated table get the key 0
BENCH_CPUS, BENCH_QUERIES as in bench.py; the rest is documented there

The repeated tables are written to a new folder under /tmp, so check its space:
sf0.1 a hundred times takes some 4 GB. Prints one line of JSON: per query the
better of two times.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallywright import build_session  # noqa: E402
from tallywright.workload import operators, reports  # noqa: E402

# Columns that identify rows or refer to them; each repetition gets its own range.
KEYS = {
    "customer": ["c_custkey"],
    "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey"],
    "events": ["event_id", "user_id"],
    "documents": ["doc_id"],
    "labels": ["doc_id"],
}
TEXT_TABLES = ("documents", "labels")


def repeated(spark: SparkSession, path: str, name: str, times: int, hot: bool) -> DataFrame:
    table = spark.read.parquet(path)
    keys = KEYS.get(name)
    if not keys:
        return table
    times = max(1, times // 10) if name in TEXT_TABLES else times
    many = table.crossJoin(F.broadcast(spark.range(times).withColumnRenamed("id", "_copy")))
    for key in keys:
        shifted = F.col(key) + F.col("_copy") * F.lit(10**9)
        many = many.withColumn(key, F.when(F.xxhash64(*keys, "_copy") % 3 == 0, F.lit(0)).otherwise(shifted) if hot else shifted)
    return many.drop("_copy")


def main() -> None:
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    times, hot = int(os.environ.get("BENCH_TIMES", "100")), os.environ.get("BENCH_HOT") == "1"
    only = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    target = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = build_session(
        "bench_scale",
        f"local[{os.environ.get('BENCH_CPUS', '8')}]",
        {"spark.driver.memory": "16g", "spark.sql.shuffle.partitions": "64", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    for file in sorted(os.listdir(source)):
        repeated(spark, f"{source}/{file}", file.removesuffix(".parquet"), times, hot).write.parquet(f"{target}/{file}")

    def seconds(run) -> float:
        start = time.perf_counter()
        run(spark, target).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    queries = {**operators.QUERIES, **reports.QUERIES}
    found = {name: round(min(seconds(run) for _ in range(2)), 2) for name, run in queries.items() if not only or name in only}
    spark.stop()
    print(json.dumps({"metric": "total_query_time", "value": round(sum(found.values()), 2), "unit": "sec", "queries": found, "times": times, "hot": hot}))


if __name__ == "__main__":
    main()
