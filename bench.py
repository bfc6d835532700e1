"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

index build, 200K x 50K merge join, bulk insert, many small commits, and log recovery,
beside the same operators over the given tables.  Every query is run once to warm up, then
timed as the best of three; a full result is written to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tarnlake.functions.predicates import Op, cmp, col, const_int  # noqa: E402
from tarnlake.operators.relational import filter_rows, first_per_key, index_entries, lookup_many, merge_join  # noqa: E402
from tarnlake.plans import catalogue, recovery  # noqa: E402
from tarnlake.schema import Schema, TypeId  # noqa: E402
from tarnlake.sources.catalog import Catalog  # noqa: E402
from tarnlake.sources.log import LogManager  # noqa: E402
from tarnlake.sources.transactions import TransactionManager  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ACCOUNTS = Schema([("id", TypeId.INTEGER), ("name", TypeId.VARCHAR)])


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def best(f, times: int = 3) -> float:
    f()
    out = []
    for _ in range(times):
        began = time.perf_counter()
        f()
        out.append(time.perf_counter() - began)
    return round(min(out), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    took: dict[str, float] = {}
    try:
        for name in ("flagship", "count_rows", "filter_int_lt", "filter_and_or", "index_hit", "index_first_wins", "index_lookup_many", "sort_multi", "join_1n", "join_nm", "join_chain", "recover_rows", "recover_stats"):
            took[name] = best(lambda q=catalogue.QUERIES[name]: drain(q(spark, SF_DIR)))

        # shapes of the published numbers
        spark.range(100_000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v")).write.parquet(f"{work}/rows")
        rows = spark.read.parquet(f"{work}/rows")
        took["scan_filter_100k"] = best(lambda: drain(filter_rows(rows, cmp(col(0), Op.EQ, const_int(77_777)))))
        took["index_build_100k"] = best(lambda: drain(index_entries(rows, 0, "k")))
        keys = spark.range(0, 100_000, 2)
        took["lookup_50k_of_100k"] = best(lambda: drain(lookup_many(rows, 0, keys, "k")))
        took["first_per_key_100k"] = best(lambda: drain(first_per_key(rows, 0, "k")))
        spark.range(200_000).select((F.col("id") % 50_000).alias("k"), F.col("id").alias("x")).write.parquet(f"{work}/left")
        spark.range(50_000).select(F.col("id").alias("k"), F.lit("name").alias("n")).write.parquet(f"{work}/right")
        left, right = spark.read.parquet(f"{work}/left"), spark.read.parquet(f"{work}/right")
        took["merge_join_200k_50k"] = best(lambda: drain(merge_join(left, right, 0, 0)))

        number = iter(range(1000))

        def bulk() -> None:
            c = Catalog(spark, f"{work}/bulk{next(number)}")
            c.create_table("accounts", ACCOUNTS)
            c.append("accounts", spark.range(1_000_000).select("id", F.lit("x").alias("name")))

        took["bulk_insert_1m"] = best(bulk)

        def commit_10k() -> None:
            at = next(number)
            c = Catalog(spark, f"{work}/txn{at}")
            c.create_table("accounts", ACCOUNTS)
            m = TransactionManager(c, LogManager(spark, f"{work}/log{at}"))
            t = m.begin()
            for i in range(10_000):
                m.insert(t, "accounts", (i, "x"))
            m.commit(t)

        took["commit_10k_rows"] = best(commit_10k)

        def commit_each(times: int = 20) -> None:
            at = next(number)
            c = Catalog(spark, f"{work}/txn{at}")
            c.create_table("accounts", ACCOUNTS)
            m = TransactionManager(c, LogManager(spark, f"{work}/log{at}"))
            for i in range(times):
                t = m.begin()
                m.insert(t, "accounts", (i, "y"))
                m.commit(t)

        took["commit_1_row_20_times"] = best(commit_each, 1)

        indexed = Catalog(spark, f"{work}/indexed")
        indexed.create_table("accounts", ACCOUNTS)
        indexed.create_index("by_id", "accounts", "id")
        indexed.append("accounts", spark.range(1_000_000).select(((F.col("id") * 7919) % 1_000_000).alias("id"), F.lit("x").alias("name")))
        began = time.perf_counter()
        indexed.index("by_id")
        took["index_layout_1m"] = round(time.perf_counter() - began, 4)
        took["index_scan_1m"] = best(lambda: drain(indexed.lookup("by_id", 777_777)))
        took["filter_scan_1m"] = best(lambda: drain(filter_rows(indexed.table("accounts"), cmp(col(0), Op.EQ, const_int(777_777)))))
        took["index_lookup_50k_of_1m"] = best(lambda: drain(indexed.lookup_many("by_id", spark.range(0, 1_000_000, 20))))

        c = Catalog(spark, f"{work}/recover")
        c.create_table("accounts", ACCOUNTS)
        log = LogManager(spark, f"{work}/log0-recover")
        m = TransactionManager(c, log)
        t = m.begin()
        for i in range(100):
            m.insert(t, "accounts", (i, f"acct_{i}"))
        m.commit(t)
        took["recover_100"] = best(lambda: drain(recovery.recover(c, log.records())[0]))
    finally:
        shutil.rmtree(work, ignore_errors=True)
    ratios = {
        "insert_batching": round(took["commit_1_row_20_times"] / 20 / (took["commit_10k_rows"] / 10_000), 1),
        "index_over_filter": round(took["filter_scan_1m"] / took["index_scan_1m"], 2),
    }
    print(json.dumps({"metric": "total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "ratios": ratios, "sf": SF_DIR.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
