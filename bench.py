"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from twintree import queries as core

HEADLINE = (
    "hash_groups_docs", "hash_group_counts_orders", "dup_dirs_orders", "groups_rule2_orders", "groups_rule2_events",
    "tree_listing_events", "diff_flags_2roots", "dedup_groups_orders", "cache_reuse_docs", "dir_sizes_events",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    core.QUERIES["size_groups_docs"](spark, sf_dir).count()  # starts the JVM's compilers
    times = {}
    for name in HEADLINE:
        began = time.time()
        core.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "duplicate-tree headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
