"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from quarry import plans

QUERIES = [
    "bm25_topk", "dense_topk", "rrf_hybrid", "recall_mrr", "parent_expand_budget", "stints_by_user", "interval_merge_credit", "ot_credit_rules", "ledger_full", "person_summary",
    "supersede_facts", "fuzzy_name_pairs", "ledger_diff_exempt", "memory_split", "visibility_filter", "audit_page", "rate_limit_windows", "fixed_window_chunks", "doc_type_vote", "overseas_travel_runs",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = plans.queries()
    found["audit_count"](spark, sf).collect()  # starts the JVM's compilers and the file listing
    took = {}
    for name in QUERIES:
        began = time.time()
        found[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
