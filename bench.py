"""Time the headline queries and print one JSON line.

Every query runs in full into the ``noop`` sink: once to warm up, then
``BENCH_RUNS`` times, of which the fastest counts. ``cold`` are the first runs.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from clientela.plans.catalogue import QUERIES

HEADLINES = [
    "csv_round_trip",
    "addr_clean",
    "addr_missing_patterns",
    "addr_best_prv",
    "null_safe_join",
    "consistency_address",
    "consistency_client",
    "event_clean",
    "touch_opens",
    "touch_open_counts",
    "funnel",
    "funnel_unique_ids",
    "funnel_missing",
    "overview",
    "overview_by_type",
    "flag_share_by_type_opened",
    "dist_num_opens",
    "days_to_open_cumulative",
    "profile_event",
    "levels_event",
    "repurchase_gaps",
    "gap_quantile_90",
    "gap_ecdf",
    "rfm_base",
    "rfm_segments",
    "churn_labels",
    "churn_scores",
    "basket_pairs",
    "basket_rules",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clientela-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    cold = {name: run(name) for name in HEADLINES}
    warm = {name: min(run(name) for _ in range(runs)) for name in HEADLINES}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries, warm",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
