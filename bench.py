"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from shelfwright.plans import all_queries
from shelfwright.session import local_session

HEADLINE = [
    "g5_brand_share", "g1_aggregate_inventory", "g9_scan_metrics", "g23_role_dashboards", "g27_brand_plan_share",
    "g34_location_metrics", "j1_planogram_join", "j7_compare_planogram", "j10_price_summary", "j20_match_boxes",
    "b1_non_max_suppression", "w6_shelf_rows", "j22_nearest_vectors", "j28_token_correction", "j29_exact_copies",
    "r5_variance_findings", "r8_due_schedules", "g59_expiry_overview", "t4_opportunity_ledger", "s1_tumbling_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
