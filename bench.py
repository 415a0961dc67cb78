"""Times headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from voltspan.plans import registry

NAMES = ("hierarchy_rollup", "critical_constraints", "two_hop_join", "kpi_abs_avg", "quantile_suite", "error_grouping_sets", "full_outer_delta", "topk_impacts", "scorecard", "interpolate_curve", "event_diff", "catalog_search_page", "metric_statistics", "cascading_match", "merged_page", "components_bipartite", "slot_differences", "overlay_versions", "map_branches", "station_connections", "comparison_preflight")

if __name__ == "__main__":
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up is no query's: one is run unmeasured.
    registry.QUERIES["case_outcomes"](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in NAMES:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
