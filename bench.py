"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from rollbook.plans import catalogue

HEADLINE = ("top_states", "duplicates", "summary", "quality_report", "resolve_identifiers", "ranked_search", "substring_search", "shared_values", "entity_clusters", "change_history", "telemetry_windows", "mined_phrases", "semantic_intent")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.QUERIES["top_states"](spark, d).write.format("noop").mode("overwrite").save()  # warms the session up
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
