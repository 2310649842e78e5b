"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

from auditloom.session import build_session
from checks import registry

HEADLINE = [
    "window_volume", "window_distinct_counts", "window_feature_vectors", "top_category_schema",
    "sequence_manifest", "sequence_arrays", "inference_sequences", "anchored_events", "merged_labels",
    "audit_events_from_log", "overlap_scores", "alert_intervals", "alert_top_values", "threshold_sweep",
    "binary_metrics", "calibrated_evaluation", "isolation_forest_scores", "log_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=cpus,
        spark__ui__showConsoleProgress="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    times, failed = {}, {}
    for name in HEADLINE:
        start = time.time()
        try:
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        except Exception as error:
            failed[name] = f"{type(error).__name__}: {str(error)[:300]}"
            continue
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        **({"failed": failed} if failed else {})}))
    spark.stop()
    sys.exit(1 if failed else 0)


if __name__ == "__main__":
    main()
