"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the number of local threads.
Results are fully computed and thrown away by the noop sink.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ballast.plans import QUERIES  # noqa: E402
from ballast.session import discard_cuts, session  # noqa: E402

HEADLINE = tuple(os.environ["BENCH_ONLY"].split(",")) if os.environ.get("BENCH_ONLY") else (
    "fun_11_reliability", "fun_13_what_if_stress", "fun_20_weather_conditions", "fun_30_canonical_digest",
    "agg_04_clearance_decision", "agg_10_traceability_summary", "agg_13_classifier_metrics", "agg_15_interpolated_percentiles",
    "agg_21_drift_report", "agg_23_regression_metrics", "agg_26_plan_decision", "agg_29_document_checklist",
    "win_01_latest_position", "win_04_chronological_split", "win_08_circuit_states", "join_08_linked_records",
    "join_10_section_overlaps", "join_11_headway_conflicts", "join_12_coarse_slots", "join_16_reading_as_of",
    "prj_13_carriage_manifest", "set_01_audit_union", "gra_01_least_cost_paths", "evaluated_routes",
    "evd_07_baseline_conservative_complete", "evd_13_schedule_reassessment", "evd_01_decision_gate",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        # the bench data is small: keep all threads busy after a shuffle
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="ballast-bench-"),
    })
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["agg_08_group_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }), flush=True)
    discard_cuts(spark)
    spark.stop()


if __name__ == "__main__":
    main()
