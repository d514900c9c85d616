"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pulsegrid.plans import QUERIES  # noqa: E402
from pulsegrid.session import local_session  # noqa: E402

HEADLINE = (
    "W10_episodes", "S3_paged_range_read", "S5_exposition_source", "S13_manifest_scan", "J6_asof_join", "J7_interval_join", "J16_diagnosis_lookup",
    "A1_label_aggregates", "A5_robust_center_scale", "A6_quantiles", "A8_psi", "A14_slice_table", "W2_increase", "W6_hysteresis", "W9_open_suppression",
    "W12_hold_for", "W14_plateau", "W19_failure_run", "F24_probe_classification", "M1_fit_baseline", "M4_forest_score", "M10_drift", "R2_CpuEleve",
    "R5_AnomalieAIOps", "E4_detection_match", "E6_grid_calibration", "D1_node_policy", "T1_detector_automaton",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()  # start the engine before the clock
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
