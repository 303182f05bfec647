"""Time the headline queries once warm; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spectraloom.plans import catalogue  # noqa: E402
from spectraloom.session import build_session  # noqa: E402

HEADLINE = [
    "detect_report", "detect_report_cosine", "mahalanobis_to_nearest_type", "roc_auc_overall", "roc_auc_by_group",
    "roc_auc_by_type_shared_negatives", "average_precision_overall", "tpr_at_fpr_last_below", "youden_threshold",
    "bootstrap_auc_interval", "empirical_cdf", "score_summary_by_population", "box_statistics_by_type", "density_histogram",
    "knn_cosine_neighbours", "knn_cosine_by_cells", "knn_cross_validated", "silhouette_cosine", "collapse_statistics",
    "identify_against_registry", "authenticate_packets", "registry_upsert_latest", "segment_event_series",
    "frame_spectrum_of_segments", "matched_background_floor", "intent_features_of_segments", "standardize_within_supplier",
    "cap_rows_per_supplier", "sample_exact_n_large", "positive_pairs_of_types", "replay_tracks_deduplicated",
    "alert_hold_sessions_batch", "sliding_detection_rate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue()
    times = {}
    for name in HEADLINE:
        run = queries[name].run
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm code and file caches
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
