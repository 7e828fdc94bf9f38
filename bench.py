"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores) set the run.
Every query runs in full into a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "severe_rate_by_conditions",
    "merged_accidents",
    "nearest_station",
    "join_integrity",
    "cleaned_accidents",
    "engineered_features",
    "admin_features",
    "driver_age_extremes",
    "null_profile",
    "descriptive_stats",
    "check_accuracy",
    "check_consistency",
    "check_uniqueness",
    "pearson_matrix",
    "spearman_matrix",
    "validation_score",
    "full_validation",
    "impute_median_or_unknown",
    "outlier_clip",
    "label_encode",
    "stratified_split",
    "knn_within_class",
    "smote_not_majority",
    "tomek_links",
    "threshold_search",
    "evaluate",
    "drop_unmapped_labels",
    "monthly_rolling_mean",
    "isolation_forest",
    "select_model_based",
    "select_rfecv",
    "logistic_regression",
    "boosted_trees",
    "hyperparameter_search",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tarmac import catalog
    from tarmac.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus=cpus, app="tarmac-bench")
    queries = catalog.queries()
    queries["class_distribution"](spark, sf_dir).collect()  # start workers and load classes
    times = {}
    for name in wanted:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
