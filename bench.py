"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelforge import catalog  # noqa: E402
from panelforge.session import local_session  # noqa: E402

HEADLINE = [
    "q1_quality_report_lineitem",
    "q2_describe_lineitem",
    "p1_stratified_sample_orders",
    "c1_to_c7_cleaned_panel",
    "f10_feature_build",
    "o1_zscore_lineitem",
    "o2_quantile_fence_by_flag",
    "o4_lof_filter_embeddings",
    "t4_power_grid_fit_lineitem",
    "d3_shape_report_lineitem",
    "d6_optimal_transform_panel",
    "r1_pearson_lineitem",
    "r2_spearman_part",
    "r3_kendall_customer",
    "r4_distance_correlation_customer",
    "m3_component_scores_embeddings",
    "m5_kmeans_embeddings",
    "m6_dbscan_embeddings",
    "m9_silhouette_embeddings",
    "m10_davies_bouldin_embeddings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    # start the JVM and Python workers outside the timings
    queries["r1_pearson_lineitem"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
