"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores.
Each query runs once to warm up and is then timed; the result is fully
computed and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vectab.checks import QUERIES  # noqa: E402
from vectab.session import build_session  # noqa: E402

HEADLINE = [
    "search_exact", "search_sbq", "topk_per_group", "best_match_exact", "best_match_ann", "search_ann",
    "knn_graph", "pair_distances", "embed", "compose_text", "token_count", "rule_tags", "upsert",
    "insert_new", "union_last_wins", "csv_scan", "json_scan", "dim_mean", "sbq_encode", "medoid",
    "cluster_spread", "linkage_avg", "project_2d", "density_ball", "dbscan", "declutter_labels",
    "eps_join", "overlap_join", "density_blur", "node_bbox", "ann_follow_search", "search_sbq_stored", "best_match_probe",
    "knn_graph_descent", "window_query_packed", "knn_2d_packed", "greedy_independent_set",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run is the one that counts
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").split("sf")[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
