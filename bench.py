"""Time the queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run to the end into Spark's no-op sink, after a warm-up job. All queries are timed;
names given as arguments, or ``headline`` for a shorter list, replace that.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from screenfunnel.queries import REGISTRY  # noqa: E402
from screenfunnel.session import local_session  # noqa: E402

HEADLINE = [
    "library_funnel", "best_offer", "priced_parts", "budget_pairs", "budget_pairs_probe", "budget_pairs_preflight",
    "cheapest_per_key", "most_complete_per_key", "first_nonblank", "unique_names", "range_filter_rejected",
    "range_filter_accepted", "rule_set_violations", "alert_screen_two_tier", "assay_median_mean", "assay_outer_summary",
    "assay_attach", "task_grid", "task_check", "pending_tasks", "attach_labels", "rank_normalise", "composite_score",
    "winnow_topk", "budget_cascade", "top_n_per_group", "group_representative", "group_summary", "pose_spread", "best_pose",
    "pivot_scores", "contacts", "geometric_score", "final_ranking", "histogram", "column_profile", "scaled_distance_ad",
    "stratify_bins", "stratified_split", "desirability", "sdf_records", "offers_scan", "dock_log_poses", "pose_atoms",
    "superpose", "cluster_shortlist", "forest_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or ["all"]
    if names == ["all"]:
        names = list(REGISTRY)
    elif names == ["headline"]:
        names = HEADLINE
    spark = local_session(cpus, "bench", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    warm = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    warm.groupBy("l_suppkey").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "screening funnel queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
