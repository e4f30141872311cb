"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
Every query runs to the end on all its rows (written to Spark's no-op sink), once.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark import InheritableThread  # noqa: E402

from foldguard.plans import REGISTRY  # noqa: E402
from foldguard.session import local_session  # noqa: E402

HEADLINE = [
    # clean, vectorise, features
    "clean_reasons", "shares", "descriptors", "feature_matrix", "fold_local_features",
    # splits
    "holdout_hash", "holdout_exact", "kfold_balanced",
    # metrics and audits
    "mean_baseline", "metrics_by_fold", "macro_mae", "noise_floor", "paired_within_group", "signed_rank",
    "support_triples", "key_collisions", "crossing_summary", "contaminated_test", "fold_median_shift",
    # ranking, screening, uncertainty
    "global_rank", "spearman_predictions", "enrichment", "gains", "coverage_table", "knn_join",
    # candidates and learning
    "candidate_space", "support_sensitivity", "permutation_importance", "ml_cv", "ml_compare",
]


#: A query that takes longer is stopped and reported as null.
LIMIT_S = 700


def timed(spark, name: str, sf_dir: str) -> float | None:
    """Seconds that a query takes, or None if it was stopped."""
    ended = []

    def run() -> None:
        spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        ended.append(time.perf_counter())

    start = time.perf_counter()
    worker = InheritableThread(target=run, daemon=True)
    worker.start()
    worker.join(LIMIT_S)
    while worker.is_alive():  # a query of many jobs starts another once one is stopped
        spark.sparkContext.cancelAllJobs()
        worker.join(1)
    return round(ended[0] - start, 3) if ended else None


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"), spark__ui__showConsoleProgress="false")
    REGISTRY["metrics_by_fold"].build(spark, sf_dir).count()  # starts the JVM's compilers
    times: dict[str, float | None] = {}
    for name in sys.argv[1:] or HEADLINE:
        times[name] = timed(spark, name, sf_dir)
        print(f"{name:28s} {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total", "value": round(sum(t or 0 for t in times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }
    print(json.dumps(line), flush=True)


if __name__ == "__main__":
    main()
