"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query is run until its whole result is computed (``noop`` sink) three
times after one warm-up; the reported time is the median. The fixture views
are stored once beforehand (like the persisted predictions table a production
job reads) and their build time is reported separately.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskspark.plans.registry import QUERIES  # noqa: E402
from riskspark.session import build_session  # noqa: E402
from riskspark.sources import fixtures as fx  # noqa: E402

HEADLINE = [
    "tl_basel", "tl_decile_statistical", "tl_range_midpoint", "tl_probability_bins",
    "evaluate_models", "auc_roc", "psi_pooled", "psi_fixed", "population_stability",
    "missing_profile", "iqr_outliers", "correlation_pairs", "preprocess",
    "stratified_split", "time_series_splits",
    "ks_compare", "evaluate_quality", "metric_correlations", "psi_monitor_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    t0 = time.time()
    for name in ("loans", "scored", "scored_split", "populations", "real_vs_synth", "loans_dirty"):
        fx.stored(spark, sf_dir, name)
    fixtures_sec = time.time() - t0
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()   # warm-up
        runs = []
        for _ in range(reps):
            t = time.time()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - t)
        times[name] = round(statistics.median(runs), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
        "fixtures_build_sec": round(fixtures_sec, 3),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
