"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. Every query runs in full into
Spark's no-op sink; the time is the better of two runs after a common warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from gauge_engine.catalog import QUERIES
from gauge_engine.session import build_session

HEADLINE = (
    "daily_rollup",
    "threshold_raw",
    "features",
    "event_flag_own_raw",
    "hist_vector",
    "training_windows",
    "training_windows_segmented",
    "scaler_fit",
    "scaler_apply",
    "index_ids",
    "index_align",
    "split_stratified",
    "split_tail",
    "positional_id",
    "melt_matrix",
    "prepare_dataset",
    "interval_eval",
    "auc_bucketed",
    "scores",
    "plugin_score",
    "plugin_horizon",
    "interval_readings",
    "prepare_listed",
    "forecast_pipeline",
)
RUNS = 2
# These keep what they fit for later queries of the session: only their first run counts.
ONCE = {"forecast_pipeline"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "gauge_engine-bench",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="gauge-engine-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds: dict[str, float] = {}
    for name in names:
        best = float("inf")
        for _ in range(1 if name in ONCE else RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        seconds[name] = round(best, 3)
    spark.stop()
    result = {
        "metric": "headline queries, total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
