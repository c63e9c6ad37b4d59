"""Time the headline queries: one warm-up run, then the median of three, into a no-op sink.

BENCH_SF_DIR   tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  names, comma-separated (default: the list below; "all" for every query)
BENCH_RUNS     timed runs (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from wattloom.registry import QUERIES
from wattloom.session import build_session

HEADLINE = [
    "counter_step_energy", "label_job_rollup", "grid_sum_by", "ttl_dedup", "owner_join_fallback",
    "canon_names", "label_feature_join", "join_diagnostics", "resource_sum", "manifest_requests",
    "flat_rows", "encoder_pipeline", "text_embedding", "knn_predict", "knn_partitioned", "group_folds",
    "cv_metrics", "label_builder", "train_rows", "workload_prediction", "score_requests", "stream_ttl_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = build_session(
        "wattloom-bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
