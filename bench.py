"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line:
{"metric": "headline_total", "value": sec, "unit": "sec", "queries": {...}, "sf": ...}

Each query is forced to completion with the ``noop`` sink (full plan, no
collect to the driver): one warm-up pass over all of them, then the median of ``$BENCH_RUNS``
(driver side) and the small registry checks.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = ["serve", "vote_quorum_1", "score_python_model", "model_stats",
            "collector_stats", "known_models", "ensemble_embeddings", "decode_good_rows"]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from quorum.plans.catalog import QUERIES
    from quorum.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    # warm the JVM and the Python workers once
    QUERIES["request_ids"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    # warm-up: every headline query once, so all are timed in a steady JVM
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        runs_s = []
        for _ in range(runs):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs_s.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs_s), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
