"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from graphssl.plans import catalog as C  # noqa: E402
from graphssl.session import ensure_checkpoint_dir, local_session  # noqa: E402

HEADLINE = [
    "class_weights", "group_finished", "relief_weights", "apply_weights", "knn_exact",
    "knn_descent", "degrees", "bisect_3_steps", "bisect_converged", "bisect_lockstep", "split_groups",
    "majority_label", "g_mean", "classify",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    ensure_checkpoint_dir(spark)
    C.base(spark, sf_dir).count()          # warm-up: JVM, Python workers, file listing
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        C.QUERIES[name](spark, sf_dir).collect()
        times[name] = round(time.perf_counter() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
