"""Benchmark: every registered metric at $BENCH_SF_DIR on local[$BENCH_CPUS].

1. ``derive``: the delivery tables are derived from the TPC-H-like parquet
   and written once as parquet under the session's checkpoint folder (the
   layout a production job reads).
2. Each registered metric runs over those tables; its result (one row per
   day, hour, campaign, ...) is collected.  Times are wall-clock seconds of
   the best of ``$BENCH_REPEAT`` runs (default 3).

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...};
``value`` is the sum over the registered metrics, ``derive_sec`` the
one-off table derivation (also listed under ``queries``).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartpulse.plans.registry import METRICS, to_boundary  # noqa: E402
from cartpulse.session import build_session, scratch_dir  # noqa: E402
from cartpulse.sources.tpch import materialize_tables  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    spark = build_session(
        master=f"local[{cpus}]",
        shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, 2 * cpus)))),
        app_name="cartpulse-bench",
        extra_conf={
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            # a local run, so a local folder is one that all its tasks share
            "spark.checkpoint.dir": os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="cartpulse-bench-"),
        },
    )

    # Untimed warm-up: JVM class loading and JIT, not part of any query.
    spark.range(200_000).selectExpr("id % 97 AS k").groupBy("k").count().collect()

    timings: dict[str, float] = {}
    out = scratch_dir(spark, "bench-tables")
    t0 = time.perf_counter()
    tables = materialize_tables(spark, sf_dir, out, partitions=spark.sparkContext.defaultParallelism)
    timings["derive"] = time.perf_counter() - t0

    rows: dict[str, int] = {}
    jobs: dict[str, int] = {}
    sc = spark.sparkContext
    for name, metric in METRICS.items():
        best = float("inf")
        for i in range(repeat):
            sc.setJobGroup(f"{name}-{i}", name)
            t0 = time.perf_counter()
            result = to_boundary(metric(spark, sf_dir, tables)).collect()
            best = min(best, time.perf_counter() - t0)
        timings[name] = best
        rows[name] = len(result)
        # Spark jobs of the last run: AQE query stages, broadcasts, size checks.
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(f"{name}-{repeat - 1}"))

    sf_match = re.search(r"sf([0-9.]+)", sf_dir.rstrip("/"))
    metrics_total = sum(v for k, v in timings.items() if k != "derive")
    print(
        json.dumps(
            {
                "metric": "metrics_total_sec",
                "value": round(metrics_total, 3),
                "derive_sec": round(timings["derive"], 3),
                "unit": "sec",
                "queries": {k: round(v, 3) for k, v in timings.items()},
                "rows": rows,
                "jobs": jobs,
                "sf": float(sf_match.group(1)) if sf_match else sf_dir,
                "cpus": cpus,
                "repeat": repeat,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
