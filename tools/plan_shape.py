"""Plan shape of every metric as it would run on large tables.

Usage: python tools/plan_shape.py [sf_dir]

Automatic size-based broadcasting is turned off (threshold -1) and AQE is
off, so the printed physical plan keeps only the broadcasts the code decides
itself after a size check (products, campaign members, parameter tables):
what a run over tables far above any broadcast limit would do before AQE's
runtime changes.  For each metric: shuffles (hash exchanges), sort-merge
joins, broadcast joins, windows, and the single-partition exchanges (which
must only carry day-level rows).
"""

from __future__ import annotations

import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartpulse.plans.registry import METRICS  # noqa: E402
from cartpulse.session import build_session  # noqa: E402
from cartpulse.sources.tpch import materialize_tables  # noqa: E402

COUNTS = {
    "shuffles": r"Exchange hashpartitioning",
    "sort-merge joins": r"SortMergeJoin",
    "broadcast joins": r"BroadcastHashJoin",
    "windows": r"\bWindow \[",
    "single-partition": r"Exchange SinglePartition",
}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session(shuffle_partitions=8)
    tables = materialize_tables(spark, sf_dir, tempfile.mkdtemp(prefix="run-shape-") + "/t")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    print("| metric | " + " | ".join(COUNTS) + " |")
    print("| --- |" + " --- |" * len(COUNTS))
    for name, metric in METRICS.items():
        plan = metric(spark, sf_dir, tables)._jdf.queryExecution().executedPlan().toString()
        cells = [str(len(re.findall(p, plan))) for p in COUNTS.values()]
        print(f"| `{name}` | " + " | ".join(cells) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
