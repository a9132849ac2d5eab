"""Per-stage timings of one registered metric, from Spark's event log.

Usage: python tools/stage_profile.py <metric|derive> [sf_dir]

The event log is written to a new scratch folder (no UI or server is
started).  Prints each stage of the second (warm) run: tasks, start offset,
duration, executor run and CPU time, and the slowest operators' names.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import zstandard  # noqa: E402

from cartpulse.plans.registry import METRICS, to_boundary  # noqa: E402
from cartpulse.session import build_session  # noqa: E402
from cartpulse.sources.tables import DeliveryTables  # noqa: E402
from cartpulse.sources.tpch import derive_tables  # noqa: E402


def read_events(folder: str) -> list[dict]:
    events = []
    for f in sorted(glob.glob(os.path.join(folder, "eventlog_v2_*", "events_*"))):
        with open(f, "rb") as fh:
            raw = fh.read()
        if f.endswith(".zstd"):
            raw = zstandard.ZstdDecompressor().stream_reader(raw).read()
        events.extend(json.loads(line) for line in raw.decode().splitlines() if line)
    return events


def main() -> None:
    name = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    ev = tempfile.mkdtemp(prefix="run-evlog-")
    spark = build_session(
        shuffle_partitions=16,
        extra_conf={"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + ev},
    )
    spark.range(100_000).selectExpr("id % 7 AS k").groupBy("k").count().collect()
    out = tempfile.mkdtemp(prefix="run-tables-")
    sc = spark.sparkContext
    if name == "derive":
        sc.setJobGroup("profiled", "profiled")
        t0 = time.time()
        derive_tables(spark, sf_dir).write_parquet(out + "/t", partitions=sc.defaultParallelism)
        wall = time.time() - t0
    else:
        derive_tables(spark, sf_dir).write_parquet(out + "/t", partitions=sc.defaultParallelism)
        tables = DeliveryTables.from_parquet(spark, out + "/t")
        to_boundary(METRICS[name](spark, sf_dir, tables)).collect()
        sc.setJobGroup("profiled", "profiled")
        t0 = time.time()
        to_boundary(METRICS[name](spark, sf_dir, tables)).collect()
        wall = time.time() - t0
    spark.stop()

    events = read_events(ev)
    jobs = [
        e for e in events
        if e["Event"] == "SparkListenerJobStart" and e.get("Properties", {}).get("spark.jobGroup.id") == "profiled"
    ]
    stage_ids = {s for j in jobs for s in j["Stage IDs"]}
    start = min(j["Submission Time"] for j in jobs)
    print(f"{name}: wall {wall:.2f}s, {len(jobs)} jobs")
    for e in events:
        if e["Event"] != "SparkListenerStageCompleted":
            continue
        si = e["Stage Info"]
        if si["Stage ID"] not in stage_ids or "Submission Time" not in si:
            continue
        acc = {a.get("Name"): a.get("Value") for a in si.get("Accumulables", [])}
        run = acc.get("internal.metrics.executorRunTime", 0)
        cpu = int(acc.get("internal.metrics.executorCpuTime", 0) or 0) // 1_000_000
        print(
            f"  stage {si['Stage ID']:4d} tasks {si['Number of Tasks']:4d} "
            f"start {si['Submission Time'] - start:6d}ms dur {si['Completion Time'] - si['Submission Time']:6d}ms "
            f"run {run:6}ms cpu {cpu:6}ms  {si['Stage Name'][:40]}"
        )


if __name__ == "__main__":
    main()
