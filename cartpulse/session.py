"""Spark session settings the metrics are written for.

The library never creates a session on its own inside a metric; callers pass
one in.  ``build_session`` is a convenience for tests, the bench and scripts,
and ``scratch_dir`` finds the shared folder where intermediate tables may be
written (``spark.checkpoint.dir``).  No folder is ever made up: a session that
names none can run every metric, and ``scratch_dir`` raises for it.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings that matter at scale.  AQE re-plans every shuffle stage from runtime
# statistics: it turns a sort-merge join into a broadcast join when one side
# turns out small, coalesces the many small shuffle partitions produced by
# day-level aggregates, and splits skewed partitions of large joins (a hot
# user or courier).  Timestamps in the data model are TIMESTAMP_NTZ, so the
# session zone does not change results; UTC is pinned anyway for anything
# that reads zoned timestamps.
SCALE_CONF = {
    # Scan splits of 128 MB; AQE targets 128 MB reduce partitions and only
    # coalesces downwards, so on a cluster ``spark.sql.shuffle.partitions``
    # should be sized for the largest shuffle (shuffle bytes / 128 MB, e.g.
    # 20 000 for 2.5 TB moved by the user-log anti join at 100 TB).
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # Every column expression would note the Python line that made it, several
    # driver round trips each; a metric's plan is built in half the time without.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    master: str = "local[8]",
    shuffle_partitions: int = 8,
    app_name: str = "cartpulse",
    extra_conf: dict | None = None,
) -> SparkSession:
    """Create (or reuse) a session configured for the metrics.

    ``shuffle_partitions`` should be sized so that one shuffle partition
    fits comfortably in an executor task (AQE coalesces small ones); on a
    cluster the cluster's own value is kept when this is not called.
    """
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SCALE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if extra_conf:
        conf.update(extra_conf)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_setting(spark: SparkSession) -> str | None:
    sc = spark.sparkContext
    return sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def has_checkpoint_dir(spark: SparkSession) -> bool:
    """Does the session name a shared checkpoint folder?"""
    return bool(_checkpoint_setting(spark))


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; raises when none is configured.

    On a cluster ``spark.checkpoint.dir`` names a folder that all executors
    reach (HDFS, object store); it is read, never replaced.
    """
    sc = spark.sparkContext
    folder = _checkpoint_setting(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder (that the caller made) wherever Spark can reach it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
