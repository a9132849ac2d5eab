"""The batch job writes every metric; results equal the direct calls."""

from __future__ import annotations

import os

from conftest import SF_SMALL

from cartpulse import jobs
from cartpulse.plans import marketing as M
from cartpulse.plans import revenue as R
from cartpulse.session import scratch_dir
from cartpulse.sources.tpch import campaign_members, materialize_tables


def test_job_writes_all_metrics(spark):
    root = scratch_dir(spark, "job-test")
    materialize_tables(spark, SF_SMALL, os.path.join(root, "tables"))
    campaign_members(spark, SF_SMALL).write.parquet(os.path.join(root, "members"))
    out = os.path.join(root, "out")
    jobs.main(["--tables", os.path.join(root, "tables"), "--members", os.path.join(root, "members"), "--out", out])
    written = sorted(p for p in os.listdir(out.replace("file:", "")) if not p.startswith("."))
    assert written == sorted(jobs.METRIC_FUNCTIONS)
    from cartpulse.sources.tables import DeliveryTables

    t = DeliveryTables.from_parquet(spark, os.path.join(root, "tables"))
    got = spark.read.parquet(os.path.join(out, "daily_revenue"))
    assert sorted(got.collect()) == sorted(R.daily_revenue(t).collect())
    members = spark.read.parquet(os.path.join(root, "members"))
    got = spark.read.parquet(os.path.join(out, "campaign_payback"))
    assert sorted(got.collect()) == sorted(M.campaign_payback(t, members).collect())


def test_job_without_members_skips_campaign_metrics(spark):
    root = scratch_dir(spark, "job-test2")
    materialize_tables(spark, SF_SMALL, os.path.join(root, "tables"))
    from cartpulse.sources.tables import DeliveryTables

    t = DeliveryTables.from_parquet(spark, os.path.join(root, "tables"))
    names = jobs.run_job(spark, t, os.path.join(root, "out"), fmt="csv")
    assert "campaign_cac" not in names and "daily_revenue" in names


def test_metrics_as_sql_views(spark, edge, edge_members):
    from decimal import Decimal

    names = jobs.register_views(spark, edge, edge_members, prefix="v_")
    assert "v_daily_revenue" in names and "v_campaign_cac" in names
    total = spark.sql("SELECT sum(revenue) AS r FROM v_daily_revenue").first()["r"]
    assert total == Decimal("690")
    first = spark.sql("SELECT min(time) AS d FROM v_user_actions").first()["d"]
    assert str(first).startswith("2022-08-30")


def test_unknown_metric_is_rejected_before_spark_work():
    import pytest

    with pytest.raises(SystemExit):
        jobs.main(["--tables", "/nonexistent", "--out", "/nonexistent-out", "--metrics", "daily_revenu"])
