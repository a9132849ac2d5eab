"""Physical-plan checks: no nested-loop or cartesian joins (except the
one-row total of the product share), no Python evaluation, filters and
column pruning reach the parquet scan."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from cartpulse.jobs import METRIC_FUNCTIONS
from cartpulse.plans.registry import METRICS
from cartpulse.sources.tables import DeliveryTables
from cartpulse.sources.tpch import derive_tables

FORBIDDEN = ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas")


def plan_text(df) -> str:
    """The physical plan that ran (AQE's final plan once the query executed)."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    return plan.toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    derive_tables(spark, SF_SMALL).write_parquet(out, mode="overwrite")
    return DeliveryTables.from_parquet(spark, out)


@pytest.mark.parametrize("name", sorted(METRICS))
def test_no_forbidden_operators(spark, tables, name):
    df = METRICS[name](spark, SF_SMALL, tables)
    df.collect()  # final adaptive plan
    text = plan_text(df)
    for op in FORBIDDEN:
        assert op not in text, f"{name}: {op}"
    nested = text.count("BroadcastNestedLoopJoin")
    allowed = 1 if name == "product_revenue_share" else 0
    assert nested <= allowed, f"{name}: {nested} nested-loop joins"


def test_not_in_is_not_null_aware_broadcast(spark, tables):
    # The anti join must be a plain equi anti join (sort-merge or size-based
    # broadcast), never the null-aware form that always broadcasts.
    df = METRICS["daily_revenue"](spark, SF_SMALL, tables)
    text = df._jdf.queryExecution().sparkPlan().toString()
    assert "LeftAnti" in text
    assert "isNullAwareAntiJoin=true" not in text and "NullAware" not in text.replace("isNullAwareAntiJoin=false", "")


def test_scan_prunes_columns_and_pushes_filters(spark, tables):
    df = METRICS["daily_revenue"](spark, SF_SMALL, tables)
    df.collect()
    text = plan_text(df)
    # the cancelled-order side reads two columns and pushes the action filter
    assert "ReadSchema: struct<order_id:bigint,action:string>" in text
    assert "EqualTo(action,cancel_order)" in text
    # the order side reads only what the metric needs
    assert "ReadSchema: struct<order_id:bigint,creation_time:timestamp_ntz,product_ids:array<bigint>>" in text


def test_window_without_partition_only_on_day_rows(spark, tables):
    # Unpartitioned windows are only applied after aggregation to days.
    df = METRICS["daily_revenue"](spark, SF_SMALL, tables)
    text = plan_text(df)
    window_at = text.find("Window [")
    agg_at = text.find("HashAggregate", window_at)
    assert window_at >= 0 and agg_at > window_at


def test_bucketed_tables_join_on_order_id_without_shuffle(spark, tables):
    db = "cartpulse_bucket_test"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    tables.write_bucketed(db, buckets=4, mode="overwrite")
    bucketed = DeliveryTables.from_catalog(spark, db)
    from cartpulse.operators.orders import not_cancelled

    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = not_cancelled(bucketed.orders, bucketed.user_actions)
        df.collect()
        text = plan_text(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
    assert "SortMergeJoin" in text and "LeftAnti" in text
    assert "Exchange" not in text
    # and the same metric result as the plain tables
    assert sorted(METRICS["daily_revenue"](spark, SF_SMALL, bucketed).collect()) == sorted(
        METRICS["daily_revenue"](spark, SF_SMALL, tables).collect()
    )


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_report_windows_reach_the_scan(spark, tables):
    from cartpulse.plans import marketing as M
    from cartpulse.plans import revenue as R
    from cartpulse.sources.tpch import campaign_members

    weekday = formatted(R.weekday_arpu(tables))
    assert "GreaterThanOrEqual(creation_time,2022-08-26T00:00)" in weekday
    assert "LessThanOrEqual(time,2023-09-08T23:59:59.999)" in weekday
    week = formatted(M.campaign_avg_check(tables, campaign_members(spark, SF_SMALL)))
    assert "GreaterThanOrEqual(time,2022-09-01T00:00), LessThan(time,2022-09-08T00:00)" in week


def test_building_metrics_and_views_starts_no_job(spark, tables):
    from cartpulse.jobs import register_views
    from cartpulse.sources.tpch import campaign_members

    members = campaign_members(spark, SF_SMALL)
    sc = spark.sparkContext
    sc.setJobGroup("lazy", "lazy")
    try:
        register_views(spark, tables, members, prefix="lazy_")
        for name in METRICS:
            METRICS[name](spark, SF_SMALL, tables)
        # reading a parquet schema is a job of its own, and campaign_members reads one per call
        assert len(sc.statusTracker().getJobIdsForGroup("lazy")) <= sum(needs for _, needs in METRIC_FUNCTIONS.values())
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def executed(spark, df) -> str:
    """The final plan with broadcasts off, exchanges that are reused printed once."""
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


@pytest.mark.parametrize(
    ("name", "scans", "explodes"),
    # new-user revenue reads the log's rows without an order id apart (IS NULL, skipped by row-group statistics)
    [("active_audience", 2, 0), ("courier_load", 3, 0), ("running_arpu", 4, 1), ("new_user_revenue", 5, 1), ("retention", 1, 0)],
)
def test_large_tables_are_read_once(spark, tables, name, scans, explodes):
    text = executed(spark, METRICS[name](spark, SF_SMALL, tables))
    assert text.count("FileScan parquet") <= scans, text
    assert text.count("Generate explode") == explodes, text


def test_retention_shuffles_the_log_once(spark, tables):
    text = executed(spark, METRICS["retention"](spark, SF_SMALL, tables))
    assert text.count("Exchange hashpartitioning(user_id") == 1


def test_all_metrics_equal_on_bucketed_tables(spark, tables):
    db = "cartpulse_bucket_all"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {db}")
    tables.write_bucketed(db, buckets=4, mode="overwrite")
    bucketed = DeliveryTables.from_catalog(spark, db)
    for name, metric in METRICS.items():
        plain = sorted(metric(spark, SF_SMALL, tables).collect())
        assert sorted(metric(spark, SF_SMALL, bucketed).collect()) == plain, name
