"""Plans that hold at scale: what crosses an exchange, what a scan may skip, how often tables are read."""

from __future__ import annotations

import os
import re
from dataclasses import replace

import pytest
from conftest import SF_SMALL, edge_tables, ts
from pyspark.sql import functions as F

from cartpulse import jobs
from cartpulse import schema as S
from cartpulse.operators.blocks import without_cancelled, write_shared
from cartpulse.operators.joins import left_join_known
from cartpulse.operators.orders import not_in
from cartpulse.operators.prefilter import id_filter, maybe_among
from cartpulse.plans import audience as A
from cartpulse.plans import marketing as M
from cartpulse.plans import revenue as R
from cartpulse.plans.registry import METRICS
from cartpulse.session import scratch_dir
from cartpulse.sources.tables import DeliveryTables
from cartpulse.sources.tpch import campaign_members, derive_tables


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("scale"))
    derive_tables(spark, SF_SMALL).write_parquet(out, mode="overwrite")
    return DeliveryTables.from_parquet(spark, out)


@pytest.fixture(scope="module")
def layout(spark, tables):
    spark.sql("DROP DATABASE IF EXISTS cartpulse_layout CASCADE")
    jobs.write_layout(tables, "cartpulse_layout", 4, files_per_date=2)
    return DeliveryTables.from_catalog(spark, "cartpulse_layout")


@pytest.fixture
def no_broadcast(spark):
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df.select("*")._jdf.queryExecution(), "formatted")


def exchanged(df) -> list[list[str]]:
    """The columns that each shuffle of the plan carries."""
    nodes = re.findall(r"\(\d+\) Exchange.*?\nInput \[\d+\]: \[(.*?)\]\nArguments: (?:hash|range)", formatted(df))
    return [[re.sub(r"#\d+L?", "", c) for c in columns.split(", ")] for columns in nodes]


@pytest.mark.parametrize("name", ["daily_revenue", "gross_profit", "product_revenue_share"])
def test_units_are_counted_below_the_join_to_products(spark, tables, no_broadcast, name):
    carried = [c for c in exchanged(METRICS[name](spark, SF_SMALL, tables)) if "product_id" in c]
    lines = [c for c in carried if "price" not in c]
    assert lines and all("count" in c or "units" in c or "sum" in c for c in lines), carried


@pytest.mark.parametrize("name", ["campaign_roi", "campaign_avg_check", "campaign_payback", "campaign_payback_day"])
def test_orders_of_others_are_dropped_at_the_scan(spark, tables, no_broadcast, name):
    df = METRICS[name](spark, SF_SMALL, tables)
    assert not [c for c in exchanged(df) if "product_ids" in c]
    text = formatted(df)
    # the filter of member order ids is joined below the explode
    tree = text[: text.index("\n\n")]
    assert re.search(r"Generate.*\n.*Project.*\n.*BroadcastHashJoin Inner BuildRight", tree) or re.search(r"Generate[^\n]*\n[^\n]*\n?[^\n]*BroadcastHashJoin", tree), tree


def test_filter_keeps_all_matches_and_few_others(spark):
    ids = spark.range(0, 20_000, 7).withColumnRenamed("id", "order_id")
    orders = spark.range(200_000).select(F.col("id").alias("order_id"), F.lit("x").alias("_hash"), F.lit(1).alias("_bits"))
    left = maybe_among(orders, ids, "order_id", words=4096)
    assert left.columns == orders.columns
    kept = {r.order_id for r in left.collect()}
    assert set(range(0, 20_000, 7)) <= kept and len(kept) < 0.05 * 200_000
    assert id_filter(ids, "order_id", 16).count() == 16
    full = maybe_among(orders, orders.select("order_id"), "order_id", words=2)
    assert full.count() == 200_000  # far too many ids: everything passes
    none = ids.filter("order_id < 0")
    assert maybe_among(orders.unionByName(orders.limit(1).withColumn("order_id", F.lit(None).cast("long"))), none, "order_id").count() == 0


def test_payback_takes_few_jobs(spark, tables):
    sc = spark.sparkContext
    members = campaign_members(spark, SF_SMALL)
    M.campaign_payback(tables, members).collect()
    sc.setJobGroup("payback", "payback")
    try:
        M.campaign_payback(tables, members).collect()
        # query stages and broadcasts; the filter of member order ids is two of them
        assert len(sc.statusTracker().getJobIdsForGroup("payback")) <= 19
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.mark.parametrize("name", ["weekday_arpu", "campaign_avg_check", "campaign_retention"])
def test_report_windows_prune_partitions(spark, layout, name):
    text = formatted(METRICS[name](spark, SF_SMALL, layout))
    pruned = [p for p in re.findall(r"PartitionFilters: \[(.*?)\]\n", text) if "on_date" in p]
    assert pruned and all("<=" in p or "isnotnull" in p for p in pruned), text


def test_all_metrics_equal_on_the_layout(spark, tables, layout):
    assert set(layout.by_date) == {"user_actions", "courier_actions", "orders"}
    for name in ("weekday_arpu", "campaign_avg_check", "campaign_retention", "new_user_revenue", "gross_profit"):
        assert sorted(METRICS[name](spark, SF_SMALL, layout).collect()) == sorted(METRICS[name](spark, SF_SMALL, tables).collect()), name


def test_files_per_date_are_bounded(spark, layout):
    files = spark.table("cartpulse_layout.user_actions_by_date").select("on_date", F.input_file_name().alias("f")).distinct()
    assert files.groupBy("on_date").count().agg(F.max("count")).first()[0] <= 2


def test_window_ends_are_inclusive(spark, layout, tables):
    import datetime as dt

    start, end = dt.date(2022, 8, 28), dt.date(2022, 8, 30)
    for t in (layout, tables):
        days = {r[0] for r in t.between("user_actions", start, end).select(F.to_date("time")).distinct().collect()}
        assert days == {start, dt.date(2022, 8, 29), end}
        assert t.between("user_actions", None, None).count() == tables.user_actions.count()
        late = dt.datetime(2022, 8, 30, 12, 0)
        assert t.between("orders", late, late).columns == ["order_id", "creation_time", "product_ids"]
        expected = tables.user_actions.filter(F.col("time") <= F.lit("2022-08-30 12:00:00").cast("timestamp_ntz")).count()
        assert t.between("user_actions", None, late).count() == expected


def with_nulls(tables):
    """A third of the user log without an order id."""
    extra = tables.user_actions.filter("action = 'create_order' AND order_id % 2 = 0").withColumn("order_id", F.lit(None).cast("long"))
    return DeliveryTables(tables.user_actions.unionByName(extra), tables.courier_actions, tables.orders, tables.products)


def test_null_order_ids_stay_out_of_the_exchange(spark, tables, no_broadcast):
    t = with_nulls(tables)
    log = t.user_actions.repartition(8)
    share = log.filter("order_id IS NULL").count() / log.count()
    assert share > 0.3
    totals = tables.orders.select("order_id", F.lit(1).alias("one"))
    joined = left_join_known(log, totals, "order_id")
    assert joined.count() == log.count() and joined.filter("one IS NULL").count() == log.filter("order_id IS NULL").count()
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.2 * log.count()
    for name in ("weekday_arpu", "new_user_revenue", "hourly_cancel_rate"):
        text = formatted(METRICS[name](spark, SF_SMALL, t))
        assert "LeftOuter" not in text or "isnotnull(order_id" in text, name


def test_metrics_with_a_third_of_the_log_null(spark, tables):
    """Rows without an order make users active, not paying, and bring no revenue."""
    t = with_nulls(tables)
    for name in ("new_user_revenue", "daily_revenue", "hourly_cancel_rate", "campaign_payback"):
        assert sorted(METRICS[name](spark, SF_SMALL, t).collect()) == sorted(METRICS[name](spark, SF_SMALL, tables).collect()), name
    assert sorted(R.weekday_arpu(t).collect()) == sorted(R.weekday_arpu(tables).collect())


def test_new_user_revenue_keeps_the_order_buckets(spark, layout):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = METRICS["new_user_revenue"](spark, SF_SMALL, layout).select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "Exchange hashpartitioning(order_id" not in text, text


@pytest.mark.parametrize("name", ["daily_arpu", "running_arpu", "weekday_arpu"])
def test_orders_are_counted_from_their_totals(spark, tables, name):
    plan = METRICS[name](spark, SF_SMALL, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan.lower()


def test_run_job_reads_the_large_tables_few_times(spark, tables, monkeypatch):
    root = scratch_dir(spark, "scan-count")
    tables.write_parquet(os.path.join(root, "t"))
    t = DeliveryTables.from_parquet(spark, os.path.join(root, "t"))
    members = campaign_members(spark, SF_SMALL)
    scans: dict[str, int] = {}
    from pyspark.sql.readwriter import DataFrameWriter

    save, parquet = DataFrameWriter.save, DataFrameWriter.parquet

    def note(df):
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
        for i in range(leaves.size()):
            files = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, leaves.apply(i)).inputFiles()
            for table in ("user_actions", "courier_actions", "orders", "products"):
                scans[table] = scans.get(table, 0) + any(f"/t/{table}.parquet/" in f for f in files)

    monkeypatch.setattr(DataFrameWriter, "save", lambda self, *a, **k: (note(self._df), save(self, *a, **k))[1])
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (note(self._df), parquet(self, *a, **k))[1])
    names = jobs.run_job(spark, t, os.path.join(root, "out"), members=members)
    assert len(names) == 23
    assert scans["user_actions"] <= 4 and scans["courier_actions"] <= 3 and scans["orders"] <= 6, scans
    assert not [d for d in os.listdir(os.path.dirname(root)) if d.startswith("shared-blocks")]
    for name in names:
        got = spark.read.parquet(os.path.join(root, "out", name)).collect()
        needs = jobs.METRIC_FUNCTIONS[name][1]
        assert sorted(map(str, got)) == sorted(map(str, jobs.run_metric(name, t, members if needs else None).collect())), name


def test_shared_blocks_on_hand_made_rows(spark, edge, edge_members):
    extra = [(7, None, S.CREATE_ORDER, ts("2022-08-29 08:00")), (None, 104, S.CREATE_ORDER, ts("2022-08-29 09:00")), (1, 101, S.CREATE_ORDER, ts("2022-08-30 11:00"))]
    t = edge_tables(spark, extra_user_actions=extra)
    shared = write_shared(t, scratch_dir(spark, "edge-blocks"))
    for name, (fn, needs) in jobs.METRIC_FUNCTIONS.items():
        args = [edge_members] if needs else []
        assert sorted(map(str, fn(shared, *args).collect())) == sorted(map(str, fn(t, *args).collect())), name


NOT_IN = "SELECT order_id, n FROM probe_rows WHERE order_id NOT IN (SELECT order_id FROM id_set)"


@pytest.mark.parametrize("ids", [[], [1], [1, 1, 2], [None], [None, 1], [7]])
def test_not_in_equals_sql(spark, ids):
    probe = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (None, "e"), (3, None)], "order_id long, n string")
    listed = spark.createDataFrame([(i,) for i in ids], "order_id long")
    probe.createOrReplaceTempView("probe_rows")
    listed.createOrReplaceTempView("id_set")
    assert sorted(map(str, not_in(probe, listed).collect())) == sorted(map(str, spark.sql(NOT_IN).collect()))


def test_null_keys_are_dropped_at_the_scan(spark, tables, no_broadcast):
    t = replace(tables, exact_not_in=True)
    text = formatted(without_cancelled(t, t.orders))
    assert "LeftAnti" in text and "isNullAwareAntiJoin=true" not in text
    below = text[: text.index("\n\n")].split("LeftAnti")[1].split("Exchange")[1]
    assert "Filter" in below  # the facts' test is below the exchange of the probed rows


def _with_log(t, rows, drop_cancels=False):
    log = t.user_actions.filter("action <> 'cancel_order'") if drop_cancels else t.user_actions
    extra = t.spark.createDataFrame(rows, S.USER_ACTIONS)
    return replace(t, user_actions=log.unionByName(extra), exact_not_in=True)


def test_a_null_among_the_cancelled_ids_leaves_nothing_paid(spark, edge, edge_members):
    t = _with_log(edge, [(9, None, S.CANCEL_ORDER, ts("2022-08-31 10:00"))])
    assert R.daily_revenue(t).count() == 0 and M.campaign_cac(t, edge_members).count() == 0
    assert A.order_frequency_shares(t).count() == 0 and A.delivery_time(t).count() == 0
    assert {r.paying_users for r in A.active_audience(t).collect()} <= {0}
    shared = write_shared(t, scratch_dir(spark, "null-cancel"))
    assert R.daily_revenue(shared).count() == 0 and M.paying_members(shared, edge_members).count() == 0


def test_without_cancellations_rows_without_an_order_pay(spark, edge, edge_members):
    rows = [(1, None, S.CREATE_ORDER, ts("2022-08-30 12:00")), (8, None, S.CREATE_ORDER, ts("2022-08-30 13:00"))]
    none = [r for r in A.active_audience(_with_log(edge, rows)).collect()]
    some = [r for r in A.active_audience(_with_log(edge, rows, drop_cancels=True)).collect()]
    day = ts("2022-08-30 00:00").date()
    payers = lambda found: {r.date: r.paying_users for r in found}[day]
    assert payers(some) == payers(none) + 1  # user 8 pays by NOT IN's rule for an empty set; user 1 paid anyway
