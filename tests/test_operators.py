"""Building blocks: null-safe anti join, flags, joins without a broadcast, schema validation."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import edge_tables, rows

from cartpulse import schema as S
from cartpulse.operators.orders import cancelled_orders, not_cancelled, with_cancel_flag, with_own_flag
from cartpulse.plans import revenue as R
from cartpulse.sources.tables import DeliveryTables

T0 = dt.datetime(2022, 9, 1, 10, 0)


def test_not_cancelled_drops_null_and_cancelled_ids(spark):
    ua = spark.createDataFrame(
        [
            (1, 10, S.CREATE_ORDER, T0),
            (1, 10, S.CANCEL_ORDER, T0),
            (1, 10, S.CANCEL_ORDER, T0),  # cancelled twice: still one order
            (2, 11, S.CREATE_ORDER, T0),
            (3, None, S.CREATE_ORDER, T0),
        ],
        S.USER_ACTIONS,
    )
    kept = sorted(r["order_id"] for r in not_cancelled(ua, ua).collect())
    assert kept == [11]
    assert sorted(r["order_id"] for r in cancelled_orders(ua).collect()) == [10]
    flags = {r["order_id"]: r["cancelled"] for r in with_cancel_flag(ua, ua).collect()}
    assert flags == {10: True, 11: False, None: False}
    assert with_cancel_flag(ua, ua).count() == ua.count()  # the flag join never multiplies rows


def test_own_flag_equals_the_flag_join(spark):
    rows_ = [(u, o, a, T0 if u else None) for u in (1, 2, None) for o in (10, 11, None) for a in (S.CREATE_ORDER, S.CANCEL_ORDER) if (o, a) != (11, S.CANCEL_ORDER)]
    log = spark.createDataFrame(rows_ * 3, S.USER_ACTIONS)
    own = with_own_flag(log, S.CANCEL_ORDER, "cancelled").collect()
    assert sorted(map(str, own)) == sorted(map(str, with_cancel_flag(log, log).select(*log.columns, "cancelled").collect()))


def test_metrics_equal_when_products_are_not_broadcast(spark):
    t = edge_tables(spark)
    metrics = (R.daily_revenue, R.gross_profit, R.product_revenue_share)
    want = [sorted(metric(t).collect()) for metric in metrics]
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [sorted(metric(t).collect()) for metric in metrics] == want
        assert "SortMergeJoin" in R.daily_revenue(t)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)


def test_conform_validates_and_casts(spark):
    raw = spark.createDataFrame([(1, "x", 12.5, "extra")], "product_id int, name string, price double, junk string")
    conformed = S.conform(raw, S.PRODUCTS, "products")
    assert conformed.columns == ["product_id", "name", "price"]
    assert conformed.schema == S.PRODUCTS
    assert rows(conformed, "price")[0][0] == pytest.approx(12.5)
    with pytest.raises(S.SchemaError, match="missing columns"):
        S.conform(raw.drop("price"), S.PRODUCTS, "products")


def test_members_from_ids_matches_fixture_members(spark, edge, edge_members):
    from cartpulse.operators.campaign import members_from_ids
    from cartpulse.plans import marketing as M

    members = members_from_ids(spark, {1: [1, 4], 2: [3]})
    assert sorted(members.collect()) == sorted(edge_members.collect())
    assert sorted(M.campaign_roi(edge, members).collect()) == sorted(M.campaign_roi(edge, edge_members).collect())


def test_from_paths_reads_any_layout(spark):
    import os

    from cartpulse.session import scratch_dir

    t = edge_tables(spark)
    root = scratch_dir(spark, "paths-test")
    paths = {}
    for name in ("user_actions", "courier_actions", "orders", "products"):
        paths[name] = os.path.join(root, f"custom_{name}")
        getattr(t, name).write.parquet(paths[name])
    read = DeliveryTables.from_paths(spark, **paths)
    assert sorted(R.daily_revenue(read).collect()) == sorted(R.daily_revenue(t).collect())
