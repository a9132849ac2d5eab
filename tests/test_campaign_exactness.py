"""Campaign metrics on inputs that the test tables don't have: large prices, cents,
repeated members, unknown prices, campaigns without a spend."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from cartpulse import params as P
from cartpulse import schema as S
from cartpulse.operators.campaign import campaign_dim, members_side
from cartpulse.plans import marketing as M
from cartpulse.plans.audience import hourly_cancel_rate
from cartpulse.sources.tables import DeliveryTables

DAY = dt.datetime(2022, 9, 1, 10, 0)


def tables(spark, orders, products) -> DeliveryTables:
    """orders: (order id, user, products)."""
    return DeliveryTables(
        spark.createDataFrame([(u, o, S.CREATE_ORDER, DAY) for o, u, _ in orders], S.USER_ACTIONS),
        spark.createDataFrame([], S.COURIER_ACTIONS),
        spark.createDataFrame([(o, DAY, p) for o, _, p in orders], S.ORDERS),
        spark.createDataFrame(products, S.PRODUCTS),
    )


def members(spark, *pairs):
    return spark.createDataFrame(list(pairs), "ads_campaign int, user_id bigint")


def values(df) -> list[tuple]:
    return [tuple(float(x) if isinstance(x, Decimal) else x for x in r) for r in df.collect()]


def test_means_of_large_checks_do_not_wrap(spark):
    t = tables(spark, [(1, 1, [1]), (2, 2, [2])], [(1, "a", Decimal("9300000.00")), (2, "b", Decimal("100.00"))])
    got = values(M.campaign_avg_check(t, members(spark, (1, 1), (1, 2))))
    assert got == [("Кампания № 1", 4650050.0)]


def test_spend_keeps_its_cents(spark):
    t = tables(spark, [(1, 1, [1]), (2, 2, [1])], [(1, "a", Decimal("100.00"))])
    side = members(spark, (1, 1), (1, 2))
    assert values(M.campaign_cac(t, side, P.Campaigns({1: Decimal("250000.75")}))) == [("Кампания №1", 125000.38)]
    assert values(M.campaign_cac(t, side, P.Campaigns({1: "250000.75"}))) == [("Кампания №1", 125000.38)]
    with pytest.raises(ValueError, match="campaign 1"):
        campaign_dim(spark, {1: "0.001"})


def test_members_are_a_set(spark):
    t = tables(spark, [(1, 1, [1])], [(1, "a", Decimal("100.00"))])
    side = members(spark, (1, 1), (1, 1), (1, None))
    spend = P.Campaigns({1: 1000})
    assert members_side(side).count() == 1
    assert values(M.campaign_roi(t, side, spend)) == [("Кампания № 1", -90.0)]
    assert values(M.campaign_avg_check(t, side)) == [("Кампания № 1", 100.0)]
    assert values(M.campaign_payback(t, side, spend)) == [("Кампания № 1", 0, 100.0, 1000.0)]


def test_a_user_without_prices_has_no_mean(spark):
    t = tables(spark, [(1, 1, [1]), (2, 2, [2])], [(1, "a", Decimal("100.00")), (2, "b", None)])
    assert values(M.campaign_avg_check(t, members(spark, (1, 1), (1, 2)))) == [("Кампания № 1", 100.0)]


def test_mean_per_order(spark):
    t = tables(spark, [(1, 1, [1]), (2, 1, [1]), (3, 2, [2])], [(1, "a", Decimal("100.00")), (2, "b", Decimal("400.00"))])
    side = members(spark, (1, 1), (1, 2))
    assert values(M.campaign_avg_check(t, side)) == [("Кампания № 1", 250.0)]
    assert values(M.campaign_avg_check(t, side, per_order=True)) == [("Кампания № 1", 200.0)]


def test_a_campaign_without_spend_keeps_its_rows(spark):
    t = tables(spark, [(1, 1, [1]), (2, 2, [1])], [(1, "a", Decimal("100.00"))])
    side, spend = members(spark, (1, 1), (3, 2)), P.Campaigns({1: 1000})
    assert sorted(values(M.campaign_cac(t, side, spend))) == [("Кампания №1", 1000.0), ("Кампания №3", None)]
    assert sorted(values(M.campaign_roi(t, side, spend))) == [("Кампания № 1", -90.0), ("Кампания № 3", None)]
    assert sorted(values(M.campaign_payback(t, side, spend))) == [("Кампания № 1", 0, 100.0, 1000.0), ("Кампания № 3", 0, 100.0, None)]
    given = M.campaign_payback(t, side, spend, payers={1: 2})
    assert sorted(values(given)) == [("Кампания № 1", 0, 50.0, 500.0), ("Кампания № 3", 0, None, None)]


def test_successful_orders_may_have_to_be_delivered(spark):
    ua = [(1, o, S.CREATE_ORDER, DAY) for o in (1, 2, 3)] + [(1, 3, S.CANCEL_ORDER, DAY)]
    t = DeliveryTables(
        spark.createDataFrame(ua, S.USER_ACTIONS),
        spark.createDataFrame([(7, 1, S.DELIVER_ORDER, DAY)], S.COURIER_ACTIONS),
        spark.createDataFrame([(o, DAY, [1]) for o in (1, 2, 3)], S.ORDERS),
        spark.createDataFrame([(1, "a", Decimal("1.00"))], S.PRODUCTS),
    )
    assert values(hourly_cancel_rate(t)) == [(10, 2, 1, 0.333)]
    assert values(hourly_cancel_rate(t, delivered_only=True)) == [(10, 1, 1, 0.5)]
