"""Cross-metric invariants on the derived sf0.001 tables."""

from __future__ import annotations

from decimal import Decimal

import pytest
from conftest import SF_SMALL

from cartpulse.plans import audience as A
from cartpulse.plans import marketing as M
from cartpulse.plans import revenue as R
from cartpulse.sources.tpch import derive_tables


@pytest.fixture(scope="module")
def t(spark):
    return derive_tables(spark, SF_SMALL)


def test_total_users_reaches_distinct_users(t):
    growth = A.audience_growth(t).collect()
    users = t.user_actions.select("user_id").distinct().count()
    assert max(r["total_users"] for r in growth if r["total_users"] is not None) == users


def test_product_revenue_sums_to_total_revenue(t):
    shares = R.product_revenue_share(t).collect()
    daily = R.daily_revenue(t).collect()
    assert sum(r["revenue"] for r in shares) == max(r["total_revenue"] for r in daily)
    assert abs(sum(r["share_in_revenue"] for r in shares) - Decimal(100)) < Decimal("1e-9")


def test_new_and_old_revenue_shares_sum_to_100(t):
    for r in R.new_user_revenue(t).collect():
        assert r["new_users_revenue_share"] + r["old_users_revenue_share"] == 100


def test_retention_day_zero_is_one(t):
    for r in M.retention(t).filter("day_number = 0").collect():
        assert r["retention"] == 1


def test_running_gross_profit_is_running_sum(t):
    rows = sorted(R.gross_profit(t).collect(), key=lambda r: r["date"])
    acc = Decimal(0)
    for r in rows:
        acc += r["gross_profit"]
        assert r["total_gross_profit"] == acc


def test_sorted_outputs(t):
    dates = [r["date"] for r in A.active_audience(t).collect()]
    assert dates == sorted(dates)
    hours = [r["hour"] for r in A.hourly_cancel_rate(t).collect()]
    assert hours == sorted(hours)
    revs = [r["revenue"] for r in R.product_revenue_share(t).collect()]
    assert revs == sorted(revs, reverse=True)


def test_every_final_order_by(t, spark):
    from cartpulse.sources.tpch import campaign_members

    members = campaign_members(spark, SF_SMALL)

    def keys(df, *cols):
        return [tuple(r[c] for c in cols) for r in df.collect()]

    for df, cols in [
        (A.order_frequency_shares(t), ("date",)),
        (A.delivery_time(t), ("date",)),
        (R.weekday_arpu(t), ("weekday_number",)),
        (R.new_user_revenue(t), ("date",)),
        (M.campaign_retention(t, members), ("ads_campaign", "day_number")),
        (M.campaign_payback(t, members), ("ads_campaign", "day")),
    ]:
        got = keys(df, *cols)
        assert got == sorted(got), cols
    checks = [r["avg_check"] for r in M.campaign_avg_check(t, members).collect()]
    assert checks == sorted(checks, reverse=True)
