"""Every metric on hand-made edge rows, against results worked out by hand
(FIXTURES.md section 3)."""

from __future__ import annotations

from decimal import Decimal

from conftest import D, d, rows

from cartpulse import params as P
from cartpulse.plans import audience as A
from cartpulse.plans import marketing as M
from cartpulse.plans import readouts as R2
from cartpulse.plans import revenue as R

SPEND = P.Campaigns(spend={1: 1000, 2: 1000})


def by_date(result):
    return sorted(result, key=lambda r: r[0])


def test_audience_growth_full_join_keeps_gaps(edge):
    got = by_date(rows(A.audience_growth(edge), "date", "new_users", "new_couriers", "total_users", "total_couriers"))
    assert got == [
        (d("2022-08-30"), 2, 1, 2, 1),
        (d("2022-08-31"), 1, None, 3, None),
        (d("2022-09-01"), 1, 1, 4, 2),
    ]


def test_audience_growth_rates(edge):
    cols = ("date", "new_users_change", "new_couriers_change", "total_users_growth", "total_couriers_growth")
    got = by_date(rows(A.audience_growth_rates(edge), *cols))
    assert got == [
        (d("2022-08-30"), None, None, None, None),
        (d("2022-08-31"), D("-50.00"), None, D("50.00"), None),
        (d("2022-09-01"), D("0.00"), None, D("33.33"), None),
    ]


def test_active_audience_inner_joins_drop_dates(edge):
    cols = ("date", "paying_users", "active_couriers", "paying_users_share", "active_couriers_share")
    got = rows(A.active_audience(edge), *cols)
    assert got == [
        (d("2022-08-30"), 2, 1, D("100.00"), D("100.00")),
        (d("2022-09-01"), 2, 1, D("50.00"), D("50.00")),
    ]


def test_order_frequency_shares_needs_both_kinds(edge):
    assert A.order_frequency_shares(edge).count() == 0


def test_order_frequency_shares_with_repeat_buyer(spark):
    from conftest import EDGE_ORDERS, edge_tables, ts

    orders = EDGE_ORDERS + [(107, ts("2022-08-30 15:00"), [2], 1)]
    t = edge_tables(spark, orders=orders)
    got = rows(A.order_frequency_shares(t), "date", "single_order_users_share", "several_orders_users_share")
    assert got == [(d("2022-08-30"), D("50.00"), D("50.00"))]


def test_courier_load(edge):
    got = by_date(rows(A.courier_load(edge), "date", "users_per_courier", "orders_per_courier"))
    assert got == [
        (d("2022-08-30"), D("2.00"), D("2.00")),
        (d("2022-09-01"), D("2.00"), D("2.00")),
        (d("2022-09-02"), D("1.00"), D("1.00")),
    ]


def test_delivery_time_rounds_half_up(edge):
    got = rows(A.delivery_time(edge), "date", "minutes_to_deliver")
    assert got == [
        (d("2022-08-30"), 20),
        (d("2022-08-31"), 15),
        (d("2022-09-01"), 16),  # avg of 31 and 0 is 15.5 -> 16, not truncated
        (d("2022-09-02"), 20),
    ]


def test_delivery_time_delivered_only(edge):
    got = dict(rows(A.delivery_time(edge, delivered_only=True), "date", "minutes_to_deliver"))
    assert got[d("2022-09-01")] == 31


def test_hourly_cancel_rate_needs_both_kinds(edge):
    assert A.hourly_cancel_rate(edge).count() == 0


def test_daily_revenue(edge):
    got = by_date(rows(R.daily_revenue(edge), "date", "revenue", "total_revenue", "revenue_change"))
    assert got == [
        (d("2022-08-30"), D("460"), D("460"), None),
        (d("2022-09-01"), D("230"), D("690"), D("-50.00")),
    ]


def test_daily_arpu(edge):
    got = by_date(rows(R.daily_arpu(edge), "date", "arpu", "arppu", "aov"))
    assert got == [
        (d("2022-08-30"), D("230.00"), D("230.00"), D("230.00")),
        (d("2022-09-01"), D("76.67"), D("115.00"), D("115.00")),
    ]


def test_running_arpu(edge):
    got = by_date(rows(R.running_arpu(edge), "date", "running_arpu", "running_arppu", "running_aov"))
    assert got == [
        (d("2022-08-30"), D("230.00"), D("230.00"), D("230.00")),
        (d("2022-09-01"), D("230.00"), D("230.00"), D("172.50")),
    ]


def test_weekday_arpu(edge):
    got = rows(R.weekday_arpu(edge), "weekday", "weekday_number", "arpu", "arppu", "aov")
    assert got == [
        ("Tuesday  ", 2, D("230.00"), D("230.00"), D("230.00")),
        ("Thursday ", 4, D("76.67"), D("115.00"), D("115.00")),
    ]


def test_new_user_revenue(edge):
    cols = ("date", "revenue", "new_users_revenue", "new_users_revenue_share", "old_users_revenue_share")
    got = rows(R.new_user_revenue(edge), *cols)
    assert got == [
        (d("2022-08-30"), D("460"), D("460"), D("100.00"), D("0.00")),
        (d("2022-09-01"), D("230"), D("120"), D("52.17"), D("47.83")),
    ]


def test_product_revenue_share(edge):
    got = rows(R.product_revenue_share(edge), "product_name", "revenue", "share_in_revenue")
    assert got == [
        ("чай", D("360"), D("52.173913043478")),
        ("сахар", D("330"), D("47.826086956522")),
    ]


def test_product_revenue_share_merges_small(edge):
    got = rows(R.product_revenue_share(edge, threshold="50"), "product_name", "revenue", "share_in_revenue")
    assert got == [("чай", D("360"), D("52.173913043478")), ("ДРУГОЕ", D("330"), D("47.826086956522"))]


def test_gross_profit(edge):
    cols = (
        "date", "revenue", "costs", "tax", "gross_profit", "total_revenue", "total_costs", "total_tax",
        "total_gross_profit", "gross_profit_ratio", "total_gross_profit_ratio",
    )
    got = by_date(rows(R.gross_profit(edge), *cols))
    assert got == [
        (d("2022-08-30"), D("460"), D("120430"), D("60.00"), D("-120030"), D("460"), D("120430"), D("60"),
         D("-120030"), D("-26093.48"), D("-26093.48")),
        (d("2022-09-01"), D("230"), D("150380"), D("30.00"), D("-150180"), D("690"), D("270810"), D("90"),
         D("-270210"), D("-65295.65"), D("-39160.87")),
    ]


def test_gross_profit_tax_rounds_per_unit(spark):
    from conftest import edge_tables, ts

    # Three units at 1.00 with the standard rate: 0.17 * 3 = 0.51, not round(0.50).
    orders = [(201, ts("2022-08-30 10:00"), [5, 5, 5], 1)]
    t = edge_tables(spark, orders=orders, products=[(5, "x", Decimal("1.00"))])
    got = rows(R.gross_profit(t), "date", "tax")
    assert got == [(d("2022-08-30"), D("0.51"))]


def test_gross_profit_courier_bonus_threshold(spark):
    from cartpulse import schema as S
    from conftest import edge_tables, ts

    # Courier 9: 5 deliveries on 30 Aug (bonus 400); courier 8: 5 on 1 Sep
    # (bonus 500); courier 7: 4 on 1 Sep (no bonus).
    extra = [(9, 1000 + i, S.DELIVER_ORDER, ts("2022-08-30 12:00")) for i in range(5)]
    extra += [(8, 2000 + i, S.DELIVER_ORDER, ts("2022-09-01 12:00")) for i in range(5)]
    extra += [(7, 3000 + i, S.DELIVER_ORDER, ts("2022-09-01 13:00")) for i in range(4)]
    t = edge_tables(spark, extra_courier_actions=extra)
    got = dict(rows(R.gross_profit(t), "date", "costs"))
    assert got[d("2022-08-30")] == D("120430") + 5 * 150 + 400
    assert got[d("2022-09-01")] == D("150380") + 5 * 150 + 500 + 4 * 150


def test_gross_profit_outside_tariff_months(spark):
    from cartpulse import schema as S
    from conftest import EDGE_ORDERS, edge_tables, ts

    orders = EDGE_ORDERS + [(301, ts("2022-10-03 10:00"), [2], 1)]
    extra = [(1, 301, S.DELIVER_ORDER, ts("2022-10-03 10:30"))]
    t = edge_tables(spark, orders=orders, extra_courier_actions=extra)
    got = {r["date"]: r for r in R.gross_profit(t).collect()}
    october = got[d("2022-10-03")]
    assert october["revenue"] == D("120") and october["costs"] is None and october["gross_profit"] is None
    # running sums skip the null costs but keep the revenue
    assert october["total_revenue"] == D("810") and october["total_costs"] == D("270810")
    assert october["total_gross_profit"] == D("-270210")


def test_null_order_ids_in_both_logs(spark):
    from cartpulse import schema as S
    from conftest import edge_tables, ts

    t = edge_tables(
        spark,
        extra_user_actions=[(5, None, S.CREATE_ORDER, ts("2022-08-30 11:00"))],
        extra_courier_actions=[(1, None, S.DELIVER_ORDER, ts("2022-08-30 11:30"))],
    )
    growth = {r["date"]: r["new_users"] for r in A.audience_growth(t).collect()}
    assert growth[d("2022-08-30")] == 3  # user 5 is new, whatever its order
    active = {r["date"]: r["paying_users"] for r in A.active_audience(t).collect()}
    assert active[d("2022-08-30")] == 2  # a null order never counts as paid
    costs = dict(rows(R.gross_profit(t), "date", "costs"))
    assert costs[d("2022-08-30")] == D("120430")  # a delivery without order is not paid
    assert dict(rows(A.delivery_time(t), "date", "minutes_to_deliver"))[d("2022-08-30")] == 20


def test_campaign_cac(edge, edge_members):
    got = rows(M.campaign_cac(edge, edge_members, SPEND), "ads_campaign", "cac")
    assert got == [("Кампания №1", D("500.00"))]


def test_campaign_roi_keeps_empty_campaign(edge, edge_members):
    got = sorted(rows(M.campaign_roi(edge, edge_members, SPEND), "ads_campaign", "roi"))
    assert got == [("Кампания № 1", D("-43.00")), ("Кампания № 2", None)]


def test_campaign_avg_check(edge, edge_members):
    got = rows(M.campaign_avg_check(edge, edge_members), "ads_campaign", "avg_check")
    assert got == [("Кампания № 1", D("115.00"))]


def test_retention(edge):
    got = sorted(rows(M.retention(edge), "start_month", "start_date", "day_number", "retention"))
    aug = d("2022-08-01")
    assert got == [
        (aug, d("2022-08-30"), 0, D("1.00")),
        (aug, d("2022-08-30"), 2, D("0.50")),
        (aug, d("2022-08-30"), 3, D("0.50")),
        (aug, d("2022-08-31"), 0, D("1.00")),
        (aug, d("2022-08-31"), 1, D("1.00")),
        (d("2022-09-01"), d("2022-09-01"), 0, D("1.00")),
    ]


def test_campaign_retention(edge, edge_members):
    got = rows(M.campaign_retention(edge, edge_members), "ads_campaign", "start_date", "day_number", "retention")
    assert got == [("Кампания № 1", d("2022-09-01"), 0, D("1.00"))]


def test_campaign_payback(edge, edge_members):
    pb = M.campaign_payback(edge, edge_members, SPEND, payers={1: 2, 2: 1})
    got = rows(pb, "ads_campaign", "day", "cumulative_arppu", "cac")
    assert got == [
        ("Кампания № 1", 0, D("230.00"), D("500.00")),
        ("Кампания № 1", 2, D("285.00"), D("500.00")),
    ]


def test_campaign_payback_default_payers(edge, edge_members):
    pb = M.campaign_payback(edge, edge_members, SPEND)
    assert rows(pb, "day", "cumulative_arppu") == [(0, D("230.00")), (2, D("285.00"))]


def test_campaign_payback_day(edge, edge_members):
    got = rows(R2.campaign_payback_day(edge, edge_members, SPEND, payers={1: 2}), "ads_campaign", "payback_day")
    assert got == [("Кампания № 1", None)]
    low = P.Campaigns(spend={1: 500})
    got = rows(R2.campaign_payback_day(edge, edge_members, low, payers={1: 2}), "payback_day")
    assert got == [(2,)]


def test_break_even_dates(edge):
    got = rows(R2.break_even_dates(edge), "first_profitable_date", "first_cumulative_profitable_date")
    assert got == [(None, None)]


def test_peak_hours(edge):
    assert R2.peak_hours(edge).count() == 0


def test_money_types_stay_decimal(edge):
    from pyspark.sql.types import DecimalType

    schema = R.daily_revenue(edge).schema
    assert all(isinstance(schema[c].dataType, DecimalType) for c in ("revenue", "total_revenue", "revenue_change"))
    assert isinstance(Decimal, type)


def test_weekday_arpu_custom_window(edge):
    import datetime as dt

    t = R.weekday_arpu(edge, start=dt.datetime(2022, 8, 31), end=dt.datetime(2022, 9, 1, 23, 59, 59))
    # Wednesday has a (cancelled) action but no revenue, so only Thursday remains.
    assert rows(t, "weekday", "arpu", "arppu", "aov") == [("Thursday ", D("76.67"), D("115.00"), D("115.00"))]


def test_campaign_retention_custom_start_and_days(edge, edge_members):
    got = rows(
        M.campaign_retention(edge, edge_members, start_date=d("2022-08-30"), days=(0, 2)),
        "ads_campaign", "start_date", "day_number", "retention",
    )
    assert got == [
        ("Кампания № 1", d("2022-08-30"), 0, D("1.00")),
        ("Кампания № 1", d("2022-08-30"), 2, D("1.00")),
    ]


def test_campaign_avg_check_custom_window(edge, edge_members):
    got = rows(
        M.campaign_avg_check(edge, edge_members, start=d("2022-08-30"), end=d("2022-08-30")),
        "ads_campaign", "avg_check",
    )
    assert got == [("Кампания № 1", D("340.00"))]
