"""Parameters of the job's command line, and options of the metrics."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from cartpulse import jobs
from cartpulse import schema as S
from cartpulse.plans import revenue as R
from cartpulse.sources.tables import DeliveryTables

DAY = dt.datetime(2022, 9, 1, 10, 0)


def test_options_and_tariffs():
    got = jobs.parse_options('{"campaign_avg_check": {"start": "2024-01-01"}, "weekday_arpu": {"end": "2024-01-01T10:00:00"}, "campaign_retention": {"days": [0, 2]}}')
    assert got["campaign_avg_check"]["start"] == dt.date(2024, 1, 1)
    assert got["weekday_arpu"]["end"] == dt.datetime(2024, 1, 1, 10)
    assert got["campaign_retention"]["days"] == (0, 2)
    with pytest.raises(ValueError, match="nothing"):
        jobs.parse_options('{"nothing": {}}')
    cost = jobs.parse_tariffs('[["2024-01-01", 1, 2, 3]]')
    assert (cost.tariffs[0].month, cost.tariffs[0].fixed_per_day) == (dt.date(2024, 1, 1), 2)


def test_share_threshold_on_rounded_shares(spark):
    # 0.496 % rounds to 0.50 %: below the threshold unrounded, not below it rounded
    products = [(1, "a", Decimal("99.504")), (2, "b", Decimal("0.496"))]
    t = DeliveryTables(
        spark.createDataFrame([(1, 1, S.CREATE_ORDER, DAY)], S.USER_ACTIONS),
        spark.createDataFrame([], S.COURIER_ACTIONS),
        spark.createDataFrame([(1, DAY, [1, 2])], S.ORDERS),
        spark.createDataFrame([(i, n, p * 1000) for i, n, p in products], S.PRODUCTS),
    )
    names = lambda **k: {r.product_name for r in R.product_revenue_share(t, other_label="rest", **k).collect()}
    assert names() == {"a", "rest"}
    assert names(rounded=True) == {"a", "b"}
