"""A hot user holding a third of the log: results against brute force, and
the per-user window fed by (user, day)-deduplicated rows only."""

from __future__ import annotations

import datetime as dt
import random
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
import pytest

from cartpulse import schema as S
from cartpulse.plans import audience as A
from cartpulse.plans import marketing as M
from cartpulse.sources.tables import DeliveryTables

N_OTHER = 2000


@pytest.fixture(scope="module")
def hot(spark):
    rnd = random.Random(7)
    start = dt.datetime(2022, 8, 24)
    rows = []
    order = 0
    for i in range(N_OTHER // 2):  # the hot user: a third of all rows
        order += 1
        rows.append((1, order, S.CREATE_ORDER, start + dt.timedelta(minutes=rnd.randrange(14 * 1440))))
    for i in range(N_OTHER):
        order += 1
        user = rnd.randrange(2, 400)
        rows.append((user, order, S.CREATE_ORDER, start + dt.timedelta(minutes=rnd.randrange(14 * 1440))))
    ua = spark.createDataFrame(rows, S.USER_ACTIONS)
    empty_ca = spark.createDataFrame([], S.COURIER_ACTIONS)
    orders = spark.createDataFrame([(o, t, [1]) for _, o, _, t in rows], S.ORDERS)
    products = spark.createDataFrame([(1, "x", Decimal("1.00"))], S.PRODUCTS)
    frame = pd.DataFrame(rows, columns=["user_id", "order_id", "action", "time"])
    frame["date"] = frame["time"].dt.date
    return DeliveryTables(ua, empty_ca, orders, products), frame


def test_retention_with_hot_user(hot):
    t, frame = hot
    ud = frame[["user_id", "date"]].drop_duplicates()
    ud["start_date"] = ud.groupby("user_id")["date"].transform("min")
    sizes = ud.groupby(["start_date", "date"]).size().rename("n").reset_index()
    sizes["top"] = sizes.groupby("start_date")["n"].transform("max")
    expected = {
        (r.start_date, (r.date - r.start_date).days): (Decimal(int(r.n)) / Decimal(int(r.top))).quantize(
            Decimal("0.01"), rounding=ROUND_HALF_UP
        )
        for r in sizes.itertuples()
    }
    got = {(r["start_date"], r["day_number"]): r["retention"] for r in M.retention(t).collect()}
    assert got == expected


def test_new_users_with_hot_user(hot):
    t, frame = hot
    first = frame.groupby("user_id")["date"].min().value_counts().sort_index()
    got = {r["date"]: r["new_users"] for r in A.audience_growth(t).collect() if r["new_users"] is not None}
    assert got == {k: int(v) for k, v in first.items()}


def test_retention_gathers_days_not_actions(hot):
    t, _ = hot
    df = M.retention(t)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # A user's rows become a set of days in one aggregate; the window runs on (start date, date) rows.
    assert "collect_set" in plan
    assert plan.find("Window [max(users") < plan.find("Aggregate [user_id")
