from __future__ import annotations

import datetime as dt
import os
import sys
import tempfile
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartpulse import schema as S  # noqa: E402
from cartpulse.session import build_session  # noqa: E402
from cartpulse.sources.tables import DeliveryTables  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    warehouse = tempfile.mkdtemp(prefix="cartpulse-warehouse-")
    s = build_session(
        master="local[*]",
        shuffle_partitions=8,
        app_name="cartpulse-tests",
        extra_conf={
            "spark.sql.warehouse.dir": warehouse,
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="cartpulse-checkpoints-"),
        },
    )
    yield s
    s.stop()


def ts(text: str) -> dt.datetime:
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M")


# Hand-made edge rows (FIXTURES.md section 3): repeated product, unknown
# product, empty array, next-day cancellation, midnight delivery, undelivered
# order.  Users u1..u4 are 1..4, couriers c1, c2 are 1, 2.
EDGE_ORDERS = [
    (101, ts("2022-08-30 10:00"), [1, 1, 2], 1),
    (102, ts("2022-08-30 23:50"), [2], 2),
    (103, ts("2022-08-31 09:00"), [1], 3),
    (104, ts("2022-09-01 10:00"), [1], 1),
    (105, ts("2022-09-01 10:30"), [99, 2], 4),
    (106, ts("2022-09-02 12:00"), [], 2),
]
EDGE_COURIER = [
    (1, 101, S.ACCEPT_ORDER, ts("2022-08-30 10:05")),
    (1, 101, S.DELIVER_ORDER, ts("2022-08-30 10:25")),
    (1, 102, S.ACCEPT_ORDER, ts("2022-08-30 23:55")),
    (1, 102, S.DELIVER_ORDER, ts("2022-08-31 00:10")),
    (2, 104, S.ACCEPT_ORDER, ts("2022-09-01 10:05")),
    (2, 104, S.DELIVER_ORDER, ts("2022-09-01 10:36")),
    (2, 105, S.ACCEPT_ORDER, ts("2022-09-01 10:40")),
    (1, 106, S.ACCEPT_ORDER, ts("2022-09-02 12:05")),
    (1, 106, S.DELIVER_ORDER, ts("2022-09-02 12:25")),
]
EDGE_PRODUCTS = [(1, "сахар", Decimal("110.00")), (2, "чай", Decimal("120.00"))]


def edge_tables(spark, extra_user_actions=(), extra_courier_actions=(), orders=None, products=None):
    orders = EDGE_ORDERS if orders is None else orders
    ua = [(u, o, S.CREATE_ORDER, t) for o, t, _, u in orders]
    ua.append((3, 103, S.CANCEL_ORDER, ts("2022-09-01 00:10")))
    ua.extend(extra_user_actions)
    return DeliveryTables(
        spark.createDataFrame(ua, S.USER_ACTIONS),
        spark.createDataFrame(EDGE_COURIER + list(extra_courier_actions), S.COURIER_ACTIONS),
        spark.createDataFrame([(o, t, p) for o, t, p, _ in orders], S.ORDERS),
        spark.createDataFrame(EDGE_PRODUCTS if products is None else products, S.PRODUCTS),
    )


@pytest.fixture(scope="session")
def edge(spark):
    return edge_tables(spark)


@pytest.fixture(scope="session")
def edge_members(spark):
    # Campaign 1 = {u1, u4}, campaign 2 = {u3}.
    return spark.createDataFrame([(1, 1), (1, 4), (2, 3)], S.CAMPAIGN_MEMBERS)


def rows(df, *cols):
    """Collect ``cols`` of ``df`` as tuples (decimals kept exact)."""
    return [tuple(r[c] for c in cols) for r in df.collect()]


def d(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def D(text):
    return None if text is None else Decimal(text)
