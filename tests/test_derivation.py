"""The Spark derivation of the delivery tables equals the oracle's SQL
derivation row for row (arrays in order, timestamps exact)."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from cartpulse.oracle import PRELUDE
from cartpulse.sources.tpch import derive_tables
from tools.check_oracle import duck


@pytest.fixture(scope="module")
def both(spark):
    return derive_tables(spark, SF_SMALL), duck(SF_SMALL)


def _duck(con, select: str):
    return con.execute("WITH " + PRELUDE.strip() + "\n" + select).fetchall()


def test_orders_with_ordered_product_arrays(both):
    t, con = both
    spark_rows = {r["order_id"]: (r["creation_time"], r["product_ids"]) for r in t.orders.collect()}
    duck_rows = {
        o: (ts, list(p) if p is not None else None)
        for o, ts, p in _duck(con, "SELECT order_id, creation_time, product_ids FROM d_orders")
    }
    assert spark_rows == duck_rows


@pytest.mark.parametrize(
    "table, cols",
    [
        ("user_actions", "user_id, order_id, action, time"),
        ("courier_actions", "courier_id, order_id, action, time"),
    ],
)
def test_action_logs(both, table, cols):
    t, con = both
    spark_rows = sorted(tuple(r) for r in getattr(t, table).select(*cols.split(", ")).collect())
    duck_rows = sorted(_duck(con, f"SELECT {cols} FROM d_{table}"))
    assert spark_rows == duck_rows
