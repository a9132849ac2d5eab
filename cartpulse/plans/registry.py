"""Registered queries: each metric bound to the test-data derivation.

A registered query is ``(spark, sf_dir) -> DataFrame``: it derives the
delivery tables from the TPC-H-like parquet in ``sf_dir`` (whole tables) and
runs one metric with the test parameters of ``cartpulse.sources.tpch``.
Decimal columns are cast to DOUBLE at this boundary only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartpulse import params as P
from cartpulse import schema as S
from cartpulse.functions.dates import day
from cartpulse.jobs import METRIC_FUNCTIONS, run_metric
from cartpulse.operators import orders as O
from cartpulse.operators.audience import first_seen
from cartpulse.operators.campaign import members_side, with_campaign
from cartpulse.sources.tables import DeliveryTables
from cartpulse.sources.tpch import (
    SHARE_THRESHOLD,
    TEST_FIXED_COSTS,
    TEST_SPEND,
    campaign_members,
    derive_tables,
    reduced_vat_predicate,
)

Query = Callable[[SparkSession, str], DataFrame]

TEST_COSTS = P.CostModel(
    tariffs=tuple(replace(t, fixed_per_day=f) for t, f in zip(P.CostModel().tariffs, TEST_FIXED_COSTS, strict=True))
)


def to_boundary(df: DataFrame) -> DataFrame:
    """Cast DECIMAL columns to DOUBLE (exact decimals become the nearest double)."""
    cols = [
        F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def _with_test_parameters(name: str, **options) -> Callable[[SparkSession, str, DeliveryTables], DataFrame]:
    """The metric with the parameters used on the TPC-H-like test data, and further ``options`` of its own."""

    needs_members = METRIC_FUNCTIONS[name][1]

    def run(spark: SparkSession, sf_dir: str, tables: DeliveryTables) -> DataFrame:
        return run_metric(
            name,
            tables,
            members=campaign_members(spark, sf_dir) if needs_members else None,
            threshold=SHARE_THRESHOLD,
            reduced_vat=reduced_vat_predicate(),
            campaigns=P.Campaigns(spend=TEST_SPEND),
            cost=TEST_COSTS,
            options={name: options},
        )

    return run


# name -> function of (spark, sf_dir, tables), in the order of the analysis.
METRICS: dict[str, Callable[[SparkSession, str, DeliveryTables], DataFrame]] = {
    name: _with_test_parameters(name) for name in METRIC_FUNCTIONS
}


# The readings of the analysis' prose: name -> the metric with that option.
READINGS: dict[str, Callable[[SparkSession, str, DeliveryTables], DataFrame]] = {
    "delivery_time_delivered": _with_test_parameters("delivery_time", delivered_only=True),
    "hourly_cancel_rate_delivered": _with_test_parameters("hourly_cancel_rate", delivered_only=True),
    "product_revenue_share_rounded": _with_test_parameters("product_revenue_share", rounded=True),
    "campaign_avg_check_per_order": _with_test_parameters("campaign_avg_check", per_order=True),
}


def _blocks() -> dict[str, Callable[[SparkSession, str, DeliveryTables], DataFrame]]:
    """The shared building blocks (S1-S8) as queries of their own."""

    def paid_user_actions(spark, sf, t):
        cancels = t.user_actions.filter(F.col("action") == S.CANCEL_ORDER)
        paid = O.not_in(t.user_actions, cancels)
        return paid.select("user_id", "order_id", "action", day("time").alias("date"))

    def priced(spark, sf, t):
        return O.priced_lines(O.order_lines(t.orders), t.products, "left")

    def paying_members(spark, sf, t):
        members = members_side(campaign_members(spark, sf))
        paid = O.not_cancelled(with_campaign(t.user_actions, members), t.user_actions)
        return paid.select("ads_campaign", "user_id").distinct()

    return {
        "cancelled_orders": lambda spark, sf, t: O.cancelled_orders(t.user_actions),
        "paid_user_actions": paid_user_actions,
        "delivered_orders": lambda spark, sf, t: O.delivered_orders(t.courier_actions),
        "order_lines": lambda spark, sf, t: O.order_lines(t.orders),
        "priced_lines": priced,
        "order_totals": lambda spark, sf, t: O.order_totals(priced(spark, sf, t)),
        "first_seen_users": lambda spark, sf, t: first_seen(t.user_actions, "user_id"),
        "first_seen_couriers": lambda spark, sf, t: first_seen(t.courier_actions, "courier_id"),
        "paying_members": paying_members,
    }


BLOCKS = _blocks()


def make_query(name: str, tables: Callable[[SparkSession, str], DeliveryTables] = derive_tables) -> Query:
    metric = {**METRICS, **READINGS, **BLOCKS}[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_boundary(metric(spark, sf_dir, tables(spark, sf_dir)))

    run.__name__ = name
    return run


def queries() -> dict[str, Query]:
    """The 23 metrics and readouts, the 4 readings of the prose, then the 9 building-block queries."""
    return {name: make_query(name) for name in [*METRICS, *READINGS, *BLOCKS]}
