"""Readouts stated in the analysis' conclusions, each a small query on top of
a metric: payback day per campaign, break-even dates, peak and quiet hours."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartpulse import params as P
from cartpulse.plans.audience import hourly_cancel_rate
from cartpulse.plans.marketing import campaign_payback
from cartpulse.plans.revenue import gross_profit
from cartpulse.sources.tables import DeliveryTables


def campaign_payback_day(
    t: DeliveryTables,
    members: DataFrame,
    campaigns: P.Campaigns = P.Campaigns(),
    payers: dict[int, int] | None = None,
) -> DataFrame:
    """First day on which a campaign's cumulative ARPPU exceeds its CAC.

    Columns: ads_campaign, payback_day (null when it never does).
    """
    pb = campaign_payback(t, members, campaigns, payers)
    return pb.groupBy("ads_campaign").agg(
        F.min(F.when(F.col("cumulative_arppu") > F.col("cac"), F.col("day"))).alias("payback_day")
    )


def break_even_dates(t: DeliveryTables, **gross_profit_args) -> DataFrame:
    """First date with positive daily gross profit, and first date with
    positive running gross profit (one row)."""
    gp = gross_profit(t, **gross_profit_args)
    return gp.agg(
        F.min(F.when(F.col("gross_profit") > 0, F.col("date"))).alias("first_profitable_date"),
        F.min(F.when(F.col("total_gross_profit") > 0, F.col("date"))).alias("first_cumulative_profitable_date"),
    )


def peak_hours(t: DeliveryTables, k: int = 3) -> DataFrame:
    """The ``k`` hours with most and the ``k`` with fewest orders.

    Orders per hour are successful + cancelled orders from
    :func:`hourly_cancel_rate`.  Columns: kind ('peak' / 'quiet'), rank
    (1 = most / fewest), hour, orders; ties broken by the earlier hour.  The
    window runs over at most 24 rows.
    """
    hourly = hourly_cancel_rate(t).select(
        "hour", (F.col("successful_orders") + F.col("canceled_orders")).alias("orders")
    )
    busiest = F.row_number().over(Window.orderBy(F.desc("orders"), "hour"))
    quietest = F.row_number().over(Window.orderBy(F.asc("orders"), "hour"))
    ranked = hourly.select("hour", "orders", busiest.alias("peak_rank"), quietest.alias("quiet_rank"))
    # each hour is a row of either kind, a pass over the 24 of them
    kinds = F.array(
        F.struct(F.lit("peak").alias("kind"), F.col("peak_rank").alias("rank")),
        F.struct(F.lit("quiet").alias("kind"), F.col("quiet_rank").alias("rank")),
    )
    return (
        ranked.select("hour", "orders", F.inline(kinds))
        .filter(F.col("rank") <= k)
        .select("kind", "rank", "hour", "orders")
        .orderBy("kind", "rank")
    )
