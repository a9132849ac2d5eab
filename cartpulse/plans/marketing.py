"""Advertising-campaign metrics: CAC, ROI, average check, retention, payback.

``members`` is a DataFrame (ads_campaign INT, user_id BIGINT); ``campaigns``
gives each campaign's spend.  Membership is joined first, and only then are the
member rows tested against the cancelled orders, which keeps the large anti
join small.  Orders are tested against a filter of the members' order ids where they are
scanned, so product arrays are neither shuffled nor, for other orders, exploded.  Spark broadcasts the members when their bytes are below the
session's threshold.  Per-user windows run on rows pre-aggregated to (user, day),
so a hot user contributes at most one row per day to a window partition.

A campaign that the members name but ``campaigns`` doesn't keeps its rows, with a
null cost.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartpulse import params as P
from cartpulse.functions.dates import day, days_between
from cartpulse.functions.numeric import (
    half_up_div,
    half_up_div_sql,
    money_pct,
    money_ratio,
    round_div,
    units_sql,
    with_scale,
)
from cartpulse.operators.blocks import bought, paid_actions, user_dates
from cartpulse.operators.campaign import by_campaign, campaign_dim, campaign_label, campaign_spend, members_side, with_campaign
from cartpulse.sources.tables import DeliveryTables, within

# Precision of the per-user mean check: 1e-10 of a cent.
MEAN_EXTRA_PLACES = 10


def _member_paid_actions(t: DeliveryTables, members: DataFrame, start=None, end=None) -> DataFrame:
    """Member user actions in [start, end] on non-cancelled orders, with the columns of ``members``.

    ``members`` is a prepared side (:func:`members_side`), one row per user or membership.
    """
    if "user_log" in t.shared:
        return with_campaign(within(paid_actions(t), "time", start, end), members)
    return paid_actions(t, with_campaign(t.between("user_actions", start, end), members))


def _priced_actions(t: DeliveryTables, actions: DataFrame, how: str = "inner") -> DataFrame:
    """Member ``actions`` joined to what their orders hold: ``actions``' columns, date (of creation), amount.

    An order's lines come once per action, as in a join of lines to the log.  ``inner`` drops unknown products; ``left``
    keeps every action, with ``ordered`` false where the order is missing or has no line, and unknown products add nothing.
    """
    lines = bought(t, actions).withColumn("ordered", F.lit(True))
    if how == "inner":
        lines = lines.filter("known = 1")
    return actions.join(lines, "order_id", how).withColumn("ordered", F.coalesce("ordered", F.lit(False)))


def paying_members(t: DeliveryTables, members: DataFrame) -> DataFrame:
    """ads_campaign, payers: distinct members acting on a non-cancelled order."""
    return (
        _member_paid_actions(t, members_side(members))
        .groupBy("ads_campaign")
        .agg(F.countDistinct("user_id").alias("payers"))
    )


# -- M15 -------------------------------------------------------------------


def campaign_cac(t: DeliveryTables, members: DataFrame, campaigns: P.Campaigns = P.Campaigns()) -> DataFrame:
    """Customer acquisition cost: spend / paying members, per campaign.

    Columns: ads_campaign (label without a space after the sign), cac (2
    places).  A campaign without paying members has no row.
    """
    return paying_members(t, members).withColumn("spend", campaign_spend("ads_campaign", campaigns.spend)).select(
        campaign_label("ads_campaign", P.CAMPAIGN_LABEL_TIGHT).alias("ads_campaign"),
        money_ratio("spend", "payers").alias("cac"),
    )


# -- M16 -------------------------------------------------------------------


def campaign_roi(t: DeliveryTables, members: DataFrame, campaigns: P.Campaigns = P.Campaigns()) -> DataFrame:
    """Return on ad spend in percent: (members' revenue - spend) / spend.

    Columns: ads_campaign (label with a space), roi (2 places).  Every
    campaign of ``campaigns`` and every campaign with revenue has a row; null
    when its members bought nothing or its spend isn't known.
    """
    actions = _member_paid_actions(t, members_side(members))
    revenue = _priced_actions(t, actions).groupBy("ads_campaign").agg(F.sum("amount").cast("decimal(22,2)").alias("revenue"))
    dim = campaign_dim(t.spark, campaigns.spend)
    return dim.join(revenue, "ads_campaign", "full").select(
        campaign_label("ads_campaign", P.CAMPAIGN_LABEL_SPACED).alias("ads_campaign"),
        money_pct("revenue - spend", "spend").alias("roi"),
    )


# -- M17 -------------------------------------------------------------------


def campaign_avg_check(
    t: DeliveryTables,
    members: DataFrame,
    start: dt.date = P.AVG_CHECK_FROM,
    end: dt.date = P.AVG_CHECK_TO,
    per_order: bool = False,
) -> DataFrame:
    """Mean over members of each member's mean order value, per campaign.

    Orders count on the dates of their non-cancelled member actions within
    [start, end].  Columns: ads_campaign (label with a space), avg_check (2
    places).  The per-user mean is kept to 1e-10 cent, the final mean
    rounded half up.  Sorted by avg_check, descending.  ``per_order=True`` takes the
    mean over the campaign's orders instead of over its members' means.
    """
    actions = _member_paid_actions(t, members_side(members), start, end)
    checks = (
        _priced_actions(t, actions)
        .groupBy("ads_campaign", "user_id", "order_id")
        .agg(F.sum("amount").cast("decimal(22,2)").alias("order_check"))
    )
    if per_order:
        sums = checks.groupBy("ads_campaign").agg(F.sum("order_check").alias("checks"), F.count("order_check").alias("orders"))
        return sums.select(
            campaign_label("ads_campaign", P.CAMPAIGN_LABEL_SPACED).alias("ads_campaign"),
            money_ratio("checks", "nullif(orders, 0)").alias("avg_check"),
        ).orderBy(F.desc("avg_check"))
    per_user = checks.groupBy("ads_campaign", "user_id").agg(
        F.sum("order_check").alias("checks"), F.count("order_check").alias("orders")
    )
    # A user without a priced order has no mean, and a mean over users skips them.
    mean_e = half_up_div(f"{units_sql('checks', 2)} * {10**MEAN_EXTRA_PLACES}", "nullif(orders, 0)")
    per_campaign = (
        per_user.select("ads_campaign", mean_e.alias("mean_e"))
        .groupBy("ads_campaign")
        .agg(F.sum("mean_e").alias("mean_e"), F.count("mean_e").alias("users"))
    )
    avg = half_up_div_sql("mean_e", f"nullif(users, 0) * {10**MEAN_EXTRA_PLACES}")
    return per_campaign.select(
        campaign_label("ads_campaign", P.CAMPAIGN_LABEL_SPACED).alias("ads_campaign"),
        with_scale(avg, 2).alias("avg_check"),
    ).orderBy(F.desc("avg_check"))


# -- M18 -------------------------------------------------------------------


def _cohort_retention(actions: DataFrame, *group: str) -> DataFrame:
    """From action rows (group..., user_id, date): group..., start_date, date,
    day_number, retention (share of the cohort's day-0 size, 2 places).

    One shuffle of the actions, by user: a user's days are gathered as a set,
    which holds at most one entry per calendar day however active the user is.
    """
    by_user = actions.groupBy(*group, "user_id").agg(
        F.min("date").alias("start_date"), F.collect_set(F.struct("date")).alias("days")
    )
    user_days = by_user.select(*group, "user_id", "start_date", F.inline("days"))
    sizes = user_days.groupBy(*group, "start_date", "date").agg(F.count("user_id").alias("users"))
    peak = F.max("users").over(Window.partitionBy(*group, "start_date"))
    return sizes.select("*", peak.alias("cohort_size")).select(
        *group,
        "start_date",
        "date",
        days_between("date", "start_date").alias("day_number"),
        round_div("users", "nullif(cohort_size, 0)", 2).alias("retention"),
    )


def retention(t: DeliveryTables) -> DataFrame:
    """Daily retention of users by first-action cohort.

    Columns: start_month, start_date, day_number, retention (users active on
    ``start_date + day_number`` over the cohort size, 2 places).  Any action
    counts, cancellations included.
    """
    return _cohort_retention(user_dates(t)).select(
        F.trunc("start_date", "month").alias("start_month"), "start_date", "day_number", "retention"
    )


# -- M19 -------------------------------------------------------------------


def campaign_retention(
    t: DeliveryTables,
    members: DataFrame,
    start_date: dt.date = P.RETENTION_START,
    days: tuple[int, ...] = P.RETENTION_DAYS,
) -> DataFrame:
    """Retention of each campaign's members whose first non-cancelled action
    falls on ``start_date``, on the given day numbers.

    Columns: ads_campaign (label with a space), start_date, day_number,
    retention.  Sorted by campaign and day number.
    """
    # A cohort is made by first actions, so the log is needed from its start, but not beyond the last day asked for.
    last = start_date + dt.timedelta(days=max(days, default=0))
    paid = _member_paid_actions(t, members_side(members), end=last)
    actions = paid.select("ads_campaign", "user_id", day("time").alias("date"))
    r = _cohort_retention(actions, "ads_campaign")
    return (
        r.filter((F.col("start_date") == F.lit(start_date)) & F.col("day_number").isin(list(days)))
        .select(
            campaign_label("ads_campaign", P.CAMPAIGN_LABEL_SPACED).alias("ads_campaign"),
            "start_date",
            "day_number",
            "retention",
        )
        .orderBy("ads_campaign", "day_number")
    )


# -- M20 -------------------------------------------------------------------


def campaign_payback(
    t: DeliveryTables,
    members: DataFrame,
    campaigns: P.Campaigns = P.Campaigns(),
    payers: dict[int, int] | None = None,
) -> DataFrame:
    """Cumulative revenue per paying member by day since each member's first
    order, against the acquisition cost.

    Columns: ads_campaign (label with a space), day, cumulative_arppu, cac
    (2 places).  ``day`` counts from the member's first non-cancelled order
    (by creation date); unknown products add no revenue.  ``payers`` (per
    campaign) defaults to the paying members counted as in
    :func:`campaign_cac`; a campaign that a given ``payers`` lacks keeps its
    rows with null ratios.  A member of several campaigns counts for the
    lowest-numbered one.  Sorted by campaign and day.

    Plan: one chain.  Member actions with their orders' totals are summed per (user, day); a window over a user's days
    gives the start, and on one of them the user counts as a payer of each of its campaigns; sums per (campaign, day) and
    a window over a campaign's days give the rest.  No window sees order rows.
    """
    # A member's campaigns in order: the first one takes the revenue, each counts the payer.
    side = members_side(members).groupBy("user_id").agg(F.array_sort(F.collect_set("ads_campaign")).alias("campaigns"))
    side = side.filter(F.size("campaigns") > 0)
    actions = _member_paid_actions(t, side)
    per_user_day = (
        _priced_actions(t, actions, "left")
        .groupBy("user_id", "campaigns", "ordered", "date")
        .agg(F.sum("amount").alias("revenue"))
    )
    by_user = Window.partitionBy("user_id").orderBy("ordered", "date")
    whole = by_user.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dated = per_user_day.select(
        "campaigns",
        "ordered",
        days_between(F.col("date"), F.min("date").over(whole)).alias("day"),
        F.row_number().over(by_user).alias("nth"),
        "revenue",
    )
    kind = "struct<ads_campaign:int,day:int,ordered:boolean,revenue:decimal(32,2),payers:int>"
    sale = f"CAST(named_struct('c', campaigns[0], 'd', day, 'o', true, 'r', revenue, 'p', 0) AS {kind})"
    payer = f"transform(campaigns, c -> CAST(named_struct('c', c, 'd', null, 'o', false, 'r', null, 'p', 1) AS {kind}))"
    rows = dated.select(F.expr(f"inline(concat(CASE WHEN ordered THEN array({sale}) ELSE array() END, CASE WHEN nth = 1 THEN {payer} ELSE array() END))"))
    per_day = rows.groupBy("ads_campaign", "day", "ordered").agg(F.sum("revenue").alias("revenue"), F.sum("payers").alias("payers"))
    of_campaign = Window.partitionBy("ads_campaign").orderBy("ordered", "day")
    all_days = of_campaign.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cumulative = per_day.select(
        "ads_campaign",
        "day",
        "ordered",
        F.sum("revenue").over(of_campaign).alias("cumulative"),
        F.sum("payers").over(all_days).alias("payers"),
    ).filter("ordered")
    if payers is not None:
        cumulative = cumulative.withColumn("payers", by_campaign("ads_campaign", {k: F.lit(int(v)) for k, v in payers.items()}))
    return (
        cumulative.withColumn("spend", campaign_spend("ads_campaign", campaigns.spend))
        .select(
            campaign_label("ads_campaign", P.CAMPAIGN_LABEL_SPACED).alias("ads_campaign"),
            "day",
            money_ratio("cumulative", "payers").alias("cumulative_arppu"),
            money_ratio("spend", "payers").alias("cac"),
        )
        .orderBy("ads_campaign", "day")
    )
