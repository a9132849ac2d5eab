"""Revenue and unit-economics metrics: daily revenue, ARPU/ARPPU/AOV,
new-user revenue, product shares, gross profit.

Every function takes a :class:`DeliveryTables` (plus parameters) and returns a
lazy DataFrame.  Money columns are DECIMAL; ratios are DECIMAL rounded
HALF_UP exactly (see ``cartpulse.functions.numeric``).

Plan shape common to all of them: cancelled orders are removed with an
anti join on ``order_id`` *before* the product arrays are exploded.  Where
orders don't matter, units are counted by day and product below the join to
products, so no exchange carries lines; where they do, lines become one total per
order first, and days are summed from those.  Windows run on the day-level
result only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartpulse import params as P
from cartpulse.functions.dates import day, iso_weekday, weekday_name
from cartpulse.functions.numeric import (
    half_up_div,
    half_up_div_sql,
    money_pct,
    money_ratio,
    units_sql,
    with_scale,
)
from cartpulse.operators.audience import day_order, running_sum
from cartpulse.operators.blocks import (
    delivery_days,
    flagged_between,
    order_days,
    paid_totals,
    paid_units,
    user_days,
)
from cartpulse.operators.joins import left_join_known
from cartpulse.operators.orders import sales
from cartpulse.sources.tables import DeliveryTables


def _per_day(totals: DataFrame, *keys: str) -> DataFrame:
    """Revenue and number of orders from one total per order and ``keys``."""
    return totals.groupBy(*keys).agg(F.sum("order_revenue").alias("revenue"), F.count("order_id").alias("orders"))


def _daily_revenue_base(t: DeliveryTables) -> DataFrame:
    """Revenue and orders per creation date of non-cancelled orders."""
    return _per_day(paid_totals(t, date=day("creation_time")), "date")


# -- M08 -------------------------------------------------------------------


def daily_revenue(t: DeliveryTables) -> DataFrame:
    """Revenue per day, running total, and day-over-day change in percent.

    Columns: date, revenue, total_revenue, revenue_change (null on the first
    day).  The running total uses an explicit ROWS frame.
    """
    daily = sales(paid_units(t), t.products, "date")
    w = day_order()
    return daily.select(
        "date",
        "revenue",
        F.sum("revenue").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("total_revenue"),
        F.lag("revenue").over(w).alias("prev_revenue"),
    ).select(
        "date", "revenue", "total_revenue", money_pct("revenue - prev_revenue", "prev_revenue").alias("revenue_change")
    )


def _users_per_day(t: DeliveryTables) -> DataFrame:
    """date, users (distinct acting users), paying_users (distinct users acting
    on a non-cancelled order), from one row per user and day."""
    known = F.col("user_id").isNotNull()
    return user_days(t).groupBy("date").agg(
        F.count(F.when(known, 1)).alias("users"),
        F.count(F.when(known & (F.col("paid_actions") > 0), 1)).alias("paying_users"),
    )


# -- M09 -------------------------------------------------------------------


def daily_arpu(t: DeliveryTables) -> DataFrame:
    """ARPU, ARPPU and AOV per day.

    Columns: date, arpu (revenue / users acting that day, cancellations
    included), arppu (revenue / paying users), aov (revenue / orders); 2
    places.  Revenue and orders are by creation date of non-cancelled
    orders; users by action date; the two are inner-joined on date.
    """
    users = _users_per_day(t)
    rev = _daily_revenue_base(t)
    return rev.join(users, "date").select(
        "date",
        money_ratio("revenue", "users").alias("arpu"),
        money_ratio("revenue", "paying_users").alias("arppu"),
        money_ratio("revenue", "orders").alias("aov"),
    )


# -- M10 -------------------------------------------------------------------


def running_arpu(t: DeliveryTables) -> DataFrame:
    """Running ARPU, ARPPU and AOV: cumulative revenue over cumulative new users,
    new paying users and orders.

    Columns: date, running_arpu, running_arppu, running_aov (2 places).  The
    three daily series are inner-joined on date *before* the running sums, so
    a date without a new user or a new payer is left out of all totals.
    """
    # One scan of the log: each user's first action date and first paying date
    # become two dated rows of one aggregate.  A date without rows of either kind
    # drops out, as in an inner join.
    per_user = user_days(t).groupBy("user_id").agg(
        F.min("date").alias("first"), F.min(F.when(F.col("paid_actions") > 0, F.col("date"))).alias("paid")
    )
    kinds = F.array(
        F.struct(F.col("first").alias("date"), F.lit(True).alias("new")),
        F.struct(F.col("paid").alias("date"), F.lit(False).alias("new")),
    )
    dated = per_user.select("user_id", F.inline(kinds)).filter(F.col("date").isNotNull())
    users = (
        dated.groupBy("date")
        .agg(
            F.count(F.when(F.col("new"), 1)).alias("new_rows"),
            F.count(F.when(~F.col("new"), 1)).alias("payer_rows"),
            F.count(F.when(F.col("new"), F.col("user_id"))).alias("new_users"),
            F.count(F.when(~F.col("new"), F.col("user_id"))).alias("new_payers"),
        )
        .filter((F.col("new_rows") > 0) & (F.col("payer_rows") > 0))
    )
    daily = users.join(_daily_revenue_base(t), "date")
    running = daily.select(
        "date",
        running_sum("new_users").alias("users"),
        running_sum("new_payers").alias("payers"),
        running_sum("revenue").alias("revenue"),
        running_sum("orders").alias("orders"),
    )
    return running.select(
        "date",
        money_ratio("revenue", "users").alias("running_arpu"),
        money_ratio("revenue", "payers").alias("running_arppu"),
        money_ratio("revenue", "orders").alias("running_aov"),
    )


# -- M11 -------------------------------------------------------------------


def weekday_arpu(t: DeliveryTables, start=P.WEEKDAY_FROM, end=P.WEEKDAY_TO) -> DataFrame:
    """ARPU, ARPPU and AOV by day of week over a time window (inclusive).

    Columns: weekday (English name padded to 9 characters), weekday_number
    (ISO, Monday = 1), arpu, arppu, aov.  Users are distinct over the whole
    window per weekday.  Sorted by weekday_number.
    """
    weekday = ["weekday", "weekday_number"]

    def of(c: str) -> dict[str, Column]:
        return {"weekday": weekday_name(c), "weekday_number": iso_weekday(c)}

    rev = _per_day(paid_totals(t, start, end, **of("creation_time")), *weekday)
    per_user = (
        flagged_between(t, start, end)
        .groupBy(*[c.alias(k) for k, c in of("time").items()], "user_id")
        .agg(F.max("paid").alias("paid"))
    )
    known = F.col("user_id").isNotNull()
    users = per_user.groupBy(*weekday).agg(
        F.count(F.when(known, 1)).alias("users"),
        F.count(F.when(known & F.col("paid"), 1)).alias("paying_users"),
    )
    return (
        rev.join(users, weekday)
        .select(
            *weekday,
            money_ratio("revenue", "users").alias("arpu"),
            money_ratio("revenue", "paying_users").alias("arppu"),
            money_ratio("revenue", "orders").alias("aov"),
        )
        .orderBy("weekday_number")
    )


# -- M12 -------------------------------------------------------------------


def new_user_revenue(t: DeliveryTables) -> DataFrame:
    """Revenue per day and the part of it paid by users on their first day.

    Columns: date, revenue, new_users_revenue, new_users_revenue_share,
    old_users_revenue_share (percent, 2 places; old = 100 - new).  New-user
    revenue: order totals attached to each non-cancelled user action, summed
    per action date and user, kept where that date is the user's first action
    date.  Dates without new-user revenue are dropped.  Sorted by date.
    """
    # Totals per order, with the creation date, serve both sides from one
    # exchange: the two daily sums are united and grouped, as a join on date
    # would push a filter into one of them and part their plans.
    totals = paid_totals(t, date=day("creation_time"))
    rev = totals.groupBy("date").agg(F.sum("order_revenue").alias("revenue"))
    # Every action joins its order's total (null for cancelled or unpriced
    # orders, and for actions without an order, which go past the join); the
    # (user, date) sums give that day's revenue, and a window over a user's days the
    # first one.
    actions = t.user_actions.filter(F.col("user_id").isNotNull()).select(day("time").alias("date"), "user_id", "order_id")
    revenue = totals.select("order_id", "order_revenue")
    per_user_day = (
        left_join_known(actions, revenue, "order_id")
        .groupBy("user_id", "date")
        .agg(F.sum("order_revenue").alias("revenue"))
    )
    first = F.min("date").over(Window.partitionBy("user_id"))
    new_rev = (
        per_user_day.withColumn("first", first)
        .filter((F.col("date") == F.col("first")) & F.col("revenue").isNotNull())
        .groupBy("date")
        .agg(F.sum("revenue").alias("new_users_revenue"))
    )
    both = rev.select("date", "revenue", F.lit(None).cast("decimal(38,2)").alias("new_users_revenue"), F.lit(1).alias("days")).unionByName(
        new_rev.select("date", F.lit(None).cast("decimal(38,2)").alias("revenue"), "new_users_revenue", F.lit(2).alias("days"))
    )
    daily = (
        both.groupBy("date")
        .agg(F.sum("revenue").alias("revenue"), F.sum("new_users_revenue").alias("new_users_revenue"), F.sum("days").alias("days"))
        .filter(F.col("days") == 3)  # both sides have the date; the new users' side has no null one
    )
    share = money_pct("new_users_revenue", "revenue")
    return (
        daily.select(
            "date",
            "revenue",
            "new_users_revenue",
            share.alias("new_users_revenue_share"),
            (F.lit(100) - share).alias("old_users_revenue_share"),
        )
        .orderBy("date")
    )


# -- M13 -------------------------------------------------------------------

SHARE_PLACES = 12


def product_revenue_share(
    t: DeliveryTables,
    threshold: str = P.OTHER_SHARE_THRESHOLD,
    other_label: str = P.OTHER_LABEL,
    rounded: bool = False,
) -> DataFrame:
    """Revenue per product name and its share of all revenue, small names merged.

    Columns: product_name, revenue, share_in_revenue (percent, unrounded in
    the analysis; here exact to 12 places).  Names whose share is below
    ``threshold`` percent are merged under ``other_label`` (revenues and
    shares summed); with ``rounded=True`` the share rounded to 2 places is
    compared instead.  Sorted by revenue, descending.

    The total is a one-row aggregate joined to every name (a broadcast of one
    row), not a window over all lines.
    """
    units = paid_units(t).groupBy("product_id").agg(F.sum("units").alias("units"))
    per_name = sales(units, t.products, "name").withColumnRenamed("name", "product_name")
    total = per_name.agg(F.sum("revenue").alias("total"))
    rev_c, tot_c = units_sql("revenue", 2), units_sql("total", 2)
    small = F.expr(f"{rev_c} * 100 < {tot_c} * {Decimal(str(threshold))}")
    share = half_up_div_sql(f"{rev_c} * {100 * 10**SHARE_PLACES}", tot_c)
    if rounded:
        small = F.expr(f"{half_up_div_sql(f'{rev_c} * 10000', tot_c)} < {Decimal(str(threshold)) * 100}")
    labelled = per_name.crossJoin(F.broadcast(total)).select(
        F.when(small, F.lit(other_label)).otherwise(F.col("product_name")).alias("product_name"),
        "revenue",
        with_scale(share, SHARE_PLACES).alias("share"),
    )
    return (
        labelled.groupBy("product_name")
        .agg(F.sum("revenue").alias("revenue"), F.sum("share").alias("share_in_revenue"))
        .orderBy(F.desc("revenue"))
    )


# -- M14 -------------------------------------------------------------------


def _by_month(d: Column, tariffs, attr: str) -> Column:
    """Tariff value for the month of date ``d``; null for a month without tariff."""
    m = F.trunc(d, "month")
    expr = None
    for tf in tariffs:
        cond = m == F.lit(tf.month)
        value = F.lit(getattr(tf, attr))
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr if expr is not None else F.lit(None).cast("int")


def _reduced_vat(reduced_vat) -> Column:
    if isinstance(reduced_vat, Column):
        return reduced_vat
    return F.col("name").isin(list(reduced_vat))


def gross_profit(
    t: DeliveryTables, cost: P.CostModel = P.CostModel(), reduced_vat=P.REDUCED_VAT_NAMES
) -> DataFrame:
    """Daily revenue, costs, VAT and gross profit, with running totals and ratios.

    Costs of a day = assembly (per non-cancelled user action, by month) +
    fixed costs (per day, by month) + courier pay (per delivery, plus a bonus
    for a courier with at least ``bonus_min_deliveries`` that day); null when
    any part is missing.  VAT is rounded to cents per unit sold, then summed.
    ``reduced_vat`` is a list of product names or a boolean Column on
    ``name``.  Dates missing revenue or costs rows are dropped; running sums
    skip null costs.

    Columns: date, revenue, costs, tax, gross_profit, total_revenue,
    total_costs, total_tax, total_gross_profit, gross_profit_ratio,
    total_gross_profit_ratio (percent, 2 places).
    """
    # VAT of one unit depends on the product only: round it to cents once per
    # product on the dimension side, then sum it over the lines.
    (rn, rd), (sn, sd) = cost.reduced_vat_rate, cost.standard_vat_rate
    cents = "CAST(price * 100 AS BIGINT)"
    unit_tax_c = F.when(
        _reduced_vat(reduced_vat), half_up_div(f"{cents} * {rn}", str(rd), "BIGINT")
    ).otherwise(half_up_div(f"{cents} * {sn}", str(sd), "BIGINT"))
    taxed = t.products.select("product_id", "price", unit_tax_c.alias("tax_c"))
    sold = sales(paid_units(t), taxed, "date", tax_c=F.col("tax_c")).select("date", "revenue", with_scale("tax_c", 2).alias("tax"))

    deliveries = delivery_days(t)
    date, n = F.col("date"), F.col("deliveries")
    bonus = F.coalesce(_by_month(date, cost.tariffs, "courier_bonus"), F.lit(0))
    bonus = F.when(n >= cost.bonus_min_deliveries, bonus).otherwise(F.lit(0))
    courier_pay = deliveries.groupBy("date").agg(F.sum(n * cost.pay_per_delivery + bonus).alias("courier_pay"))
    # Assembly is paid per non-cancelled user action at the month's rate (null
    # outside the tariff months), fixed costs per day.
    assembly = order_days(t).select(
        "date",
        (F.col("paid_actions") * _by_month(date, cost.tariffs, "assembly_per_action")).alias("assembly"),
        _by_month(date, cost.tariffs, "fixed_per_day").alias("fixed"),
    )
    total = F.col("assembly") + F.col("fixed") + F.col("courier_pay")
    costs = assembly.join(courier_pay, "date", "full").select("date", total.cast("decimal(22,2)").alias("costs"))

    daily = costs.join(sold, "date").withColumn(
        "gross_profit", F.col("revenue") - F.col("costs") - F.col("tax")
    )
    return daily.select(
        "date",
        "revenue",
        "costs",
        "tax",
        "gross_profit",
        running_sum("revenue").alias("total_revenue"),
        running_sum("costs").alias("total_costs"),
        running_sum("tax").alias("total_tax"),
        running_sum("gross_profit").alias("total_gross_profit"),
    ).select(
        "*",
        money_pct("gross_profit", "revenue").alias("gross_profit_ratio"),
        money_pct("total_gross_profit", "total_revenue").alias("total_gross_profit_ratio"),
    )
