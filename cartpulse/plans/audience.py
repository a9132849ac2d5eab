"""Audience, courier and order-flow metrics (growth, activity, load, delivery
time, cancellations).

Plan notes.  Per-user and per-courier first dates are aggregations (partial
aggregation absorbs hot ids before the shuffle); a "count distinct ids that
pass a subquery test" becomes a left join to the distinct id set plus a
conditional ``count(DISTINCT ...)``, never a nested-loop existence join.
Inner joins between day-level results are kept where the analysis has them:
a date missing on one side disappears from the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartpulse.functions.dates import day, hour_of, micros_between
from cartpulse.functions.numeric import half_up_div, pct, round_div
from cartpulse.operators.audience import day_order, new_per_day, running_sum
from cartpulse.operators.blocks import cancelled_ids, courier_days, facts, first_dates, user_days, user_log, without_cancelled
from cartpulse.operators.joins import flag_join
from cartpulse.operators.orders import delivered_orders
from cartpulse.sources.tables import DeliveryTables


def _growth(t: DeliveryTables, key: str, new_name: str, total_name: str) -> DataFrame:
    """date, new ids that day, running total of new ids (INT)."""
    daily = new_per_day(first_dates(t, key), key, new_name)
    return daily.withColumn(total_name, running_sum(new_name).cast("int"))


# -- M01 -------------------------------------------------------------------


def audience_growth(t: DeliveryTables) -> DataFrame:
    """New and cumulative users and couriers per day.

    Columns: date, new_users, new_couriers, total_users, total_couriers.
    Users and couriers are counted on their own dates and then full-joined on
    date, so a date present on one side only has nulls (count and total) on
    the other.
    """
    users = _growth(t, "user_id", "new_users", "total_users")
    couriers = _growth(t, "courier_id", "new_couriers", "total_couriers")
    return users.join(couriers, "date", "full").select(
        "date", "new_users", "new_couriers", "total_users", "total_couriers"
    )


# -- M02 -------------------------------------------------------------------


def audience_growth_rates(t: DeliveryTables) -> DataFrame:
    """M01 plus day-over-day change in percent of each of its four counts.

    ``change = round(100 * x / previous x, 2) - 100``; the previous value is
    the previous row in date order (null on the first row and after a gap).
    """
    return growth_rates(audience_growth(t))


def growth_rates(growth: DataFrame) -> DataFrame:
    """Day-over-day changes of an audience-growth result (M01 columns)."""
    counts = ["new_users", "new_couriers", "total_users", "total_couriers"]
    w = day_order()
    base = growth.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in counts])
    names = ["new_users_change", "new_couriers_change", "total_users_growth", "total_couriers_growth"]
    return base.select(
        "date", *counts, *[(pct(c, f"prev_{c}") - 100).alias(n) for c, n in zip(counts, names)]
    )


# -- M03 -------------------------------------------------------------------


def _active_and_totals(days: DataFrame, key: str, active: Column, active_name: str, total_name: str) -> DataFrame:
    """From one row per date and id: per date, the ids with ``active`` (``active_name``), and the running total of ids
    by first action date (``total_name``), on the dates that have new ids.

    A window over an id's dates marks its first one, so both counts come from the same rows.
    """
    first = F.min("date").over(Window.partitionBy(key))
    # rows without an id count for neither and stay out of the window
    daily = (
        days.filter(F.col(key).isNotNull())
        .withColumn("new", F.col("date") == first)
        .groupBy("date")
        .agg(F.count(F.when(active, 1)).alias(active_name), F.count(F.when(F.col("new"), 1)).alias("new"))
        .filter(F.col("new") > 0)
    )
    return daily.select("date", active_name, running_sum("new").cast("int").alias(total_name))


def active_audience(t: DeliveryTables) -> DataFrame:
    """Paying users and active couriers per day, as counts and as shares of the
    running totals of users and couriers.

    Columns: date, paying_users, active_couriers, paying_users_share,
    active_couriers_share (percent, 2 places).  Paying users act that day on
    a non-cancelled order; active couriers have any action that day on an
    order delivered at some time.  Only dates with user rows, courier rows,
    new users and new couriers remain.  Sorted by date.
    """
    users = _active_and_totals(user_days(t), "user_id", F.col("paid_actions") > 0, "paying_users", "total_users")
    couriers = _active_and_totals(courier_days(t), "courier_id", F.col("on_delivered") > 0, "active_couriers", "total_couriers")
    return (
        users.join(couriers, "date")
        .select(
            "date",
            "paying_users",
            "active_couriers",
            pct("paying_users", "total_users").alias("paying_users_share"),
            pct("active_couriers", "total_couriers").alias("active_couriers_share"),
        )
        .orderBy("date")
    )


# -- M04 -------------------------------------------------------------------


def order_frequency_shares(t: DeliveryTables) -> DataFrame:
    """Share of paying users with exactly one / more than one order action a day.

    Columns: date, single_order_users_share, several_orders_users_share
    (percent of that day's paying users).  One pass: paid actions per
    (date, user), then users per date by that number.  Dates lacking
    either kind of user are dropped.  Sorted by date.
    """
    n = F.col("paid_actions")
    per_day = (
        user_days(t)
        .filter(F.col("user_id").isNotNull() & (n > 0))
        .groupBy("date")
        .agg(
            F.count(F.lit(1)).alias("paying_users"),
            F.count(F.when(n == 1, 1)).alias("one_order"),
            F.count(F.when(n > 1, 1)).alias("several_orders"),
        )
    )
    return (
        per_day.filter((F.col("one_order") > 0) & (F.col("several_orders") > 0))
        .select(
            "date",
            pct("one_order", "paying_users").alias("single_order_users_share"),
            pct("several_orders", "paying_users").alias("several_orders_users_share"),
        )
        .orderBy("date")
    )


# -- M05 -------------------------------------------------------------------


def courier_load(t: DeliveryTables) -> DataFrame:
    """Paying users and orders per active courier, per day.

    Columns: date, users_per_courier, orders_per_courier (2 places).
    Orders are counted by creation date through their non-cancelled user
    actions (an order with no such action is not counted; one with two is
    counted twice).  Only dates with payers, active couriers and orders.
    """
    # One scan of each log.  A user log row says who paid on its date, and its
    # order's creation date where the order counts: two dated rows.
    paid = user_log(t).filter("paid")
    created = t.orders.filter(F.col("order_id").isNotNull()).select(F.col("order_id").alias("id"), day("creation_time").alias("created"), F.lit(1).alias("found"))
    dated = paid.select("order_id", "user_id", day("time").alias("acted")).join(created, F.col("order_id") == F.col("id"), "left")
    kinds = F.array(
        F.struct(F.col("acted").alias("date"), F.col("user_id").alias("payer"), F.lit(1).alias("paid"), F.lit(0).alias("ordered")),
        F.struct(F.col("created").alias("date"), F.lit(None).cast("bigint").alias("payer"), F.lit(0).alias("paid"), F.coalesce("found", F.lit(0)).alias("ordered")),
    )
    users = (
        dated.select(F.inline(kinds))
        .groupBy("date", "payer")
        .agg(F.sum("paid").alias("paid"), F.sum("ordered").alias("ordered"))
        .groupBy("date")
        .agg(F.count("payer").alias("paying_users"), F.sum("paid").alias("paid"), F.sum("ordered").alias("orders"))
        .filter((F.col("paid") > 0) & (F.col("orders") > 0) & F.col("date").isNotNull())
    )
    active = (
        courier_days(t)
        .filter("on_delivered > 0")
        .groupBy("date")
        .agg(F.count("courier_id").alias("active_couriers"))
    )
    return (
        users.join(active, "date")
        .select(
            "date",
            round_div("paying_users", "active_couriers", 2).alias("users_per_courier"),
            round_div("orders", "active_couriers", 2).alias("orders_per_courier"),
        )
    )


# -- M06 -------------------------------------------------------------------


def delivery_time(t: DeliveryTables, delivered_only: bool = False) -> DataFrame:
    """Average minutes from first to last courier action of an order, per day.

    Columns: date (date of the order's last courier action),
    minutes_to_deliver (INT, rounded half up).  Cancelled orders are left out.
    As in the original analysis every non-cancelled order with courier
    actions counts, an accepted but undelivered one with its accept-to-accept
    time (0); ``delivered_only=True`` keeps orders with a delivery only.
    Sorted by date.
    """
    ca = without_cancelled(t, t.courier_actions)
    if delivered_only:
        ca = ca.join(delivered_orders(t.courier_actions), "order_id", "left_semi")
    per_order = ca.groupBy("order_id").agg(
        day(F.max("time")).alias("date"),
        micros_between(F.min("time"), F.max("time")).alias("micros"),
    )
    per_day = per_order.groupBy("date").agg(
        F.sum("micros").alias("micros"), F.count("micros").alias("orders")
    )
    return per_day.select(
        "date",
        half_up_div("micros", "orders * 60000000").cast("int").alias("minutes_to_deliver"),
    ).orderBy("date")


# -- M07 -------------------------------------------------------------------


def hourly_cancel_rate(t: DeliveryTables, delivered_only: bool = False) -> DataFrame:
    """Successful and cancelled orders by hour of creation, and the cancel rate.

    Columns: hour, successful_orders, canceled_orders, cancel_rate (a
    fraction, 3 places).  "Successful" means not cancelled; with
    ``delivered_only=True`` also delivered.  Hours lacking either kind are
    dropped.  Sorted by hour.
    """
    # an order without an id is neither successful nor cancelled
    o = t.orders.select("order_id", "creation_time").filter(F.col("order_id").isNotNull())
    o = o.join(cancelled_ids(t).withColumn("cancelled", F.lit(True)), "order_id", "left")
    successful = F.col("cancelled").isNull() & facts(t)[0]
    if delivered_only:
        o = flag_join(o, delivered_orders(t.courier_actions), "order_id", "delivered")
        successful = successful & F.col("delivered")
    hourly = o.groupBy(hour_of("creation_time").alias("hour")).agg(
        F.count(F.when(successful, 1)).alias("successful_orders"),
        F.count(F.when(F.col("cancelled"), 1)).alias("canceled_orders"),
    )
    return (
        hourly.filter(
            F.col("hour").isNotNull() & (F.col("successful_orders") > 0) & (F.col("canceled_orders") > 0)
        )
        .select(
            "hour",
            "successful_orders",
            "canceled_orders",
            round_div("canceled_orders", "successful_orders + canceled_orders", 3).alias("cancel_rate"),
        )
        .orderBy("hour")
    )
