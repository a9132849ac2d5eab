"""Blocks that many metrics share, each computed from the tables or read from where a run has written them.

A block is a function of the tables.  ``DeliveryTables.shared`` may hold blocks by name that
:func:`write_shared` stored once; without it every metric derives what it needs lazily, and the columns are
the same either way.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartpulse import schema as S
from cartpulse.functions.dates import day
from cartpulse.operators.audience import first_seen
from cartpulse.operators.joins import flag_join
from cartpulse.operators.prefilter import maybe_among
from cartpulse.operators.orders import (
    cancel_facts,
    cancelled_orders,
    may_pass,
    not_in,
    order_lines,
    order_totals,
    paid_flag,
    priced_lines,
    units_sold,
    with_own_flag,
)
from cartpulse.sources.tables import DeliveryTables, inside, within


def user_log(t: DeliveryTables) -> DataFrame:
    """The user log plus ``cancelled`` (is the row's order cancelled at any time) and ``paid`` (does the row pay)."""
    if "user_log" in t.shared:
        return t.shared["user_log"]
    flagged = with_own_flag(t.user_actions, S.CANCEL_ORDER, "cancelled")
    return flagged.withColumn("paid", paid_flag(facts(t)))


def paid_actions(t: DeliveryTables, actions: DataFrame | None = None) -> DataFrame:
    """User actions on non-cancelled orders (S2): user_id, order_id, action, time, and what else ``actions`` has.

    ``actions`` may be a part of the log, e.g. that of some members.  It is then tested by a left join, not an anti join,
    which Catalyst would push below the join that made the part, to the whole log.
    """
    if actions is None:
        return user_log(t).filter("paid").drop("cancelled", "paid") if "user_log" in t.shared else without_cancelled(t, t.user_actions)
    cancelled = cancelled_ids(t).withColumn("_cancelled", F.lit(True))
    tested = actions.filter(may_pass(facts(t))).join(cancelled, "order_id", "left")
    return tested.filter(F.col("_cancelled").isNull()).drop("_cancelled")


def without_cancelled(t: DeliveryTables, df: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``order_id`` is NOT IN the cancelled ones."""
    return not_in(df, cancelled_ids(t), facts=facts(t))


def cancelled_ids(t: DeliveryTables) -> DataFrame:
    """Distinct known ids of cancelled orders (S1)."""
    return t.shared["cancelled"] if "cancelled" in t.shared else cancelled_orders(t.user_actions)


def facts(t: DeliveryTables) -> tuple[Column, Column]:
    """Whether the cancelled ids lack a null, and whether there are none; taken for granted, and for impossible, unless
    ``exact_not_in`` asks."""
    if not t.exact_not_in:
        return F.lit(True), F.lit(False)
    return cancel_facts(t.shared.get("user_log", t.user_actions))


def user_days(t: DeliveryTables) -> DataFrame:
    """date, user_id, actions, paid_actions: what a user did on a day, one row however active the user is."""
    if "user_days" in t.shared:
        return t.shared["user_days"]
    return (
        user_log(t)
        .groupBy(day("time").alias("date"), "user_id")
        .agg(F.count(F.lit(1)).alias("actions"), F.count(F.when(F.col("paid"), 1)).alias("paid_actions"))
    )


def order_days(t: DeliveryTables) -> DataFrame:
    """date, paid_actions: user actions on non-cancelled orders per day, on the days that have any."""
    if "user_days" in t.shared:
        days = t.shared["user_days"].groupBy("date").agg(F.sum("paid_actions").alias("paid_actions"))
        return days.filter("paid_actions > 0")
    return paid_actions(t).groupBy(day("time").alias("date")).agg(F.count(F.lit(1)).alias("paid_actions"))


def flagged_between(t: DeliveryTables, start, end) -> DataFrame:
    """User actions in [start, end] plus ``cancelled``, whenever the cancellation was, and ``paid``.

    With a copy of the log by date, its partitions of that window are read and flagged from the cancelled ids; else one scan
    takes the window and the cancellations together.
    """
    if "user_log" in t.shared:
        return within(t.shared["user_log"], "time", start, end)
    if "user_actions" in t.by_date:
        flagged = flag_join(t.between("user_actions", start, end), cancelled_ids(t), "order_id", "cancelled")
    else:
        needed = t.user_actions.filter(inside("time", start, end) | (F.col("action") == S.CANCEL_ORDER))
        flagged = within(with_own_flag(needed, S.CANCEL_ORDER, "cancelled"), "time", start, end)
    return flagged.withColumn("paid", paid_flag(facts(t)))


def delivery_days(t: DeliveryTables) -> DataFrame:
    """date, courier_id, deliveries (with an order id): deliver actions of a courier on a day."""
    if "courier_days" in t.shared:
        return t.shared["courier_days"].filter("deliver_actions > 0").select("date", "courier_id", "deliveries")
    delivers = t.courier_actions.filter(F.col("action") == S.DELIVER_ORDER)
    return delivers.groupBy(day("time").alias("date"), "courier_id").agg(F.count("order_id").alias("deliveries"))


def courier_days(t: DeliveryTables) -> DataFrame:
    """date, courier_id, on_delivered (actions on orders delivered at any time), deliver_actions, deliveries (those with an order id)."""
    if "courier_days" in t.shared:
        return t.shared["courier_days"]
    delivers = F.col("action") == S.DELIVER_ORDER
    return (
        with_own_flag(t.courier_actions, S.DELIVER_ORDER, "delivered")
        .groupBy(day("time").alias("date"), "courier_id")
        .agg(
            F.count(F.when(F.col("delivered"), 1)).alias("on_delivered"),
            F.count(F.when(delivers, 1)).alias("deliver_actions"),
            F.count(F.when(delivers, F.col("order_id"))).alias("deliveries"),
        )
    )


def first_dates(t: DeliveryTables, key: str) -> DataFrame:
    """First action date per ``user_id`` or ``courier_id`` (S7): the id, start_date."""
    days = {"user_id": "user_days", "courier_id": "courier_days"}[key]
    if days in t.shared:
        return t.shared[days].groupBy(key).agg(F.min("date").alias("start_date"))
    return first_seen(t.user_actions if key == "user_id" else t.courier_actions, key)


def paid_units(t: DeliveryTables) -> DataFrame:
    """date, product_id, units: units of non-cancelled orders by creation date.

    Counted below the join to products: lines are summed map-side by day and product, so a best seller is a row per day and
    task, and no exchange carries lines.
    """
    if "paid_units" in t.shared:
        return t.shared["paid_units"]
    return units_sold(without_cancelled(t, t.orders), "date")


def paid_totals(t: DeliveryTables, start=None, end=None, **keys: Column) -> DataFrame:
    """order_id, ``keys`` (of ``creation_time``), order_revenue: totals of non-cancelled orders with a known product (S6),
    created in [start, end]."""
    if "order_totals" in t.shared:
        totals = within(t.shared["order_totals"], "creation_time", start, end).filter("known_lines > 0")
        return _line_totals(totals, **keys).drop("lines", "known_lines")
    orders = without_cancelled(t, t.between("orders", start, end))
    lines = order_lines(orders, "creation_time").select("order_id", "product_id", *[c.alias(k) for k, c in keys.items()])
    return order_totals(priced_lines(lines, t.products.select("product_id", "price")), *keys)


def bought(t: DeliveryTables, actions: DataFrame) -> DataFrame:
    """order_id, date, amount, known (null: no product is known) of the orders behind paid ``actions``.

    One row per line; from stored totals, one per order.  Other orders are dropped where they are scanned, by a filter of the
    actions' order ids, so no array of products is shuffled and only these orders' lines are made.
    """
    if "order_totals" in t.shared:
        totals = _line_totals(t.shared["order_totals"], date=day("creation_time"))
        return totals.select("order_id", "date", F.col("order_revenue").alias("amount"), F.when(F.col("known_lines") > 0, 1).alias("known"))
    lines = order_lines(maybe_among(t.orders, actions, "order_id"))
    products = t.products.select("product_id", F.col("price").alias("amount"), F.lit(1).alias("known"))
    return priced_lines(lines, products, "left").drop("product_id")


def _line_totals(totals: DataFrame, **keys: Column) -> DataFrame:
    """Stored totals (one per order and creation time) by other keys of the time."""
    return totals.groupBy("order_id", *[c.alias(k) for k, c in keys.items()]).agg(
        F.sum("order_revenue").cast("decimal(22,2)").alias("order_revenue"), F.sum("lines").alias("lines"), F.sum("known_lines").alias("known_lines")
    )


def user_dates(t: DeliveryTables) -> DataFrame:
    """user_id, date of actions, whatever their order; a stored day is one row, a log one per action."""
    if "user_days" in t.shared:
        return t.shared["user_days"].select("user_id", "date")
    return t.user_actions.select("user_id", day("time").alias("date"))


def write_shared(t: DeliveryTables, out: str) -> DeliveryTables:
    """Write the blocks under ``out`` (a folder all executors share) and return the tables with them.

    The user log is read once, flagged and written; its cancelled ids and user-days come from that copy.  The courier log
    is read once, orders are exploded for totals and for units.
    """
    spark, shared = t.spark, {}

    def put(name: str, df: DataFrame) -> None:
        path = f"{out.rstrip('/')}/{name}"
        df.write.parquet(path)
        shared[name] = spark.read.schema(df.schema).parquet(path)

    def tables() -> DeliveryTables:
        return replace(t, shared=dict(shared))

    put("user_log", user_log(t))
    put("cancelled", cancelled_orders(shared["user_log"]))
    put("user_days", user_days(tables()))
    put("courier_days", courier_days(t))
    lines = order_lines(without_cancelled(tables(), t.orders), "creation_time")
    priced = priced_lines(lines, t.products.select("product_id", "price", F.lit(1).alias("known")), "left")
    totals = [F.sum("price").alias("order_revenue"), F.count(F.lit(1)).alias("lines"), F.count("known").alias("known_lines")]
    put("order_totals", priced.groupBy("order_id", "creation_time").agg(*totals))
    put("paid_units", paid_units(tables()))
    return tables()
