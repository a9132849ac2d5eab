"""Order-level building blocks shared by the metrics.

NOT IN semantics.  The analysis filters "not cancelled" with
``order_id NOT IN (SELECT order_id ... WHERE action = 'cancel_order')``.
Spark plans that form as a null-aware anti join that always broadcasts the
cancelled set, which grows with the data.  ``not_in`` gives the same rows, also
for a set that is empty or holds a null, with a plain ``left_anti`` join, which
the planner runs as a sort-merge join (or a broadcast join when AQE sees a
small side): two facts of the set, a scalar subquery of one row, are tested
at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartpulse import schema as S
from cartpulse.functions.dates import day
from cartpulse.operators.joins import flag_join


def _ids_with_action(actions: DataFrame, action: str, distinct: bool) -> DataFrame:
    ids = actions.filter((F.col("action") == action) & F.col("order_id").isNotNull()).select("order_id")
    return ids.distinct() if distinct else ids


def cancelled_orders(user_actions: DataFrame, distinct: bool = True) -> DataFrame:
    """Ids of orders with a ``cancel_order`` action at any time (S1).

    Deduplicated by default.  On large data this costs no extra shuffle (a
    join on ``order_id`` shuffles these rows anyway) and gives every use of
    the set in one metric the same plan, so Spark reads and shuffles the
    cancel rows once and reuses the exchange.  ``distinct=False`` is for a
    lone existence test where AQE can broadcast the raw ids directly.
    """
    return _ids_with_action(user_actions, S.CANCEL_ORDER, distinct)


def delivered_orders(courier_actions: DataFrame, distinct: bool = True) -> DataFrame:
    """Ids of orders with a ``deliver_order`` action by any courier (S3)."""
    return _ids_with_action(courier_actions, S.DELIVER_ORDER, distinct)


def set_facts(ids: DataFrame, key: str = "order_id") -> tuple[Column, Column]:
    """What SQL's NOT IN asks of a set: does it lack a null (else no row passes), is it empty (then null keys pass too)?

    Scalar subqueries over one aggregate of the set, which Spark computes once per query.
    """
    facts = ids.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("known"))
    return facts.select(F.col("n") == F.col("known")).scalar(), facts.select(F.col("n") == 0).scalar()


def may_pass(facts: tuple[Column, Column], key: str = "order_id") -> Column:
    """Can a row pass NOT IN, whatever the known ids of the set?  Tested at the scan, so null keys stay out of exchanges."""
    complete, empty = facts
    return (F.col(key).isNotNull() & complete) | (F.col(key).isNull() & empty)


def not_in(df: DataFrame, ids: DataFrame, key: str = "order_id", facts: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows of ``df`` with ``key NOT IN (ids)``, with SQL's rules for nulls, without a null-aware broadcast.

    ``ids`` has the column ``key`` and may hold nulls and repeated values; with ``facts`` of the whole set given, it may be
    the set's known ids alone.
    """
    known = ids.select(key).filter(F.col(key).isNotNull())
    return df.filter(may_pass(facts or set_facts(ids, key), key)).join(known, key, "left_anti")


def cancel_facts(user_actions: DataFrame) -> tuple[Column, Column]:
    """:func:`set_facts` of the cancelled orders' ids."""
    return set_facts(user_actions.filter(F.col("action") == S.CANCEL_ORDER).select("order_id"))


def not_cancelled(df: DataFrame, user_actions: DataFrame) -> DataFrame:
    """Rows of ``df`` with a known ``order_id`` that is not cancelled: :func:`not_in` where ids are never null (S2)."""
    return df.filter(F.col("order_id").isNotNull()).join(cancelled_orders(user_actions), "order_id", "left_anti")


def with_cancel_flag(df: DataFrame, user_actions: DataFrame, flag: str = "cancelled") -> DataFrame:
    """``df`` plus a boolean column: is the row's order cancelled."""
    return flag_join(df, cancelled_orders(user_actions), "order_id", flag)


def with_own_flag(actions: DataFrame, action: str, flag: str) -> DataFrame:
    """``actions`` plus a boolean column: has the row's order ``action`` anywhere in this log?

    The same as a flag join of the log to its own ids, with one scan and one
    shuffle: a window over the few rows of an order.  Rows without an order id
    are never flagged and are spread by their content instead of meeting in one
    partition.
    """
    spread = F.when(F.col("order_id").isNull(), F.xxhash64(*actions.columns))
    has = F.max(F.col("action") == action).over(Window.partitionBy("order_id", spread))
    return actions.withColumn(flag, F.col("order_id").isNotNull() & F.coalesce(has, F.lit(False)))


def paid_flag(facts: tuple[Column, Column], flag: str = "cancelled") -> Column:
    """True for a row that counts as paying: ``order_id NOT IN (cancelled)`` evaluated per row from a boolean ``flag``."""
    return may_pass(facts) & ~F.col(flag)


def order_lines(orders: DataFrame, *extra: str) -> DataFrame:
    """One row per unit bought: date, order_id, product_id (S4).

    Repeated products stay repeated.  Null and empty arrays yield no row,
    like ``unnest``.  ``extra`` names more columns of ``orders`` to keep.
    """
    return orders.select(
        day("creation_time").alias("date"),
        "order_id",
        *extra,
        F.explode("product_ids").alias("product_id"),
    )


def priced_lines(lines: DataFrame, products: DataFrame, how: str = "inner") -> DataFrame:
    """Order lines joined to products (S5): ``inner`` drops unknown product ids,
    ``left`` keeps them with a null name and price."""
    return lines.join(products, "product_id", how)


def units_sold(orders: DataFrame, *keys: str) -> DataFrame:
    """``keys`` (among date and order_id), product_id, units: bought units counted before any join to products."""
    return order_lines(orders).groupBy(*keys, "product_id").agg(F.count(F.lit(1)).alias("units"))


def sales(units: DataFrame, products: DataFrame, *keys: str, **amounts: Column) -> DataFrame:
    """``keys``, revenue and ``amounts`` (per unit, columns of products) of counted units; unknown products are left out."""
    sums = {"revenue": F.col("price"), **amounts}
    return units.join(products, "product_id").groupBy(*keys).agg(
        *[F.sum(c * F.col("units")).cast("decimal(38,2)" if name == "revenue" else "decimal(38,0)").alias(name) for name, c in sums.items()]
    )


def order_totals(priced: DataFrame, *keys: str) -> DataFrame:
    """Sum of unit prices per order (S6): order_id, ``keys``, order_revenue.

    ``keys`` are columns constant within an order (e.g. its date), kept so a
    later per-day sum can start from the order totals.
    """
    return priced.groupBy("order_id", *keys).agg(F.sum("price").alias("order_revenue"))
