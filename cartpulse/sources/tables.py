"""The four input tables of the metrics, as one value passed to every metric."""

from __future__ import annotations

import datetime as dt
import os
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartpulse import schema as S

TABLE_NAMES = ("user_actions", "courier_actions", "orders", "products")

# Tables that also come partitioned by the date of a timestamp: table -> that timestamp.
DATED = {"user_actions": "time", "courier_actions": "time", "orders": "creation_time"}
DATE_COLUMN = "on_date"


@dataclass
class DeliveryTables:
    """user_actions, courier_actions, orders, products as DataFrames.

    ``products`` is the only dimension table; Spark broadcasts it to the large
    order-line side when its bytes are below the session's threshold.

    ``by_date`` holds copies of the logs and orders partitioned by date, read by metrics over a time window
    (:meth:`between`); ``shared`` holds blocks that a run has written once (``operators.blocks``).  Both may be empty.

    ``exact_not_in`` asks for SQL's rules where the set of cancelled ids is empty or holds a null (``operators.orders``),
    at the price of one more scan of the cancellations per metric; without it rows without an order id never pay.
    """

    user_actions: DataFrame
    courier_actions: DataFrame
    orders: DataFrame
    products: DataFrame
    by_date: dict[str, DataFrame] = field(default_factory=dict)
    shared: dict[str, DataFrame] = field(default_factory=dict)
    exact_not_in: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.user_actions.sparkSession

    def conformed(self) -> "DeliveryTables":
        """Validate columns and cast to the model types (see ``schema``)."""
        return replace(self, **{name: S.conform(getattr(self, name), S.SCHEMAS[name], name) for name in TABLE_NAMES})

    def between(self, name: str, start: dt.date | dt.datetime | None, end: dt.date | dt.datetime | None) -> DataFrame:
        """Rows of the log or orders table ``name`` whose time lies in [start, end] (None: open).

        A date as ``end`` includes that whole day.  The filter on time reaches the scan; with a copy partitioned by date only
        the partitions of those dates are read.
        """
        if name not in self.by_date or (start is None and end is None):
            return within(getattr(self, name), DATED[name], start, end)
        dates = within(self.by_date[name], DATE_COLUMN, _date(start), _date(end), on_dates=True)
        return S.conform(within(dates, DATED[name], start, end), S.SCHEMAS[name], name)

    # -- parquet I/O ------------------------------------------------------

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, exact_not_in: bool = False) -> "DeliveryTables":
        """Read ``<root>/<table>.parquet`` (file or folder) for the four tables."""
        frames = {name: spark.read.parquet(os.path.join(root, f"{name}.parquet")) for name in TABLE_NAMES}
        return cls(**frames, exact_not_in=exact_not_in).conformed()

    @classmethod
    def from_paths(
        cls, spark: SparkSession, user_actions: str, courier_actions: str, orders: str, products: str
    ) -> "DeliveryTables":
        """Read the four tables from explicit parquet paths (files or folders)."""
        paths = {"user_actions": user_actions, "courier_actions": courier_actions, "orders": orders, "products": products}
        return cls(**{name: spark.read.parquet(path) for name, path in paths.items()}).conformed()

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str, prefix: str = "", exact_not_in: bool = False) -> "DeliveryTables":
        """Read the four tables from catalog tables ``database.<prefix><table>``, and their copies by date where there are any."""
        frames = {name: spark.table(f"{database}.{prefix}{name}") for name in TABLE_NAMES}
        dated = {name: f"{database}.{prefix}{name}_by_date" for name in DATED}
        by_date = {name: spark.table(path) for name, path in dated.items() if spark.catalog.tableExists(path)}
        return cls(**frames, by_date=by_date, exact_not_in=exact_not_in).conformed()

    def write_bucketed(self, database: str, buckets: int, prefix: str = "", mode: str = "errorifexists") -> None:
        """Save the tables as catalog tables, the three order-keyed ones bucketed
        (and sorted) by ``order_id`` into the same number of buckets.

        With this layout every ``order_id`` join between them (the "not
        cancelled" anti join, the semi and flag joins, orders to user
        actions) reads co-partitioned buckets and needs no shuffle of either
        side.  ``products`` is saved plain.
        """
        for name in TABLE_NAMES:
            writer = getattr(self, name).write.mode(mode).format("parquet")
            if name != "products":
                writer = writer.bucketBy(buckets, "order_id").sortBy("order_id")
            writer.saveAsTable(f"{database}.{prefix}{name}")

    def write_by_date(self, database: str, prefix: str = "", files_per_date: int = 8, mode: str = "errorifexists") -> None:
        """Save the logs and orders also as ``<table>_by_date``, partitioned by the date of their time.

        Rows are dealt to ``files_per_date`` tasks per date by their content before the write, so a date has that many files
        however many tasks have read its rows, and a date with a third of all rows is not one task's work.
        """
        for name, time in DATED.items():
            df = getattr(self, name)
            dealt = df.withColumn(DATE_COLUMN, F.to_date(time)).repartition(
                F.col(DATE_COLUMN), F.pmod(F.xxhash64("order_id", time), F.lit(files_per_date))
            )
            dealt.write.mode(mode).partitionBy(DATE_COLUMN).format("parquet").saveAsTable(f"{database}.{prefix}{name}_by_date")

    def write_parquet(self, root: str, mode: str = "errorifexists", partitions: int | None = None) -> None:
        """Write the four tables as ``<root>/<table>.parquet`` folders.

        Used to cut a long derivation lineage: the folder should live in the
        shared checkpoint location so lost executors recompute nothing.
        ``partitions`` hash-partitions the three order-keyed tables by
        ``order_id`` into that many files first (parallel scans later).
        """
        for name in TABLE_NAMES:
            df = getattr(self, name)
            if partitions and name != "products":
                df = df.repartition(partitions, "order_id")
            df.write.mode(mode).parquet(os.path.join(root, f"{name}.parquet"))


def _date(value: dt.date | dt.datetime | None) -> dt.date | None:
    return value.date() if isinstance(value, dt.datetime) else value


def inside(time: str, start: dt.date | dt.datetime | None, end: dt.date | dt.datetime | None, on_dates: bool = False) -> Column:
    """Does the timestamp column ``time`` (a date column if ``on_dates``) lie in [start, end]?  None is open; a date as ``end``
    includes that whole day.  Plain comparisons with constants, which reach the scan."""
    c, kind = F.col(time), "date" if on_dates else "timestamp_ntz"
    found = F.lit(True)
    if start is not None:
        found = found & (c >= F.lit(str(start)).cast(kind))
    if end is not None and not on_dates and not isinstance(end, dt.datetime):
        found = found & (c < F.lit(str(end + dt.timedelta(days=1))).cast(kind))
    elif end is not None:
        found = found & (c <= F.lit(str(end)).cast(kind))
    return found


def within(df: DataFrame, time: str, start, end, on_dates: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``time`` is :func:`inside` [start, end]."""
    return df if start is None and end is None else df.filter(inside(time, start, end, on_dates))
