"""Batch job: run metrics over stored tables and write the result tables.

    python -m cartpulse --tables /data/delivery --members /data/members \\
        --out /data/metrics [--metrics daily_revenue,retention] [--format parquet]

``--tables`` holds ``<table>.parquet`` folders (or use ``--database`` for
catalog tables, e.g. the bucketed layout); ``--members`` is a parquet folder
of (ads_campaign, user_id), needed by the campaign metrics only.  Each metric
is written to ``<out>/<metric>`` by Spark's writers (no result passes
through the driver).  Parameters default to the original analysis' values.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import os
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from cartpulse import params as P
from cartpulse.operators.blocks import write_shared
from cartpulse.plans import audience as A
from cartpulse.plans import marketing as M
from cartpulse.plans import readouts as D
from cartpulse.plans import revenue as R
from cartpulse.session import SCALE_CONF, has_checkpoint_dir, remove_dir, scratch_dir
from cartpulse.sources.tables import DeliveryTables

Metric = Callable[..., DataFrame]

# name -> (function, needs campaign members)
METRIC_FUNCTIONS: dict[str, tuple[Metric, bool]] = {
    "audience_growth": (A.audience_growth, False),
    "audience_growth_rates": (A.audience_growth_rates, False),
    "active_audience": (A.active_audience, False),
    "order_frequency_shares": (A.order_frequency_shares, False),
    "courier_load": (A.courier_load, False),
    "delivery_time": (A.delivery_time, False),
    "hourly_cancel_rate": (A.hourly_cancel_rate, False),
    "daily_revenue": (R.daily_revenue, False),
    "daily_arpu": (R.daily_arpu, False),
    "running_arpu": (R.running_arpu, False),
    "weekday_arpu": (R.weekday_arpu, False),
    "new_user_revenue": (R.new_user_revenue, False),
    "product_revenue_share": (R.product_revenue_share, False),
    "gross_profit": (R.gross_profit, False),
    "campaign_cac": (M.campaign_cac, True),
    "campaign_roi": (M.campaign_roi, True),
    "campaign_avg_check": (M.campaign_avg_check, True),
    "retention": (M.retention, False),
    "campaign_retention": (M.campaign_retention, True),
    "campaign_payback": (M.campaign_payback, True),
    "campaign_payback_day": (D.campaign_payback_day, True),
    "break_even_dates": (D.break_even_dates, False),
    "peak_hours": (D.peak_hours, False),
}

_CAMPAIGN_ARGS = {"campaign_cac", "campaign_roi", "campaign_payback", "campaign_payback_day"}


def run_metric(
    name: str,
    tables: DeliveryTables,
    members: DataFrame | None = None,
    campaigns: P.Campaigns | None = None,
    threshold: str | None = None,
    reduced_vat=None,
    cost: P.CostModel | None = None,
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """One metric with the job's parameters (None keeps a metric's default).

    ``reduced_vat`` (names or a Column on ``name``) and ``cost`` apply to the
    gross profit and its break-even readout.  ``options`` holds further keyword
    arguments by metric name (report windows, labels, ``delivered_only``, ...).
    """
    fn, needs_members = METRIC_FUNCTIONS[name]
    args: list = [tables]
    kwargs: dict = {}
    if needs_members:
        if members is None:
            raise ValueError(f"{name} needs campaign members (--members)")
        args.append(members)
        if campaigns is not None and name in _CAMPAIGN_ARGS:
            kwargs["campaigns"] = campaigns
    if name == "product_revenue_share" and threshold is not None:
        kwargs["threshold"] = threshold
    if name in ("gross_profit", "break_even_dates") and reduced_vat is not None:
        kwargs["reduced_vat"] = reduced_vat
    if name in ("gross_profit", "break_even_dates") and cost is not None:
        kwargs["cost"] = cost
    kwargs.update((options or {}).get(name, {}))
    return fn(*args, **kwargs)


def register_views(
    spark: SparkSession,
    tables: DeliveryTables,
    members: DataFrame | None = None,
    campaigns: P.Campaigns | None = None,
    prefix: str = "",
    cost: P.CostModel | None = None,
    options: dict[str, dict] | None = None,
) -> list[str]:
    """Register the four tables and every applicable metric as temporary views.

    ``spark.sql("SELECT * FROM daily_revenue WHERE revenue_change < 0")``
    then runs the metric's plan with the extra clauses on top; nothing is
    computed at registration.  Returns the view names.
    """
    names = []
    for table in ("user_actions", "courier_actions", "orders", "products"):
        getattr(tables, table).createOrReplaceTempView(prefix + table)
        names.append(prefix + table)
    if members is not None:
        members.createOrReplaceTempView(prefix + "campaign_members")
        names.append(prefix + "campaign_members")
    for name, (_, needs_members) in METRIC_FUNCTIONS.items():
        if needs_members and members is None:
            continue
        run_metric(name, tables, members, campaigns, cost=cost, options=options).createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names


def run_job(
    spark: SparkSession,
    tables: DeliveryTables,
    out: str,
    names: list[str] | None = None,
    members: DataFrame | None = None,
    campaigns: P.Campaigns | None = None,
    threshold: str | None = None,
    fmt: str = "parquet",
    cost: P.CostModel | None = None,
    options: dict[str, dict] | None = None,
) -> list[str]:
    """Write each metric to ``<out>/<name>``; returns the names written.

    Campaign metrics are skipped when no members are given and no explicit
    list of names asks for them.  A run of several metrics writes the blocks they
    share (flagged user log, user and courier days, order totals, units) once
    under the session's checkpoint folder, reads them in every metric, and
    deletes them at the end, also after a failure; without such a folder every metric derives its own.
    """
    chosen = names or [n for n, (_, needs) in METRIC_FUNCTIONS.items() if members is not None or not needs]
    folder = scratch_dir(spark, "shared-blocks") if len(chosen) > 1 and has_checkpoint_dir(spark) else None
    try:
        if folder:
            tables = write_shared(tables, folder)
        for name in chosen:
            df = run_metric(name, tables, members, campaigns, threshold, cost=cost, options=options)
            writer = df.write.mode("overwrite").format(fmt)
            if fmt == "csv":
                writer = writer.option("header", "true")
            writer.save(os.path.join(out, name))
    finally:
        if folder:
            remove_dir(spark, folder)
    return chosen


# Report parameters that the command line may give, as JSON, by metric; dates and times as ISO text.
_DATE_OPTIONS = {"start", "end", "start_date"}


def parse_options(text: str) -> dict[str, dict]:
    """``{"campaign_avg_check": {"start": "2024-01-01", ...}, ...}`` as keyword arguments of the metrics."""
    out = {}
    for name, given in json.loads(text).items():
        if name not in METRIC_FUNCTIONS:
            raise ValueError(f"unknown metric: {name}")
        kwargs = {}
        for key, value in given.items():
            if key in _DATE_OPTIONS:
                value = dt.datetime.fromisoformat(value) if len(value) > 10 else dt.date.fromisoformat(value)
            elif key == "days":
                value = tuple(int(x) for x in value)
            elif key == "payers":
                value = {int(k): int(v) for k, v in value.items()}
            kwargs[key] = value
        out[name] = kwargs
    return out


def parse_tariffs(text: str) -> P.CostModel:
    """``[["2024-01-01", assembly, fixed per day, courier bonus], ...]`` as a cost model."""
    rows = [P.Tariff(dt.date.fromisoformat(month), *map(int, rest)) for month, *rest in json.loads(text)]
    return P.CostModel(tariffs=tuple(rows))


def write_layout(tables: DeliveryTables, database: str, buckets: int, files_per_date: int = 8) -> None:
    """Save the tables bucketed by ``order_id`` in ``database``, and the logs and orders also by date (``<table>_by_date``).

    ``DeliveryTables.from_catalog`` finds both: joins by order read the buckets, metrics over a time window the dates.
    """
    tables.spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    tables.write_bucketed(database, buckets)
    tables.write_by_date(database, files_per_date=files_per_date)


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cartpulse", description=__doc__.split("\n\n")[0])
    src = ap.add_mutually_exclusive_group(required=True)
    src.add_argument("--tables", help="folder with <table>.parquet folders")
    src.add_argument("--database", help="catalog database holding the four tables")
    ap.add_argument("--members", help="parquet folder of (ads_campaign, user_id)")
    ap.add_argument("--exact-not-in", action="store_true", help="SQL's NOT IN rules where the cancelled ids are none or hold a null")
    ap.add_argument("--out", help="output folder; one sub-folder per metric")
    ap.add_argument("--layout", help="instead of metrics: save the tables in this catalog database, bucketed by order and by date")
    ap.add_argument("--buckets", type=int, default=256, help="buckets of --layout")
    ap.add_argument("--tariffs", help='monthly tariffs as JSON: [["2022-08-01", 140, 120000, 400], ...]')
    ap.add_argument("--options", help='report parameters as JSON by metric: {"campaign_avg_check": {"start": "2022-09-01"}}')
    ap.add_argument("--metrics", help="comma-separated metric names (default: all that apply)")
    ap.add_argument("--format", default="parquet", choices=["parquet", "csv", "json", "orc"])
    ap.add_argument("--spend", help='campaign spend as JSON, e.g. {"1": 250000, "2": 250000}')
    ap.add_argument("--threshold", help="product share threshold in percent (default 0.5)")
    args = ap.parse_args(argv)
    names = [n.strip() for n in args.metrics.split(",")] if args.metrics else None
    if not args.out and not args.layout:
        ap.error("--out or --layout is needed")
    unknown = sorted(set(names or []) - set(METRIC_FUNCTIONS))
    if unknown:
        ap.error(f"unknown metrics: {unknown}; known: {sorted(METRIC_FUNCTIONS)}")

    builder = SparkSession.builder.appName("cartpulse")
    for key, value in SCALE_CONF.items():  # AQE, skew join, UTC, no UI
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if args.tables:
        tables = DeliveryTables.from_parquet(spark, args.tables, exact_not_in=args.exact_not_in)
    else:
        tables = DeliveryTables.from_catalog(spark, args.database, exact_not_in=args.exact_not_in)
    if args.layout:
        write_layout(tables, args.layout, args.buckets)
        return
    members = spark.read.parquet(args.members) if args.members else None
    spend = json.loads(args.spend, parse_float=Decimal) if args.spend else None
    campaigns = P.Campaigns(spend={int(k): Decimal(str(v)) for k, v in spend.items()}) if spend else None
    cost = parse_tariffs(args.tariffs) if args.tariffs else None
    options = parse_options(args.options) if args.options else None
    run_job(spark, tables, args.out, names, members, campaigns, args.threshold, args.format, cost, options)
