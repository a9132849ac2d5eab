"""Every registered query equals its DuckDB oracle on the sf0.001 tables."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

import __spark_entry__ as entry
from cartpulse.plans.registry import queries
from tools.check_oracle import canon, duck

NAMES = sorted(queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(entry.queries()) and set(NAMES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(NAMES) == 36  # 20 metrics, 3 readouts, 4 readings of the prose, 9 building blocks


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(entry.oracle_sql()[name])
    d_names = [c[0] for c in res.description]
    d_rows = res.fetchall()
    assert sorted(df.columns) == sorted(d_names)
    assert len(s_rows) == len(d_rows)
    assert canon(df.columns, s_rows) == canon(d_names, d_rows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "revenue", "total_revenue", "revenue_change"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["hourly_cancel_rate", "weekday_arpu", "delivery_time", "retention"])
def test_results_do_not_depend_on_session_zone_or_ansi(spark, con, name):
    prev = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled")}
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        df = entry.queries()[name](spark, SF_SMALL)
        s_rows = [tuple(r) for r in df.collect()]
    finally:
        for k, v in prev.items():
            spark.conf.set(k, v)
    res = con.execute(entry.oracle_sql()[name])
    assert canon(df.columns, s_rows) == canon([c[0] for c in res.description], res.fetchall())
