"""Exact HALF_UP ratios against Python's decimal arithmetic."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from cartpulse.functions.numeric import money_pct, money_ratio, pct, round_div


def expected(num: int, den: int, places: int, factor: int = 1) -> Decimal:
    q = Decimal(factor * num) / Decimal(den)
    return q.quantize(Decimal(1).scaleb(-places), rounding=ROUND_HALF_UP)


@settings(max_examples=25, deadline=None)
@given(
    st.lists(
        st.tuples(st.integers(-(10**12), 10**12), st.integers(1, 10**9).map(lambda x: x * (1 if x % 3 else -1))),
        min_size=1,
        max_size=40,
    )
)
def test_round_div_matches_decimal(spark, pairs):
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    got = df.select("n", "d", round_div("n", "d", 2).alias("r2"), pct("n", "d", 3).alias("p3")).collect()
    for r in got:
        assert r["r2"] == expected(r["n"], r["d"], 2)
        assert r["p3"] == expected(r["n"], r["d"], 3, 100)


def test_half_way_cases(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (5, 2), (-5, 2), (201, 200), (1, 3)], "n bigint, d bigint")
    got = [r[0] for r in df.select(round_div("n", "d", 2)).collect()]
    assert got == [Decimal("0.13"), Decimal("-0.13"), Decimal("2.50"), Decimal("-2.50"), Decimal("1.01"), Decimal("0.33")]


def test_money_helpers(spark):
    df = spark.createDataFrame([(Decimal("230.00"), 3, Decimal("690.00"))], "m decimal(22,2), n bigint, w decimal(22,2)")
    r = df.select(money_ratio("m", "n").alias("a"), money_pct("m", "w").alias("b")).first()
    assert r["a"] == Decimal("76.67")
    assert r["b"] == Decimal("33.33")
