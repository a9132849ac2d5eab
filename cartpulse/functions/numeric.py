"""Exact decimal ratios with half-away-from-zero rounding.

The metrics round ratios of counts and money to 2 or 3 places.  Spark's
decimal division first rounds the quotient to a scale chosen by its precision
rules (often only 6 digits), and a second ``round`` on top of that can cross
a half-way point the exact quotient does not reach (double rounding).  These
helpers avoid that: both operands are turned into integers (counts, cents)
and the remainder is taken off before dividing,
so the result is exactly ``round(factor * num / den, places)`` with HALF_UP,
the rounding of SQL NUMERIC.

Operands are SQL expression texts (usually column names) and each helper
returns one ``Column`` built by a single ``expr`` call: the expression tree
is the same as one composed from ``functions.*`` calls, but it costs one
round trip to the JVM instead of dozens.  Everything stays a built-in,
codegen-able expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INT = "DECIMAL(38,0)"


def units_sql(c: str, scale: int = 0) -> str:
    """``c * 10**scale`` as an integral DECIMAL(38,0): cents for money (scale 2)."""
    if scale:
        return f"CAST(({c}) * {10**scale} AS {_INT})"
    return f"CAST(({c}) AS {_INT})"


def half_up_div_sql(num: str, den: str, int_type: str = _INT) -> str:
    """SQL text: integer quotient ``num / den`` rounded half away from zero.

    Both operands must be integral.  A zero denominator raises under ANSI
    mode, as NUMERIC division does.  The quotient stays DECIMAL(38,0): the
    remainder is taken off first, so the decimal division is exact, and a value
    beyond 38 digits raises under ANSI mode (SQL ``div`` would return BIGINT and
    wrap).  ``int_type`` BIGINT (primitive arithmetic, BIGINT result) is for
    operands known to stay far below 2**62.
    """
    n, d = f"CAST(({num}) AS {int_type})", f"CAST(({den}) AS {int_type})"
    top, twice = f"(abs({n}) * 2 + abs({d}))", f"(abs({d}) * 2)"
    if int_type == _INT:
        q = f"CAST(({top} - {top} % {twice}) / {twice} AS {_INT})"
    else:
        q = f"({top} div {twice})"
    return f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -{q} ELSE {q} END)"


def with_scale_sql(q: str, places: int) -> str:
    """SQL text: integer ``q`` read as ``q * 10**-places``, exactly."""
    if places == 0:
        return f"CAST(({q}) AS {_INT})"
    step = "0." + "0" * (places - 1) + "1"
    return f"(CAST(({q}) AS DECIMAL({37 - places},0)) * {step})"


def round_div_sql(num: str, den: str, places: int, factor: int = 1) -> str:
    scaled = f"(CAST(({num}) AS {_INT}) * {factor * 10**places})"
    return with_scale_sql(half_up_div_sql(scaled, den), places)


def half_up_div(num: str, den: str, int_type: str = _INT) -> Column:
    """Integer ``num / den`` rounded half away from zero."""
    return F.expr(half_up_div_sql(num, den, int_type))


def with_scale(q: str, places: int) -> Column:
    """Integer ``q`` read as ``q * 10**-places`` (DECIMAL(.., places))."""
    return F.expr(with_scale_sql(q, places))


def round_div(num: str, den: str, places: int, factor: int = 1) -> Column:
    """``round(factor * num / den, places)``, HALF_UP, exact; ``num``/``den`` integral."""
    return F.expr(round_div_sql(num, den, places, factor))


def pct(num: str, den: str, places: int = 2) -> Column:
    """Percentage ``round(100 * num / den, places)`` of two integral expressions."""
    return round_div(num, den, places, factor=100)


def money_ratio(money: str, count: str, places: int = 2) -> Column:
    """``round(money / count, places)`` for a DECIMAL(.,2) amount and an integer count."""
    return F.expr(
        with_scale_sql(half_up_div_sql(f"{units_sql(money, 2)} * {10**places}", f"({count}) * 100"), places)
    )


def money_pct(part: str, whole: str, places: int = 2) -> Column:
    """``round(100 * part / whole, places)`` for two DECIMAL(.,2) amounts."""
    return pct(units_sql(part, 2), units_sql(whole, 2), places)
