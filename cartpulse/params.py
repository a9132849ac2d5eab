"""Business parameters of the metrics (tariffs, VAT, campaigns, windows).

The constants the original analysis wrote into its queries are parameters
here, with the original value as the default.  Its lists of campaign members are data
(a table), and its payer counts are computed unless given.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from decimal import Decimal

# ---------------------------------------------------------------------------
# Fixed values (must equal the original analysis for equal results).
# ---------------------------------------------------------------------------

# Courier pay: per delivered order, and a daily bonus once a courier makes at
# least this many deliveries in a day.
PAY_PER_DELIVERY = 150
BONUS_MIN_DELIVERIES = 5

# Monthly tariffs: (month start, assembly cost per non-cancelled user action,
# fixed costs per day, courier daily bonus).
TARIFF_ROWS = [
    (dt.date(2022, 8, 1), 140, 120000, 400),
    (dt.date(2022, 9, 1), 115, 150000, 500),
]

# VAT: reduced rate 10/110 for these product names, standard rate 20/120
# for every other product.
REDUCED_VAT_NAMES = [
    "сахар", "сухарики", "сушки", "семечки", "масло льняное", "виноград",
    "масло оливковое", "арбуз", "батон", "йогурт", "сливки", "гречка",
    "овсянка", "макароны", "баранина", "апельсины", "бублики", "хлеб", "горох",
    "сметана", "рыба копченая", "мука", "шпроты", "сосиски", "свинина", "рис",
    "масло кунжутное", "сгущенка", "ананас", "говядина", "соль", "рыба вяленая",
    "масло подсолнечное", "яблоки", "груши", "лепешка", "молоко", "курица",
    "лаваш", "вафли", "мандарины",
]
REDUCED_VAT_RATE = (10, 110)
STANDARD_VAT_RATE = (20, 120)

# Product revenue share: names below this share (percent) are merged.
OTHER_SHARE_THRESHOLD = "0.5"
OTHER_LABEL = "ДРУГОЕ"

# Campaign labels: the CAC report writes no space after the sign, the other
# campaign reports write one.
CAMPAIGN_LABEL_TIGHT = "Кампания №"
CAMPAIGN_LABEL_SPACED = "Кампания № "
CAMPAIGN_SPEND = 250000

# Report windows.
WEEKDAY_FROM = dt.datetime(2022, 8, 26, 0, 0, 0)
WEEKDAY_TO = dt.datetime(2023, 9, 8, 23, 59, 59, 999000)
AVG_CHECK_FROM = dt.date(2022, 9, 1)
AVG_CHECK_TO = dt.date(2022, 9, 7)
RETENTION_START = dt.date(2022, 9, 1)
RETENTION_DAYS = (0, 1, 7)

# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Tariff:
    month: dt.date
    assembly_per_action: int
    fixed_per_day: int
    courier_bonus: int


@dataclass(frozen=True)
class CostModel:
    """Courier pay, assembly and fixed costs, VAT rates."""

    tariffs: tuple[Tariff, ...] = tuple(Tariff(*row) for row in TARIFF_ROWS)
    pay_per_delivery: int = PAY_PER_DELIVERY
    bonus_min_deliveries: int = BONUS_MIN_DELIVERIES
    reduced_vat_rate: tuple[int, int] = REDUCED_VAT_RATE
    standard_vat_rate: tuple[int, int] = STANDARD_VAT_RATE


@dataclass(frozen=True)
class Campaigns:
    """Advertising campaigns: spend per campaign number.

    Membership (campaign number -> user ids) is a DataFrame passed next to
    this, since member lists are data, not code.
    """

    spend: dict[int, Decimal | int | str] = field(default_factory=lambda: {1: CAMPAIGN_SPEND, 2: CAMPAIGN_SPEND})
