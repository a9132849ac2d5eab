"""Campaign membership joins (S8)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartpulse import schema as S


def members_from_ids(spark, ids: dict[int, list[int]]) -> DataFrame:
    """Membership DataFrame (ads_campaign, user_id) from per-campaign id lists,
    for campaigns whose audience is given as a list of user ids."""
    rows = [(int(c), int(u)) for c, users in sorted(ids.items()) for u in users]
    return spark.createDataFrame(rows, S.CAMPAIGN_MEMBERS)


def members_side(members: DataFrame) -> DataFrame:
    """Membership (ads_campaign, user_id): typed, without null users, each pair once.

    An id list is a set, so a member named twice counts once.
    """
    return S.conform(members, S.CAMPAIGN_MEMBERS, "campaign_members").filter(F.col("user_id").isNotNull()).distinct()


def with_campaign(df: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``user_id`` is a campaign member, plus ``ads_campaign``.

    A user in two campaigns yields one row per campaign, as evaluating each
    campaign's ``user_id IN (...)`` list separately does.
    """
    return df.join(members, "user_id", "inner")


def campaign_label(number: Column | str, prefix: str) -> Column:
    """Text label 'prefix' + campaign number."""
    c = F.col(number) if isinstance(number, str) else number
    return F.concat(F.lit(prefix), c.cast("string"))


def by_campaign(number: str, values: dict[int, Column]) -> Column:
    """A parameter's value for the campaign numbered ``number``, null for one without: a CASE, no join."""
    found = F.lit(None)
    for campaign, value in sorted(values.items()):
        found = F.when(F.col(number) == F.lit(int(campaign)), value).otherwise(found)
    return found


def _cents(campaign: int, amount) -> Decimal:
    value = Decimal(str(amount))
    if value != value.quantize(Decimal("0.01")):
        raise ValueError(f"campaign {campaign}: spend {amount} has fractions of a cent")
    return value.quantize(Decimal("0.01"))


def campaign_spend(number: str, spend: dict[int, Decimal]) -> Column:
    """Spend of the campaign numbered ``number``, DECIMAL(20,2), null for one without.  More than two decimals raise."""
    return by_campaign(number, {c: F.lit(_cents(c, amount)) for c, amount in spend.items()}).cast("decimal(20,2)")


def campaign_dim(spark, spend: dict[int, Decimal]) -> DataFrame:
    """The campaigns as a small DataFrame: ads_campaign INT, spend DECIMAL(20,2).

    Built from a parameter with a handful of entries, so it is broadcast.
    Spend keeps its cents; more than two decimals raise.
    """
    rows = [(int(number), _cents(number, amount)) for number, amount in sorted(spend.items())]
    return F.broadcast(spark.createDataFrame(rows, "ads_campaign int, spend decimal(20,2)"))
