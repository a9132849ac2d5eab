"""Join helpers.

No helper hints a broadcast: Spark's byte threshold, and AQE with the sizes
it has measured, pick the join; a skewed side is split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join_known(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df`` left-joined to ``other`` on ``key``; rows with a null key go past the join with nulls for ``other``'s columns.

    A null key matches nothing, but a shuffled left join gathers all its rows in one task.  Here they never reach an
    exchange: ``IS NULL`` is a second, filtered read of ``df``, which skips row groups without nulls.
    """
    new = [f for f in other.schema.fields if f.name != key]
    known = df.filter(F.col(key).isNotNull()).join(other, key, "left")
    unknown = df.filter(F.col(key).isNull()).select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    return known.unionByName(unknown)


def flag_join(df: DataFrame, ids: DataFrame, key: str, flag: str) -> DataFrame:
    """Left-join a set of distinct ``key`` values as a boolean column ``flag``.

    Rows whose key is not in ``ids`` (or is null) get ``False``.  This is how
    an aggregate ``FILTER (WHERE key [NOT] IN (subquery))`` is rewritten: a
    nested-loop existence join over all rows is avoided, and the planner picks
    broadcast or sort-merge for the equi-join by size.
    """
    marked = ids.select(key).withColumn(flag, F.lit(True))
    return left_join_known(df, marked, key).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
