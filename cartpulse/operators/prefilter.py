"""Dropping most rows that a join would not match before they are shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# 64-bit words of a filter: what is broadcast is at most this many pairs of numbers, whatever the ids.
FILTER_WORDS = 1 << 18


def _word(key: str, words: int) -> Column:
    """The word a key falls in."""
    return F.pmod(F.xxhash64(key), F.lit(words))


def _bits(key: str) -> Column:
    """A key's three bits within its word, from other bits of the hash."""
    h = F.xxhash64(key)
    one = F.lit(1).cast("long")

    def bit(at: int) -> Column:
        return F.call_function("shiftleft", one, F.shiftrightunsigned(h, at).bitwiseAND(F.lit(63)).cast("int"))

    return bit(40).bitwiseOR(bit(46)).bitwiseOR(bit(52))


def id_filter(ids: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """A blocked Bloom filter of the ids: word, bits (three per id), at most ``words`` rows however many ids.

    Built by one aggregation with map-side combining; each task sends at most ``words`` rows.
    """
    known = ids.filter(F.col(key).isNotNull())
    return known.groupBy(_word(key, words).alias("word")).agg(F.bit_or(_bits(key)).alias("bits"))


def maybe_among(df: DataFrame, ids: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``ids``: all that are, and a few others; rows with a null key are dropped.

    To be put before a join of ``df`` to ``ids`` that keeps matches only: the rows are tested where they are scanned, so
    those that can't match are never shuffled.  The filter is broadcast, at most ``words`` rows of two numbers (a proven
    bound); with far more ids than bits it lets everything pass and the join alone decides.
    """
    found, met = _tested(ids, key, words)
    return df.filter(F.col(key).isNotNull()).join(found, met, "left_semi")


def surely_not_among(df: DataFrame, ids: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """The rows of ``df`` that ``maybe_among`` leaves out: no id is theirs, so an anti join need not shuffle them."""
    found, met = _tested(ids, key, words)
    return df.join(found, F.col(key).isNotNull() & met, "left_anti")


def _tested(ids: DataFrame, key: str, words: int) -> tuple[DataFrame, Column]:
    """The filter of the ids, to be broadcast, and its test of a key."""
    found = F.broadcast(id_filter(ids, key, words))
    return found, (_word(key, words) == found["word"]) & (_bits(key).bitwiseAND(found["bits"]) == _bits(key))
