"""Delivery tables derived from TPC-H-like tables (orders, lineitem, part, customer).

The metrics need a food-delivery event log that the test data does not hold
directly.  This module derives one deterministically, with integer arithmetic
only, so that the DuckDB oracle (``cartpulse.oracle``) derives identical rows:

=================  ==========================================================
quantity           rule (k = o_orderkey, u = o_custkey)
=================  ==========================================================
d0                 ``u % 14`` (first possible day of the user)
s                  ``(d0 + (k*31) % (16-d0)) * 86400 + (k*7919) % 86400``
creation_time      ``TS(s)``, TS(e) = 2022-08-24 00:00:00 + e seconds
product_ids        part keys of the order's lines ordered by
                   (l_linenumber, l_partkey); null when the order has no line
courier_id         ``min(l_suppkey)`` of the order
create row         every order, at TS(s)
cancel row         ``k % 19 = 0``, at TS(s + (k%40+1)*60)
accept row         ``k % 19 <> 0`` and the order has lines, TS(s + (3+k%7)*60)
deliver row        as accept and ``k % 23 <> 0``, accept + (12+k%18)*60 s
products           p_partkey, p_name, p_retailprice as DECIMAL(12,2)
=================  ==========================================================

Parameters used with these tables in tests and the oracle: campaign 1 is the
users with ``u % 28 = 8``, campaign 2 those with ``u % 28 = 22``; the reduced
VAT rate applies to product names whose second word is ``widget`` or ``rod``;
the product-share threshold is 1.5 %.

Plan shape: ``lineitem`` is hash-partitioned by order key and aggregated
once per order (one shuffle; an order has at most seven lines, so the
collected array is bounded), and joined to ``orders`` on the same key.  The user log needs ``orders`` only and
is produced in one pass with ``inline`` instead of a union of two scans.
"""

from __future__ import annotations

import os
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartpulse import schema as S
from cartpulse.sources.tables import DeliveryTables

EPOCH = "2022-08-24 00:00:00"
CAMPAIGN_RULE = {1: 8, 2: 22}  # campaign -> o_custkey % 28
CAMPAIGN_MODULUS = 28
REDUCED_VAT_SECOND_WORDS = ("widget", "rod")
SHARE_THRESHOLD = "1.5"
# Spend and monthly fixed costs of the registered queries: large enough that payback and
# break-even fall inside the data, with cents, and one campaign that never pays back.
TEST_SPEND = {1: Decimal("1000000.75"), 2: Decimal("5000000.50")}
TEST_FIXED_COSTS = (1500000, 2000000)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _ts(seconds: Column) -> Column:
    return F.timestamp_add("SECOND", seconds, F.lit(EPOCH).cast("timestamp_ntz"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: k, u, s, product_ids (null without lines), courier_id."""
    k, u = F.col("k"), F.col("u")
    base = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("u"))
    d0 = u % 14
    base = base.withColumn("s", (d0 + (k * 31) % (16 - d0)) * 86400 + (k * 7919) % 86400)
    # collect_list gains nothing from a map-side partial aggregate (it does
    # not shrink the rows), so the lines are hash-partitioned by order first:
    # the same single shuffle, and the per-order arrays are built in parallel
    # even when the input is one unsplittable file.
    lines = (
        _read(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
        .repartition("l_orderkey")
        .groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))),
                lambda x: x["l_partkey"],
            ).alias("product_ids"),
            F.min("l_suppkey").alias("courier_id"),
        )
    )
    return base.join(lines, "k", "left")


def tables_from_facts(facts: DataFrame, part: DataFrame) -> DeliveryTables:
    """The four delivery tables from :func:`order_facts` and the part table."""
    k, u, s = F.col("k"), F.col("u"), F.col("s")
    user_rows = F.array(
        F.struct(u.alias("user_id"), k.alias("order_id"), F.lit(S.CREATE_ORDER).alias("action"), _ts(s).alias("time")),
        F.when(
            k % 19 == 0,
            F.struct(
                u.alias("user_id"),
                k.alias("order_id"),
                F.lit(S.CANCEL_ORDER).alias("action"),
                _ts(s + (k % 40 + 1) * 60).alias("time"),
            ),
        ),
    )
    user_actions = facts.select(F.inline(F.filter(user_rows, lambda r: r.isNotNull())))

    orders = facts.select(
        k.alias("order_id"), _ts(s).alias("creation_time"), F.col("product_ids").cast("array<bigint>")
    )

    accept_s = s + (k % 7 + 3) * 60
    courier_rows = F.array(
        F.struct(
            F.col("courier_id"), k.alias("order_id"), F.lit(S.ACCEPT_ORDER).alias("action"), _ts(accept_s).alias("time")
        ),
        F.when(
            k % 23 != 0,
            F.struct(
                F.col("courier_id"),
                k.alias("order_id"),
                F.lit(S.DELIVER_ORDER).alias("action"),
                _ts(accept_s + (k % 18 + 12) * 60).alias("time"),
            ),
        ),
    )
    courier_actions = facts.filter((k % 19 != 0) & F.col("product_ids").isNotNull()).select(
        F.inline(F.filter(courier_rows, lambda r: r.isNotNull()))
    )

    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").cast(S.PRICE_TYPE).alias("price"),
    )
    return DeliveryTables(user_actions, courier_actions, orders, products).conformed()


def derive_tables(spark: SparkSession, sf_dir: str) -> DeliveryTables:
    """The four delivery tables derived lazily from ``sf_dir``'s parquet files."""
    return tables_from_facts(order_facts(spark, sf_dir), _read(spark, sf_dir, "part"))


def materialize_tables(spark: SparkSession, sf_dir: str, out: str, partitions: int | None = None) -> DeliveryTables:
    """Derive the tables and write them as parquet under ``out``; return readers.

    The per-order facts (the only shuffle: lineitem grouped by order) are
    written once, and the three order-keyed tables are derived from that
    written table, so the aggregation is not recomputed per table and the
    lineage is cut at a file.  ``out`` should be in the shared checkpoint
    folder (``session.scratch_dir``).
    """
    facts = order_facts(spark, sf_dir)
    if partitions:
        facts = facts.repartition(partitions, "k")
    facts_path = os.path.join(out, "_order_facts.parquet")
    facts.write.parquet(facts_path)
    tables = tables_from_facts(spark.read.parquet(facts_path), _read(spark, sf_dir, "part"))
    tables.write_parquet(out)
    return DeliveryTables.from_parquet(spark, out)


def campaign_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Campaign membership by rule on customer keys: (ads_campaign, user_id)."""
    cust = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    r = cust.user_id % CAMPAIGN_MODULUS
    campaign = F.when(r == CAMPAIGN_RULE[1], F.lit(1))
    for number, residue in CAMPAIGN_RULE.items():
        if number != 1:
            campaign = campaign.when(r == residue, F.lit(number))
    return (
        cust.filter(r.isin(list(CAMPAIGN_RULE.values())))
        .select(campaign.cast("int").alias("ads_campaign"), F.col("user_id").cast("bigint"))
    )


def reduced_vat_predicate() -> Column:
    """Test rule for the reduced VAT rate: second word of the name."""
    return F.split_part(F.col("name"), F.lit(" "), F.lit(2)).isin(*REDUCED_VAT_SECOND_WORDS)
