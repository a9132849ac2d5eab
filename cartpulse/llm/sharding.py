"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A row's key is hashed to 64 bits and jump hash maps that to a shard in
0..n-1 without any ring table.  With one more shard only the necessary
fraction 1/(n+1) of the keys moves, and every moved key goes to the new shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.common import numbered, positioned

LAW = "key"


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key, vectorised: all keys still jumping advance together."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), dtype=np.int64)
    to = np.zeros(len(key), dtype=np.int64)
    live = np.arange(len(key))
    while live.size:
        at[live] = to[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        to[live] = ((at[live] + 1) * step).astype(np.int64)
        live = live[to[live] < shards]
    return at.astype(np.int32)


def _jump(shards: int):
    @F.pandas_udf("struct<shard:int,grown_shard:int>")
    def both(key: pd.Series) -> pd.DataFrame:
        keys = key.to_numpy(dtype=np.int64).view(np.uint64)
        return pd.DataFrame({"shard": jump_hash(keys, shards), "grown_shard": jump_hash(keys, shards + 1)})

    return both


def with_shard(df: DataFrame, key: str, shards: int = 16) -> DataFrame:
    """``df`` plus ``shard`` and ``grown_shard`` (the shard were there one more).

    Only ``key`` and ``shards`` decide.  A null key is a key like any other.
    Columns of ``df`` with these names are replaced.  No shuffle.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "grown_shard")]
    return df.select(*kept, _jump(shards)(F.xxhash64(F.col(key))).alias("_jump")).select(
        *kept, F.col("_jump.shard").alias("shard"), F.col("_jump.grown_shard").alias("grown_shard")
    )


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """One narrow row per row of ``docs``: where it goes.

    ``key``, size (UTF-8 bytes of the text plus 1; null text: 1),
    text_crc32 (of the UTF-8 bytes; null text counts as empty: 0), law,
    shard, slot (0.. without gaps within the shard), grown_shard.  Repeated rows get a slot
    each; an empty table gives no row; other columns of ``docs`` play no part.
    A key held by a third of all rows lands in one shard (that is the law) but is
    numbered by many tasks.
    """
    narrow = docs.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
    )
    return numbered(positioned(with_shard(narrow, key, shards)), ["shard"], "slot").select(
        key, "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


def write_sharded(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 16, files: int = 4) -> None:
    """Write ``docs`` under ``path/shard=N``: each shard by ``files`` tasks, dealt by row position, not key."""
    salted = with_shard(docs, key, shards).withColumn("_salt", F.monotonically_increasing_id() % files)
    salted.repartition(shards * files, "shard", "_salt").drop("_salt", "grown_shard").write.partitionBy("shard").parquet(path)
