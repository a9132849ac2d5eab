"""The queries over the test tables, one per operator, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cartpulse.llm import (
    article_text,
    cotraining,
    decontamination,
    langid,
    licenses,
    packing,
    pii,
    prefix_trie,
    sharding,
    signature_tree,
    toxicity,
    vector_codes,
    vector_forest,
)
from cartpulse.llm.common import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"))


def op2_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licenses.scan(docs).unionByName(licenses.windows(docs)).drop("body")


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumn("held_out", langid.held_out())
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_template_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("text_hash")


def op7_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotraining.score(docs, cotraining.train(docs, _table(spark, sf_dir, "labels")))


def op8_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.jaccard_components(_table(spark, sf_dir, "documents"), n=3, num=9, den=10)


def op9_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_text.main_text(_table(spark, sf_dir, "pages"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jump_shards": op1_jump_shards,
    "op2_projection_forest": op2_projection_forest,
    "op3_license_dice": op3_license_dice,
    "op4_disclosure": op4_disclosure,
    "op5_toxicity": op5_toxicity,
    "op6_template_windows": op6_template_windows,
    "op7_co_training": op7_co_training,
    "op8_signature_trees": op8_signature_trees,
    "op9_linear_grouping": op9_linear_grouping,
    "op10_language": op10_language,
    "op11_vector_codes": op11_vector_codes,
    "op12_host_paths": op12_host_paths,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op3_license_dice": licenses.oracle(),
    "op6_template_windows": decontamination.oracle(),
}
