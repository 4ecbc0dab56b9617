"""Queries of this subpackage, each over its whole tables, and the SQL that states their results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, fim, mixing, neardup, oracles, pii, quality, sharding, substring, tokens, toxicity, urls, whitening
from .common import shared_dir, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "kept")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(_table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/loomdoc-{uuid.uuid4().hex}/token-files"
    tokens.write_ids(_table(spark, sf_dir, "documents"), out, _tokenizer(), end_id=1)
    return tokens.read_ids(spark, out, digest_only=True)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "epoch", "block", "mix_at")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in pii.PATTERNS], F.sha2(pii.span_text(base), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents")).drop("key")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = decontam.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return j.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op11_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"), _tokenizer())


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(written(fim.store(_table(spark, sf_dir, "documents")), "fim-store"))


QUERIES = [
    op1_near_duplicates,
    op2_toxicity,
    op3_substring_dedup,
    op4_url_filters,
    op5_token_files,
    op6_source_mixing,
    op7_personal_data,
    op8_sharding,
    op9_quality_rules,
    op10_decontamination,
    op11_byte_pairs,
    op12_whitening,
    op13_fill_in_middle,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op8_sharding": oracles.SHARDING, "op9_quality_rules": oracles.QUALITY, "op10_decontamination": oracles.DECONTAMINATION, "op13_fill_in_middle": oracles.FILL_IN_MIDDLE}
