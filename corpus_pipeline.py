"""A training corpus from documents: quality rules, near-duplicates, benchmark passages, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before the next one. All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from loomdoc.llm import decontam, mixing, neardup, quality, sharding
from loomdoc.llm.common import shared_dir
from pyspark.sql import DataFrame, SparkSession


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the rules; those without text fail them, repeated rows are kept or go together."""
    return quality.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, the one with the least id; documents without words are classes of their own, repeated rows copies."""
    return neardup.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words are benchmark passages; documents and items without words match nothing."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of small sources up to twice; a null source is one source, and one without words stays as it is."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds slot and shard; equal ids meet in one shard, a null id is placed as the empty string."""
    return sharding.assign_shards(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source mixing", source_mixing),
    ("sharding", shards),
]

#: Weighted near-duplicate classes have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on all that the one before kept. An empty table gives an empty result."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/loomdoc-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/stage-{i}")
        docs = spark.read.parquet(f"{folder}/stage-{i}")
    return docs
