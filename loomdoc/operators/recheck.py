"""Bounded rounds over pages that came out empty: what is still missing is tried again, until nothing is or the rounds are used up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 3


def missing(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_num, text, is_blank, error) without text that are marked blank or have an error."""
    none = F.coalesce(F.trim("text"), F.lit("")) == ""
    return pages.where(none & (F.coalesce("is_blank", F.lit(False)) | (F.coalesce("error", F.lit("")) != "")))


def rechecked(pages: DataFrame, extract: Callable[[DataFrame, int], DataFrame], out: str, rounds: int = ROUNDS) -> tuple[DataFrame, int]:
    """The pages with attempts, the rounds in which each was tried again, and how many rounds there were.

    extract: (pages to try (doc_id, page_num), round) -> pages; those that it doesn't give keep what they have. Each round's state is written to out, so that
    a lost executor costs its own round's tasks alone.
    """
    spark, columns = pages.sparkSession, ["doc_id", "page_num", "text", "is_blank", "error"]
    state = pages.select(*columns, F.lit(0).alias("attempts"))
    for n in range(rounds + 1):
        state.write.mode("overwrite").parquet(f"{out}/round-{n}")
        state = spark.read.schema(state.schema).parquet(f"{out}/round-{n}")
        todo = missing(state).select("doc_id", "page_num", "attempts")
        if n == rounds or todo.isEmpty():
            return state, n
        tried = extract(todo.select("doc_id", "page_num"), n + 1).select(*[F.col(c).alias(f"new_{c}") if c not in ("doc_id", "page_num") else c for c in columns], F.lit(True).alias("came"))
        j = state.join(todo.select("doc_id", "page_num", F.lit(1).alias("again")), ["doc_id", "page_num"], "left").join(tried, ["doc_id", "page_num"], "left")
        fresh = F.col("again").isNotNull() & F.coalesce("came", F.lit(False))
        state = j.select("doc_id", "page_num", *[F.when(fresh, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in columns[2:]], (F.col("attempts") + F.coalesce("again", F.lit(0))).alias("attempts"))
    raise AssertionError("the last round returns")
