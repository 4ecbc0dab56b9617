"""Hashed embeddings against a plain count of the words, and their time against one pass over the words."""

import math
import re
import time
from collections import Counter

import pytest
from loomdoc.operators import vectors as V
from pyspark.sql import functions as F

TEXTS = [None, "", " .,;\n", "one", "One two ONE, two; one", "Straße über naïve 東京 東京 café", "a1 b2-c3_d4  x y", " ".join(f"w{i % 97}" for i in range(5000))]


@pytest.mark.parametrize("dims", [64, 200])
def test_plain_counts(spark, dims):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(V.BLOCK + 500)]  # more than what is counted at once
    got = {r["doc_id"]: r["embedding"] for r in V.embed(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), dims=dims).collect()}
    words = [[w for w in re.split("[^a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if w] for t in TEXTS]
    slot = {r["w"]: r["h"] % dims for r in spark.createDataFrame([(w,) for w in {w for ws in words for w in ws}], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    want = []
    for ws in words:
        counts = Counter(slot[w] for w in ws)
        norm = math.sqrt(sum(n * n for n in counts.values()))
        want.append([counts[i] / norm if norm else 0.0 for i in range(dims)])
    assert got == {i: want[i % len(TEXTS)] for i, _ in rows}


def test_other_columns_stay_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x", "a b")], "doc_id bigint, source string, said string")
    assert V.embed(df, "said").columns == ["doc_id", "source", "said", "embedding"] and V.embed(df, "said").select("source").collect() == [("x",)]
    assert V.embed(df.where("doc_id > 1"), "said").collect() == []


def test_words_are_read_once(spark):
    docs = spark.range(4).select(F.expr("array_join(transform(sequence(1, 1000000), i -> concat('w', i % 9973 + id)), ' ')").alias("text")).cache()
    docs.count()

    def took(df):
        start = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - start

    embedded = V.embed(docs).select("embedding")
    took(embedded.limit(1))
    once = min(took(docs.select(F.size(F.split(F.lower("text"), "[^a-z0-9]+")).alias("n"))) for _ in range(3))
    assert took(embedded) < 10 * once + 2  # 64 times, where each dimension reads them
    docs.unpersist()
