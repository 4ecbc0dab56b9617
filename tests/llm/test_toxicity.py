"""Held-out accuracy, the sampling rules and the defined cases of the toxicity scores."""

import zlib

import pytest
from loomdoc.llm import toxicity


@pytest.fixture(scope="module")
def judged(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.judge(docs, labels).join(labels, "doc_id").collect()


def test_held_out_accuracy(judged):
    out = [r for r in judged if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in judged)
    caught = [r["predicted"] for r in out if r["toxic"] == 1]
    false = [r["predicted"] for r in out if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.7
    assert sum(false) / len(false) < 0.01


def test_nulls_ties_and_clashing_columns(spark):
    bad, good = "you utter nitwit of a man", "a walk in the park by the river"
    docs = spark.createDataFrame([(i, (bad if i % 4 == 0 else good) + f" n{i}", 9) for i in range(400)] + [(None, bad, 1), (None, None, 1), (1000, "", 1), (1001, None, 1), (1, good + " n1", 9)], "doc_id bigint, text string, score int")
    labels = spark.createDataFrame([(i, None if i % 7 == 3 else int(i % 4 == 0)) for i in range(300)] + [(None, 1)], "doc_id bigint, toxic int")
    got = toxicity.judge(docs, labels).collect()
    assert len(got) == 405
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len({(r["score"], r["predicted"]) for r in by[1]}) == 1 and len(by[1]) == 2
    assert by[1000][0]["score"] == by[1001][0]["score"] == min(r["score"] for r in by[None])
    assert all(by[i][0]["predicted"] == int(i % 4 == 0) for i in range(400))


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [(r["predicted"], r["held_out"]) for r in toxicity.judge(docs, labels).collect()] == [(0, zlib.crc32(b"1") % 4 == 2)]
    assert toxicity.judge(docs.limit(0), labels).count() == 0
