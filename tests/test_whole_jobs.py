"""Queries see all of their input: hits, texts and words that a cut would lose."""

import pytest
from loomdoc import plans
from loomdoc.operators import vectors as V

DATA = "/root/testdata/sf0.001"


def test_search_sees_all_documents_and_queries(spark):
    docs = spark.createDataFrame([(i, f"common w{i} w{i} x{i % 7}") for i in range(300)], "doc_id bigint, text string").repartition(5)
    asked = spark.createDataFrame([(i, f"w{(i * 131) % 300} common") for i in range(250)], "qid bigint, text string")
    want = {}
    for r in V.bm25(docs, asked).collect():
        want.setdefault(r["qid"], []).append((-r["score"], r["doc_id"]))
    want = {(q, i + 1, d) for q, hits in want.items() for i, (_, d) in enumerate(sorted(hits)[:3])}
    got = {(r["qid"], r["rank"], r["id"]) for r in V.bm25_top(docs, asked, 3, block=64).collect()}
    assert len(got) == 750 and got == want
    assert all((i, 1, (i * 131) % 300) in got for i in range(250))


def test_every_item_is_reranked(spark):
    items = {r[0] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id").collect()}
    got = plans.QUERIES["g9_reranked_search"](spark, DATA).collect()
    assert {r["qid"] for r in got} == items
    assert any(r["id"] % 40 != r["qid"] % 40 for r in got)


def test_contexts_hold_whole_texts(spark):
    texts = {f"[chk_{r['doc_id']}] ": r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").count()
    got = plans.QUERIES["h10_h11_question_context"](spark, DATA).collect()
    assert len(got) == items
    for r in got:
        held = [k + t for k, t in texts.items() if k in r["context"]]
        assert 0 < len(held) <= 8 and len(r["context"]) == sum(map(len, held)) + 5 * (len(held) - 1)
        assert all(t in r["context"] for t in held)
