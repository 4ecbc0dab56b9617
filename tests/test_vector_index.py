"""The inverted-file index: recall against the exact search, exact scores, probes of all cells, odd rows."""

import numpy as np
import pytest
from loomdoc.operators import vector_index as I
from loomdoc.operators import vectors as V

DATA = "/root/testdata/sf0.01"


def rows_of(df):
    return sorted((r["qid"], r["collection"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    v = spark.read.parquet(f"{DATA}/embeddings.parquet")
    return v, I.build(v, f"file://{tmp_path_factory.mktemp('index')}", 15)


def test_recall_and_scores(spark, given):
    v, index = given
    q = v.where("vec_id % 50 = 0")
    exact, found = V.top_k(v, q, 15), I.search(index, q, 15)
    assert I.recall(found, exact).first()["recall"] >= 0.95
    score = {(r["qid"], r["id"]): round(r["score"], 6) for r in V.top_k(v, q, 1000).collect()}
    assert all(score[r["qid"], r["id"]] == round(r["score"], 6) for r in found.collect())


def test_all_cells_are_the_exact_search(given):
    v, index = given
    q = v.where("vec_id % 50 = 0")
    assert rows_of(I.search(index, q, 15, probes=len(index.centres))) == rows_of(V.top_k(v, q, 15))


@pytest.mark.parametrize("block", [1024, 4])
def test_hot_cell_ties_and_odd_rows(spark, tmp_path, monkeypatch, block):
    """A third of the rows are one vector; a cell of many blocks is dealt over several keys."""
    monkeypatch.setattr(I, "BLOCK", block)
    monkeypatch.setattr(I, "SPREAD", 2)
    r = np.random.default_rng(3)
    rows = [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else [float(x) for x in r.normal(size=3)], i % 2) for i in range(300)] + [(900, None, 1)]
    v = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    index = I.build(v, f"file://{tmp_path}/i", 5, cells=6)
    q = v.where("vec_id < 20 OR vec_id = 900")
    assert rows_of(I.search(index, q, 5, probes=6)) == rows_of(V.top_k(v.where("vec_id <> 900"), q.where("vec_id <> 900"), 5))
    assert I.recall(I.search(index, q, 5), V.top_k(v.where("vec_id <> 900"), q.where("vec_id <> 900"), 5)).first()["recall"] > 0.5


def test_empty(spark, tmp_path):
    v = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert I.build(v, f"file://{tmp_path}/e", 5) is None


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_numbers_by_blocks(spark, block):
    rows = [(i * 7 % 50, i % 3) for i in range(50)]
    got = V.numbered(spark.createDataFrame(rows, "vec_id bigint, label int").repartition(4), "label", "vec_id", "no", block).collect()
    want = {(v, g): n + 1 for g in range(3) for n, v in enumerate(sorted(v for v, x in rows if x == g))}
    assert {(r["vec_id"], r["label"]): r["no"] for r in got} == want


def test_questions_in_lots(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    q = spark.read.parquet(f"{DATA}/benchmark.parquet").selectExpr("item_id AS qid", "text")
    rows = lambda df: sorted((r["qid"], r["rank"], r["id"], round(r["score"], 6)) for r in df.collect())
    once, lots = V.bm25_top(docs, q, 4), V.bm25_top(docs, q, 4, most=15)
    assert rows(once) == rows(lots) and len(rows(once)) > 40
