"""The corpus pipeline against the plain versions of its stages, and on odd rows."""

import random
from collections import Counter

import brute
import corpus_pipeline
import duckdb
import pytest
from loomdoc.llm import oracles
from test_neardup import twins

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = "item_id bigint, text string"


def folder(spark, tmp_path, docs, items):
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def corpus():
    rnd = random.Random(8)
    text = lambda n: " ".join(f"w{rnd.randrange(4000)}" for _ in range(n))
    items = [(i, text(30)) for i in range(3)]
    rows = [text(rnd.randrange(40, 200)) for _ in range(60)]
    rows += [rows[0], rows[0].replace(" ", "  "), rows[1] + " one more", "too short", "", None, "again and again " * 40]
    rows += [text(60) + " " + items[k % 3][1] + " " + text(20) for k in range(4)]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4 // 2}", len(t or "")) for i, t in enumerate(rows)], items


def test_run(spark, tmp_path):
    docs, items = corpus()
    where = folder(spark, tmp_path, docs, items)
    got = corpus_pipeline.run(spark, where).collect()
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet/*.parquet'")
    kept = {r[0] for r in db.sql(f"SELECT doc_id FROM ({oracles.QUALITY}) WHERE kept").fetchall()}
    left = [d for d in docs if d[0] in kept]
    root = brute.joined(len(left), brute.near_pairs([d[1] for d in left], 0.8))
    left = [d for i, d in enumerate(left) if root[i] == i]
    hit = brute.op10([d[:2] for d in left], items)
    left = [d for d in left if not hit[d[0]][-1]]
    assert {r["doc_id"] for r in got} == {d[0] for d in left}
    assert {i for i, _ in Counter(d[0] for d in docs).items()} - {r["doc_id"] for r in got}, "every decision shows"
    words = lambda of: Counter({s: sum(len(brute.WORD.findall(d[1])) * n for d in left if d[3] == s and (n := of[d[0]])) for s in {d[3] for d in left}})
    once, times = words(Counter(d[0] for d in left)), words(Counter(r["doc_id"] for r in got))
    assert all(once[s] <= times[s] <= 2 * once[s] + 200 for s in once)  # at most MAX_EPOCHS passes, none lost


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, tmp_path, stage):
    """Null fields, empty texts, repeated rows and an empty table; all stages but the last keep the columns."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, "s", None), (3, "a b", "en", None, 3)]
    where = folder(spark, tmp_path, rows, [(None, None), (1, ""), (1, "a b c")])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    last = stage is corpus_pipeline.STAGES[-1][1]
    for d in (docs, docs.where("false")):
        out = stage(spark, d, where)
        assert last or out.columns == docs.columns
        assert out.count() <= 2 * d.count()


def test_one_of_each_near_pair_is_kept(spark):
    """Four hundred texts that begin alike, in pairs: splits of their bucket part some pairs."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(twins(200))], DOCS).repartition(3)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect()}
    assert kept == set(range(0, 400, 2))
