"""Ingest streams that stop, start again and repeat a batch, against one pass over everything."""

import os

from loomdoc.streaming import news, stages
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def day():
    return F.expr("date_add(DATE '2024-01-01', cast(page_id % 30 as int))")


def pages(folder, rows):
    rows.coalesce(1).write.mode("append").parquet(f"{folder}/pages.parquet")


def rows_of(df):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect())


def test_news_stopped_and_started_again(spark, tmp_path):
    every = spark.read.parquet(f"{DATA}/pages.parquet")
    src, out, cp = f"{tmp_path}/src", f"{tmp_path}/points", f"{tmp_path}/cp"
    pages(src, every.where("page_id % 3 = 0"))
    news.ingest(news.pages_stream(spark, src, files=1), out, cp, day())
    first = news.current(spark, out).count()
    # later pages: new ones, and an old one crawled again with other words
    pages(src, every.where("page_id % 3 = 1"))
    again = every.where("page_id = 0").select((F.col("page_id") + 900).alias("page_id"), "url", F.regexp_replace("html", "</p>", " and more words </p>").alias("html"))
    pages(src, again)
    news.ingest(news.pages_stream(spark, src, files=1), out, cp, day())
    seen = every.where("page_id % 3 < 2").unionByName(again)
    want = rows_of(news.points(seen, day()))
    assert rows_of(news.current(spark, out)) == want and first < len(want)
    batches = {r["batch"] for r in news.stored(spark, out).select("batch").distinct().collect()}
    assert batches == {0, 1, 2}
    # the last batch was written but not confirmed: it comes once more
    n = news.stored(spark, out).count()
    for f in os.listdir(f"{cp}/commits"):
        if f.strip(".").startswith("2"):
            os.remove(f"{cp}/commits/{f}")
    news.ingest(news.pages_stream(spark, src, files=1), out, cp, day())
    assert news.stored(spark, out).count() == n and rows_of(news.current(spark, out)) == want
    # compacted, and without old days
    news.compact(spark, out, f"{tmp_path}/compact")
    assert rows_of(news.current(spark, f"{tmp_path}/compact")) == want
    kept = news.current(spark, out, F.expr("DATE '2024-01-28'"), 5)
    assert {str(r["date"]) >= "2024-01-23" for r in kept.collect()} == {True} and kept.count() < len(want)
    s = {r["batch"]: (r["scraped_articles"], r["chunks_upserted"]) for r in news.summary(spark, out).collect()}
    assert set(s) == batches and sum(c for _, c in s.values()) == n


def test_odd_pages(spark):
    p = "<p>" + "word " * 30 + "</p>"
    long = "<p>" + "word " * 619 + "</p>"
    rows = [(1, None, f"<h1>t</h1>{p}"), (2, "u2", None), (3, "u3", ""), (4, "u4", p), (5, "u5", f"<h1>t</h1><p>{'x' * 50}</p>"), (6, "u6", f"<h1>t</h1>{p}"), (7, "u6", f"<h1>later</h1>{p}"), (8, "u8", f"<title>T</title>{long}")]
    got = news.points(spark.createDataFrame(rows, "page_id bigint, url string, html string"), F.expr("DATE '2024-01-01'")).collect()
    assert sorted((r["url"], r["title"], r["chunk_id"][-3:], len(r["text"].split())) for r in got) == [("u6", "later", "001", 31), ("u8", "T", "001", 251), ("u8", "T", "002", 251), ("u8", "T", "003", 220)]
    assert len({r["point_id"] for r in got}) == 4


EVENTS = "file_id bigint, at bigint, stage string, ok boolean, detail string"


def machine(events):
    """The rows of one pass, by the transitions alone."""
    state, out = {}, []
    for f, at, stage, ok, detail in sorted(events, key=lambda e: e[1]):
        step = stages.moved(state.get(f, stages.NEW), stage, ok, detail)
        state[f], passed = step or (state.get(f, stages.NEW), [])
        out.append((f, at, stage, step is not None, passed, *state[f][1:]))
    return sorted(out)


def test_stages_over_restarts(spark, tmp_path):
    good = [(1, 10 * i, s, True, f"path-{s}") for i, s in enumerate(stages.STAGES)]
    failed = [(2, 1, "save", True, "p"), (2, 2, "extract", False, "no text"), (2, 45, "preprocess", True, "late")]
    early = [(3, 1, "save", False, "disk"), (3, 50, "save", True, "p"), (4, 3, "extract", True, "x"), (4, 4, "save", True, "y"), (4, 41, "extract", True, "z"), (4, 42, "extract", True, "again"), (5, 99, "save", True, None)]
    events = good + failed + early
    src, out, cp = f"{tmp_path}/src", f"{tmp_path}/out", f"{tmp_path}/cp"
    for lo, hi in ((0, 25), (25, 100)):
        part = [e for e in events if lo <= e[1] < hi]
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(src)
        stages.run(spark.readStream.schema(EVENTS).parquet(src), out, cp)
    got = sorted((r["file_id"], r["at"], r["stage"], r["accepted"], r["passed"], r["status"], r["error_message"], r["extracted_json_path"], r["preprocessed_json_path"]) for r in spark.read.parquet(out).collect())
    assert got == machine(events)
    last = {r[0]: r[5] for r in sorted(got, key=lambda r: r[1])}
    assert last == {1: "ingested", 2: "failed", 3: "failed", 4: "preprocessing", 5: "extracting"}
    assert {r[6] for r in got if r[0] == 3} == {"Pre-registration failure: disk"}
    assert (1, 40, "upsert", True, ["ingested"], "ingested", None, "path-extract", "path-preprocess") in got
