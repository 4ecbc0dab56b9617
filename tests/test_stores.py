"""Collections in buckets, uploads, folders, rounds over empty pages, sessions as batch and stream, latency sketches."""

import os
import re

import pytest
from loomdoc.operators import evaluation, recheck
from loomdoc.sources import collections as C
from loomdoc.streaming import protocol
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def points(spark, rows):
    return spark.createDataFrame([(p, f, f"c{p}", "x", t, [1.0, 2.0]) for p, f, t in rows], C.POINT)


@pytest.fixture
def shuffled(spark):
    """Joins of small tables by shuffles, as those of large ones."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_collections(spark, tmp_path, shuffled):
    where = f"file://{tmp_path}/c"
    assert C.ensure(spark, ["t_one", "t_two"], where) == ["t_one", "t_two"]
    assert C.ensure(spark, ["t_two", "t_three"], where) == ["t_three"]
    assert spark.table("t_one").count() == 0
    C.put(C.upserted(spark.table("t_one"), points(spark, [(f"p{i}", i % 5, "old") for i in range(50)])), "t_one", where)
    new = points(spark, [("p1", 1, "new"), ("q", 1, "new"), ("p2", 9, "other file")])
    up, cut = C.upserted(spark.table("t_one"), new), C.removed(spark.table("t_one"), spark.createDataFrame([(3,), (77,), (3,)], "file_id bigint"))
    for df in (up, cut):
        scan = re.split(r"\n", plan(df))
        stored = [i for i, line in enumerate(scan) if "FileScan parquet" in line]
        assert stored and any("SortMergeJoin" in line for line in scan)
        # between the join and the stored side's scan there is no exchange
        depth = [len(re.match(r"[ :|+\-*()\d]*", line)[0]) for line in scan]
        for i in stored:
            above, d = [], depth[i]
            for k in range(i - 1, -1, -1):
                if depth[k] < d:
                    above.append(scan[k])
                    d = depth[k]
            join = next(k for k, line in enumerate(above) if "SortMergeJoin" in line)
            assert not any("Exchange" in line for line in above[:join])
    C.put(up, "t_one", where)
    got = {(r["point_id"], r["file_id"]): r["text"] for r in spark.table("t_one").collect()}
    assert len(got) == 52 and got["p1", 1] == "new" and got["q", 1] == "new" and got["p2", 2] == "old" and got["p2", 9] == "other file"
    C.put(C.removed(spark.table("t_one"), spark.createDataFrame([(3,)], "file_id bigint")), "t_one", where)
    assert {r["file_id"] for r in spark.table("t_one").collect()} == {0, 1, 2, 4, 9}
    assert C.ensure(spark, ["t_one"], where) == [] and spark.table("t_one").count() == 42
    for t in ("t_one", "t_two", "t_three"):
        spark.sql(f"DROP TABLE {t}")


def test_uploads(spark, tmp_path):
    one = spark.createDataFrame([(1, "History", b"%PDF one"), (2, "Anthropology", b"")], "file_id bigint, classification string, content binary")
    C.upload(one, f"file://{tmp_path}/u")
    C.upload(spark.createDataFrame([(3, "HISTORY", None)], one.schema), f"file://{tmp_path}/u")
    got = sorted((r["file_id"], r["path"], r["folder"], r["content"] and bytes(r["content"])) for r in C.uploads(spark, f"file://{tmp_path}/u").collect())
    assert got == [(1, "history/1.pdf", "history", b"%PDF one"), (2, "anthropology/2.pdf", "anthropology", b""), (3, "history/3.pdf", "history", None)]


def test_folders(spark, tmp_path):
    for name, data in (("a.pdf", b"x"), ("in/b.pdf", b"yy"), ("in/deep/c.pdf", b"z"), ("in/d.txt", b"zzz")):
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(data)
    f = C.folder_files(spark, f"file://{tmp_path}", "*.pdf")
    walked = sorted((n, os.stat(os.path.join(d, n)).st_size) for d, _, names in os.walk(tmp_path) for n in names if n.endswith(".pdf"))
    assert sorted((r["name"], r["length"]) for r in f.select("name", "length").collect()) == walked
    assert "content" not in re.search(r"ReadSchema: (.*)", plan(f.select("name", "length"))).group(1) if "ReadSchema" in plan(f) else True
    assert {r["name"]: bytes(r["content"]) for r in f.collect()}["b.pdf"] == b"yy"


PAGES = "doc_id bigint, page_num bigint, text string, is_blank boolean, error string"


def test_rounds(spark, tmp_path):
    pages = [(1, 1, "fine", False, None), (1, 2, "", True, None), (1, 3, " ", False, "503"), (1, 4, None, None, None), (2, 1, "", True, None), (2, 2, "", True, None)]
    seen = []

    def extract(todo, n):
        rows = sorted((r["doc_id"], r["page_num"]) for r in todo.collect())
        seen.append(rows)
        said = {(1, 2): 1, (1, 3): 2, (2, 1): 9}
        return spark.createDataFrame([(d, p, "now" if said[d, p] <= n else "", said[d, p] > n, None) for d, p in rows if (d, p) in said], PAGES)

    got, n = recheck.rechecked(spark.createDataFrame(pages, PAGES), extract, f"file://{tmp_path}/r")
    assert n == 3 and seen == [[(1, 2), (1, 3), (2, 1), (2, 2)], [(1, 3), (2, 1), (2, 2)], [(2, 1), (2, 2)]]
    assert sorted((r["doc_id"], r["page_num"], r["text"], r["attempts"]) for r in got.where("text IS NOT NULL").collect()) == [(1, 1, "fine", 0), (1, 2, "now", 1), (1, 3, "now", 2), (2, 1, "", 3), (2, 2, "", 3)]
    got, n = recheck.rechecked(spark.createDataFrame(pages[:1], PAGES), extract, f"file://{tmp_path}/s")
    assert n == 0 and len(seen) == 3 and got.count() == 1


def test_sessions_as_batch_and_stream(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "done").when(F.col("event_type") == "view", "progress").otherwise("other")
    named = lambda df: df.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("no"), kind.alias("type"))
    rows = lambda df: sorted((r["user_id"], str(r["start"]), r["events"], r["sequence"], r["outcome"], r["whole"]) for r in df.collect())
    batch = rows(protocol.sessions(named(e), "6 hours"))
    assert {s[5] for s in batch} == {True, False} and all(s[5] == bool(re.fullmatch("p*[re]d", s[3])) for s in batch)
    # events far behind let the watermark pass all others
    src = f"{tmp_path}/src"
    e.coalesce(1).write.parquet(src)
    s = protocol.sessions(named(spark.readStream.schema(e.schema).parquet(src)), "6 hours", "1 hour")
    run = lambda: s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    run()
    e.limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "ts": (F.col("ts") + F.expr("INTERVAL 5 YEARS")).cast(e.schema["ts"].dataType), "event_type": F.lit("view")}).coalesce(1).write.mode("append").parquet(src)
    run()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == batch


def test_latency_sketches(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet").select(F.col("event_type").alias("stage"), F.col("value").alias("latency_ms"), F.to_date("ts").alias("day"))
    odd = spark.createDataFrame([("odd", 0.0), ("odd", -1.0), ("odd", 5.0), ("odd", None)], "stage string, latency_ms double").withColumn("day", F.lit(None).cast("date"))
    e = e.unionByName(odd)
    once, days = evaluation.latency_sketch(e, ["stage"]), evaluation.merged_sketches(evaluation.latency_sketch(e, ["stage", "day"]), ["stage"])
    rows = lambda df: sorted((r["stage"], -(10**9) if r["bucket"] is None else r["bucket"], r["n"], round(r["total"], 6), r["most"]) for r in df.collect())
    assert rows(once) == rows(days)
    told = {r["stage"]: r for r in evaluation.sketch_latency(days, ["stage"]).collect()}
    values = {}
    for r in e.where("latency_ms IS NOT NULL").collect():
        values.setdefault(r["stage"], []).append(r["latency_ms"])
    for stage, v in values.items():
        v.sort()
        assert told[stage]["n"] == len(v) and told[stage]["max_ms"] == v[-1]
        for q in (50, 95):
            exact = v[-(-q * len(v) // 100) - 1]
            assert abs(told[stage][f"p{q}_ms"] - max(exact, 0)) <= evaluation.ACCURACY * max(exact, 0) + 1e-4


def test_messages_and_chunks_of_some(spark, tmp_path):
    from loomdoc.operators import state
    from loomdoc.sources import catalogue

    m = spark.createDataFrame([("a", "user", "hi", 1), ("b", "user", "yo", 1), (None, "user", "lost", 1), ("", "user", "lost", 2), ("a", "assistant", "there", 2)], "session_id string, role string, content string, at int")
    state.append_messages(m.where("at = 1"), f"{tmp_path}/m")
    state.append_messages(m.where("at = 2"), f"{tmp_path}/m")
    assert sorted((r["session_id"], r["content"]) for r in state.messages_of(spark, f"{tmp_path}/m").collect()) == [("a", "hi"), ("a", "there"), ("b", "yo")]
    one = state.messages_of(spark, f"{tmp_path}/m", ["a"])
    assert [r["content"] for r in one.orderBy("at").collect()] == ["hi", "there"] and "PartitionFilters: [" in plan(one)
    c = spark.createDataFrame([(i, f"chk_{k}", f"text {k}") for i in range(30) for k in range(3)], "doc_id bigint, chunk_id string, text string")
    catalogue.write_chunk_buckets(c, f"{tmp_path}/c", buckets=4)
    assert len([d for d in os.listdir(f"{tmp_path}/c") if d.startswith("bucket=")]) <= 4
    schema = "doc_id bigint, chunk_id string, text string"
    assert catalogue.read_chunks(spark, f"{tmp_path}/c", schema, buckets=4).count() == 90
    assert sorted(r["doc_id"] for r in catalogue.read_chunks(spark, f"{tmp_path}/c", schema, [3, 7], buckets=4).collect()) == [3, 3, 3, 7, 7, 7]
