"""Streaming extensions against the same tables in batch."""

from loomdoc.streaming import events as S
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_first_seen_in_a_stream(spark, tmp_path):
    s = S.first_seen(S.read_events(spark, DATA), ["user_id"])
    S.run_once(s, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = [r["user_id"] for r in spark.read.parquet(f"{tmp_path}/out").select("user_id").collect()]
    want = {r["user_id"] for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id").distinct().collect()}
    assert len(got) == len(set(got)) and set(got) == want


def test_latency_windows(spark, tmp_path):
    q = S.latency_windows(S.read_events(spark, DATA)).writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(str(r["start"]), r["event_type"]): r["n"] for r in spark.sql("SELECT * FROM windows").collect()}
    b = spark.read.parquet(f"{DATA}/events.parquet").groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("start"), "event_type").count()
    assert got == {(str(r["start"]), r["event_type"]): r["count"] for r in b.collect()}
