"""Tokens with digits, and rules that stay as the corpus grows."""

from loomdoc.llm import urls
from pyspark.sql import functions as F


def test_tokens_with_digits(spark):
    url = "http://a.org/casino24/mp3-free/2024/?utm2=x&b-c=1&d="
    got = spark.createDataFrame([(url,)], "u string").select(urls.tokens_of(F.col("u"))).first()[0]
    assert sorted(got) == sorted(["h:a", "h:org", "d:a.org", "s:casino24", "s:mp3-free", "q:utm2", "q:b-c", "q:d"])


def test_rare_rules_stay(spark):
    n = 40_000
    bad = F.col("i") < 30
    p = spark.range(n).withColumnRenamed("id", "i").select("i", F.when(bad, F.lit("http://x.org/casino24/")).otherwise(F.concat(F.lit("http://h"), (F.col("i") % 50).cast("string"), F.lit(".de/a/"))).alias("url"), bad.cast("int").alias("toxic"))
    out = urls.judge(p.select(F.col("i").alias("page_id"), "url"), p.select(F.col("i").alias("doc_id"), "toxic"), rules=urls.RULES)
    got = {r["verdict"]: r["n"] for r in out.groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    assert got == {"block": 30, "allow": n - 30}
