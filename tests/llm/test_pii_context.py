"""Context of entities beside other matches, and in texts without blanks."""

from loomdoc.llm import pii
from pyspark.sql import functions as F


def around(spark, t, value):
    d = spark.createDataFrame([(t, t.index(value), t.index(value) + len(value))], "t string, s int, e int")
    return d.select(pii._around(F.col("t"), F.col("s"), F.col("e"))).first()[0]


def test_context_reaches_over_matches_and_limits(spark):
    assert around(spark, "w1 w2 a@b.cd x@y.zz e@f.gh v1", "x@y.zz") == ["w1", "w2", "a", "b", "cd", "e", "f", "gh", "v1"]
    words = [f"w{i}" + "x" * 60 for i in range(20)]
    assert around(spark, ",".join(words) + ",x@y.zz," + ",".join(words), "x@y.zz") == words[-8:] + words[:8]
    words = [f"w{i}" + "x" * 600 for i in range(9)]
    assert around(spark, ",".join(words) + ",x@y.zz," + ",".join(words), "x@y.zz") == words[-8:] + words[:8]


def test_terms_beside_other_matches_are_told(spark):
    rows = [(i, f"Zanzibar u{i}@z{i}.org ann@x.org v{i}@q{i}.org") for i in range(40)] + [(100 + i, f"plain text {i}") for i in range(300)]
    got = {r["doc_id"]: [(s["kind"], s["start"]) for s in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(("term", 0) in got[i] for i in range(40))
