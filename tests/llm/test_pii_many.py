"""Texts with many matches: a contact list takes time in proportion to its length."""

import time

import pytest
from loomdoc.llm import pii


def lists(n, copies=1):
    return [(k, "\n".join(f"name{i} of list{k} writes u{i}@mail{i % 50}.org from here" for i in range(n))) for k in range(copies)]


def seconds(spark, n):
    docs = spark.createDataFrame(lists(n), "doc_id bigint, text string")
    begin = time.time()
    (row,) = pii.find(docs).collect()
    assert [s["kind"] for s in row["spans"]].count("email") == n
    return time.time() - begin


def test_contact_lists(spark):
    seconds(spark, 100)
    small, large = seconds(spark, 2000), seconds(spark, 20_000)
    assert small < 20 and large < 10 * small + 10


@pytest.mark.parametrize("sea", [100, 3000, 60_000])
def test_contexts_over_seas_of_signs(spark, sea):
    """However far the next words are, they are the context."""
    from pyspark.sql import functions as F

    t = "w1 w2 w3 " + "-" * sea + " a@b.cd " + "-" * sea + " v1 v2"
    d = spark.createDataFrame([(t, t.index("a@"), t.index("a@") + 6)], "t string, s int, e int")
    assert d.select(pii._around(F.col("t"), F.col("s"), F.col("e"))).first()[0] == ["w1", "w2", "w3", "v1", "v2"]


def test_both_ways_to_find_told_terms(spark, monkeypatch):
    """By one pattern and by a join of words, the spans are the same: terms within terms, at both ends, beside letters beyond ASCII."""
    rows = [(i, f"Zan zanzibar u{i}@z{i}.org ann@x.org ZANZIBAR,zan\u00e9 zanzibarx v{i}@q{i}.org zan") for i in range(40)] + [(100 + i, f"plain text {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = []
    for n in (32, 0):
        monkeypatch.setattr(pii, "ALTERNATIVES", n)
        found.append(sorted((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in pii.find(docs).collect()))
    assert found[0] == found[1]
    told = {rows[3][1][a:b] for kind, a, b in dict(found[0])[3] if kind == "term"}
    assert {"Zan", "zanzibar", "ZANZIBAR", "zan\u00e9", "zanzibarx", "zan"} <= told
