"""Text functions against plain versions."""

import random
import re

from loomdoc.functions import text as T
from pyspark.sql import functions as F


def brute_urls(t):
    before = None
    while before != t:
        before, t = t, re.sub(r"(https?://\S*?)\s+(\S*(?:\.[a-zA-Z]{2,}|/)\S*)", r"\1\2", t, flags=re.ASCII)
    return t


def test_all_url_gaps_are_closed(spark):
    ten = "see https://a.org/x " + " ".join(f"p{i}/" for i in range(10)) + " end of it"
    r = random.Random(1)
    pieces = ["http://a", "https://b.org/x", "xhttp://", "y.html", "/z", "w", "a.b", "3.14", ".de", "é/ü", "https:/", "q.com/http://r"]
    texts = [ten, "", "a/b c/d http://", "/z http://a /z", "https://a /b w /c", *("".join(r.choice(pieces) + r.choice([" ", "  ", "\n", "\t ", ""]) for _ in range(r.randrange(1, 25))) for _ in range(2000))]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {x["t"]: x["u"] for x in d.select("t", T.repair_urls(F.col("t")).alias("u")).collect()}
    assert "".join(f"p{i}/" for i in range(10)) + " end" in got[ten]
    for t in texts:
        assert got[t] == brute_urls(t), t


def test_diacritics_join_their_words(spark):
    letters = "ṇṣśñṭḍṛḷṃḥĀāĪīŪūṚṛṜṝḶḷḸḹṂṃḤḥÑñṬṭḌḍṆṇŚśṢṣ"

    def brute(t):
        return re.sub(rf"(\w)\s+([{letters}])", r"\1\2", re.sub(rf"(\w)\s+([{letters}])\s*(\w)", r"\1\2\3", t))

    r = random.Random(2)
    texts = ["Hir ṇ ayak ṣ a", *("".join(r.choice(["a", "é", "ṇ", "ñ", "Ś", " ", "  ", "\n", "\xa0", ".", "9"]) for _ in range(r.randrange(25))) for _ in range(1000))]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {x["t"]: x for x in d.select("t", T.rejoin_diacritics(F.col("t")).alias("u"), T.corrected(F.col("t")).alias("c")).collect()}
    assert got["Hir ṇ ayak ṣ a"]["c"] == "Hirṇayakṣa"
    for t in texts:
        assert got[t]["u"] == brute(t), repr(t)
