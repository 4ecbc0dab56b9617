"""Disclosing terms against a plain count of documents and contexts."""

import math
import random
import re
from collections import defaultdict

import brute
from loomdoc.llm import pii
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t)


def names(kind, value):
    d, v = re.sub("[^0-9]", "", value), low(value)
    of = {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": d[:6], "phone": d[:4]}[kind]
    return [f"{kind}:value:{d if kind in ('card', 'phone') else v}", f"{kind}:class:{of}", f"{kind}:kind:"]


def told(rows, near=8, contexts=3, least=0.8):
    docs = [t or "" for t in rows]
    df_t, df_e, seen = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in enumerate(docs):
        for w in TERM.findall(low(t)):
            df_t[w].add(i)
        for span in brute.op7(t)[1]:
            kind, a, b = span.split(":")
            a, b = int(a), int(b)
            around = tuple(TERM.findall(low(t[:a]))[-near:] + TERM.findall(low(t[b:]))[:near])
            for e in names(kind, t[a:b]):
                df_e[e].add(i)
                for w in set(around):
                    seen[e, w].add((i, around))
    n, out = max(2, len(docs)), defaultdict(float)
    for (e, w), at in seen.items():
        if len({c for _, c in at}) >= contexts:
            both, de, dt = len(at), len(df_e[e]), len(df_t[w])
            pmi = math.log(min(both, de, dt) * n / (de * dt))
            out[w] = max(out[w], pmi / math.log(n / min(de, n - 1)))
    return {w: round(r, 9) for w, r in out.items() if r >= least}


def corpus():
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(rnd.choices(words, k=n))
    rows = [some(rnd.randrange(1, 60)) for _ in range(150)]
    rows += [f"{some(5)} badge{i % 2} {some(3)} ann@x.org {some(9)}" for i in range(8)]  # by value
    rows += [f"{some(4)} Depot u{i}@mail.example.net {some(4)}" for i in range(6)]  # by class
    rows += [f"{some(4)} dial +1 ({200 + i}) 555-{1000 + i} {some(4)} and a gateway 10.7.{i}.{i + 1} {some(2)}" for i in range(6)]  # by kind
    rows += [f"{some(3)} badge0 {some(3)}", "", "card 4111 1111 1111 1111 here"]
    return rows


def test_terms(spark):
    rows = corpus()
    want = told(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, t string").select(pii.row_key(F.col("doc_id"), F.col("t")).alias("key"), "doc_id", "t").repartition(3)
    spans = pii.base_spans(docs.select("key", "t")).distinct()
    got = {r["term"]: round(r["ratio"], 9) for r in pii.disclosing_terms(docs, spans).collect()}
    assert got == want
    assert {"badge1", "depot", "dial", "gateway"} <= set(want) and not any(w.startswith("w") for w in want)
