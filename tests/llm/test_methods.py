"""Learning, mixing, filters and shard files against plain versions of their methods."""

import hashlib
import math
import random
from collections import defaultdict

import brute
import numpy as np
from loomdoc.llm import decontam, mixing, quality, sharding, toxicity
from pyspark.sql import functions as F


def plain_nnpu(x, toxic, prior, steps=3000, rate=0.3):
    """Scores by full-batch gradient descent on the non-negative risk of a linear model."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p, theta = x[toxic], np.zeros(x.shape[1])
    theta[-1] = math.log(prior / (1 - prior))
    sigma = lambda z: 1 / (1 + np.exp(-z))
    for _ in range(steps):
        sp, su = sigma(p @ theta), sigma(x @ theta)
        gap = -np.log1p(-np.clip(su, 0, 1 - 1e-9)).mean() + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-9)).mean()
        up, down = p.T @ (sp - 1) / len(p), x.T @ su / len(x) - prior * (p.T @ sp) / len(p)
        theta -= rate * (prior * up + down if gap >= 0 else -down)
    return sigma(x @ theta)


def test_scores_agree_with_a_plain_learner(spark):
    rnd = random.Random(9)
    bad, good = [f"b{i}" for i in range(12)], [f"g{i}" for i in range(120)]
    rows = []
    for i in range(900):
        toxic = i % 9 == 0
        rows.append((i, " ".join(rnd.sample(good, 12) + (rnd.sample(bad, 4) if toxic else [])), toxic))
    known = [(i, 1) for i, _, t in rows if t and i % 2 == 0] + [(i, 0) for i, _, t in rows if not t and i % 7 == 0]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame(known, "doc_id bigint, toxic int")
    got = {r["doc_id"]: r for r in toxicity.judge(docs, labels, prior=1 / 9).collect()}
    words = {w: k for k, w in enumerate(bad + good)}
    x = np.zeros((len(rows), len(words)))
    for i, t, _ in rows:
        x[i, [words[w] for w in t.split()]] = 1
    seen = [i for i, _, _ in rows if not got[i]["held_out"]]
    place = {i: k for k, i in enumerate(seen)}
    plain = plain_nnpu(x[seen], [place[i] for i, y in known if y == 1 and i in place], 1 / 9)
    agree = [(got[i]["score"] >= 0.5) == (plain[place[i]] >= 0.5) for i in seen]
    assert sum(agree) / len(agree) > 0.98
    right = [got[i]["predicted"] == int(t) for i, _, t in rows if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.97


def test_scores_do_not_depend_on_partitions(spark):
    rows = [(i % 150, f"w{i % 13} w{i % 7} " + ("vile word" if i % 5 == 0 else "fine word") + f" {i}") for i in range(600)]  # each id with four texts
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    old = toxicity.POSITIVES, toxicity.UNLABELLED
    toxicity.POSITIVES, toxicity.UNLABELLED = 40, 100
    try:
        one, two = (sorted((r["doc_id"], r["score"]) for r in toxicity.judge(d, labels).collect()) for d in (docs.repartition(7), docs.orderBy(F.desc("text")).coalesce(2)))
    finally:
        toxicity.POSITIVES, toxicity.UNLABELLED = old
    assert one == two


def test_very_long_texts(spark):
    long = "fine words here " * 60_000
    docs = spark.createDataFrame([(1, long + "vile"), (2, long), (3, "vile")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.Model(*_known("vile"))).collect()}
    assert got[1] == got[3] > got[2]  # the last word of a long text counts
    mixed = mixing.mix(docs.withColumn("source", F.lit("s"))).collect()
    assert {r["doc_id"] for r in mixed} == {1, 2, 3}


def _known(word):
    from pyspark.sql import SparkSession

    h = SparkSession.active().range(1).select(F.xxhash64(F.lit(word)).alias("h")).first()["h"]
    return np.array([h], np.int64).view(np.uint64), np.array([3.0]), -1.0


def plain_mix(rows, a, seed=mixing.SEED):
    """{doc: times}: whole passes, and of a pass in hash order what fits the rest."""
    words = lambda t: len(brute.WORD.findall(t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, words(t)))
    n = {s: sum(w for _, w in v) for s, v in by.items()}
    top = max(n.values())
    out = {}
    for s, v in by.items():
        tokens = math.floor((n[s] / top) ** a * top)
        full, rest = divmod(tokens, n[s])
        u = lambda i, s=s, full=full: int(hashlib.md5(f"{seed}|{s}|{full}|{i}".encode()).hexdigest()[:12], 16)
        upto = 0
        for i, w in sorted(v, key=lambda x: u(x[0])):
            upto += w
            out[i] = full + (upto <= rest)
    return out


def test_mix_against_the_plain_version(spark):
    rnd = random.Random(3)
    rows = [(i, "w " * rnd.randrange(1, 40), rnd.choice("aaaaabbc")) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    n = defaultdict(int)
    for _, t, s in rows:
        n[s] += len(t.split())
    shares = spark.createDataFrame([(s, k) for s, k in n.items()], "s string, n bigint")
    a = mixing.bisect_exponent(shares)
    assert abs(a - max(0.0, 1 - math.log(2) / math.log(max(n.values()) / min(n.values())))) < 2e-6
    got = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert got == {i: k for i, k in plain_mix(rows, a).items() if k}
    places = [r["mix_at"] for r in mixing.mix(docs.withColumn("source", F.lit("one"))).collect()]
    assert len(places) == len(rows) == len(set(places))  # one source: once, in a full permutation


def test_filters_keep_what_judges_keep(spark):
    rows = [(i, f"some words {i} of a quite ordinary text that says " + "this and that and more of it, you see, " * (i % 5), "en", "s", i) for i in range(60)]
    rows += [(100, None, None, None, 1), (101, "short", "en", "s", 1), (1, rows[1][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, kept int").repartition(4)
    kept = {r["key"] for r in quality.judge(docs).where("kept").collect()}
    got = quality.quality_filter(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted((tuple(r) for r in docs.withColumn("__k", quality.row_key(F.col("doc_id"), F.col("text"))).where(F.col("__k").isin(list(kept))).drop("__k").collect()), key=str)
    items = spark.createDataFrame([(1, rows[3][1]), (2, None)], "item_id bigint, text string")
    clean = decontam.decontaminate(docs, items)
    hit = {r["key"] for r in decontam.judge(docs, items).where("contaminated").collect()}
    assert hit and clean.columns == docs.columns
    assert clean.count() == docs.withColumn("__k", quality.row_key(F.col("doc_id"), F.col("text"))).where(~F.col("__k").isin(list(hit))).count()


def test_shard_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x") for i in [*range(300), None]], "doc_id bigint, text string")
    placed = sharding.assign_shards(docs, shards=5, slots=101)
    sharding.write_shards(placed, f"{tmp_path}/s", rows_per_file=10)
    back = spark.read.parquet(f"{tmp_path}/s")
    assert sorted(map(str, back.select("doc_id", "shard").collect())) == sorted(map(str, placed.select("doc_id", "shard").collect()))
    assert {p.name for p in tmp_path.joinpath("s").iterdir() if p.is_dir()} == {f"shard={k}" for k in range(5)}


def test_long_texts_with_a_one_word_item(spark):
    docs = spark.createDataFrame([(1, "solo " * 30_000 + "end", 0)], "doc_id bigint, text string, items int")
    items = spark.createDataFrame([(7, "solo"), (8, " ".join(f"i{k}" for k in range(50)))], "item_id bigint, text string")
    (r,) = decontam.judge(docs, items).collect()
    assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (30_001, 30_000, ["7"], True)
