"""Weights, budgets and permutations of the mix; the lookup table of the shards; defined cases of both."""

from collections import Counter, defaultdict

from loomdoc.llm import mixing, sharding


def rows():
    out = [(i, " ".join(f"w{k}" for k in range(1 + i % 9)), "big" if i % 3 else f"s{i % 4}") for i in range(400)]
    return [*out, (500, None, "void"), (501, " ", "void"), (502, "a b", None), (None, "c d", None), (7, out[7][1], out[7][2])]


def test_mix_keeps_all_and_meets_the_limit(spark):
    docs = spark.createDataFrame([(i, t, s, 1) for i, t, s in rows()], "doc_id bigint, text string, source string, epoch int").repartition(3)
    got = mixing.mix(docs).collect()
    assert {(r["doc_id"], r["text"], r["source"]) for r in got} == set(rows())
    words, mixed = Counter(), Counter()
    for _, t, s in rows():
        words[s or ""] += len((t or "").split())
    for r in got:
        mixed[r["source"] or ""] += len((r["text"] or "").split())
    passes = {s: mixed[s] / n for s, n in words.items() if n}
    assert min(passes.values()) == passes["big"] == 1 and 1.5 < max(passes.values()) <= 2
    assert all(0 <= r["mix_at"] for r in got)
    per = defaultdict(set)
    for r in got:
        per[r["doc_id"], r["source"]].add(r["epoch"])
    assert all(e == set(range(len(e))) for e in per.values())
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(docs).count() == len(got)


def test_mix_meets_entropy_and_budget(spark):
    docs = spark.createDataFrame([(i, "one two three four", "a" if i % 10 else "b") for i in range(2000)], "doc_id bigint, text string, source string")
    got = Counter(r["source"] for r in mixing.mix(docs, entropy=0.6, budget=4000).select("source").collect())
    assert abs(sum(got.values()) * 4 - 4000) <= 16
    assert 0.25 < got["b"] / sum(got.values()) < 0.33  # entropy 0.6 nats


def test_table_is_even_and_moves_little():
    one, two = sharding.fill_table(32), sharding.fill_table(31)
    n = Counter(one)
    assert len(one) == sharding.SLOTS and max(n.values()) - min(n.values()) <= 1
    assert sum(a != b for a, b in zip(one, two, strict=True) if a != 31) < 0.35 * len(one)


def test_shards_of_rows(spark):
    docs = spark.createDataFrame([(i, "x") for i in [*range(500), 3, None, None]], "doc_id bigint, shard string")
    got = sharding.assign_shards(docs).collect()
    assert len(got) == 503 and all(0 <= r["shard"] < sharding.SHARDS for r in got)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["slot"], r["shard"]))
    assert all(len(v) == 1 for v in by.values())
