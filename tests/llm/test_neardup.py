"""Near duplicates against all pairs, on the small tables and on hand-made rows."""

import random
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from loomdoc.llm import cws, neardup
from loomdoc.llm.hashing import word_hashes


def grouped(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["class_id"]].add(r["id"])
    assert all(min(v) == k for k, v in out.items())
    return {frozenset(v) for v in out.values()}


def variants():
    rnd = random.Random(3)
    vocab = [f"v{i}" for i in range(3000)]
    base = rnd.choices(vocab, k=200)
    rows = [(0, " ".join(base)), (1, " ".join(base)), (2, "  ".join(base)), (3, None), (4, ""), (5, None), (6, "a b"), (7, "a  b"), (8, "a b c d"), (9, "a b c e")]
    for i in range(10, 32):  # edits of one base: some within reach of it, some of each other only
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 8])):
            w[rnd.randrange(200)] = f"x{rnd.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    w = list(base)
    for i in range(60, 76):  # a chain
        w[(i * 6) % 200] = f"y{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(rnd.choices(vocab, k=rnd.randrange(1, 400)))) for i in range(30)]
    return rows


#: Counts of runs come from a sketch, so a similarity may be off by this much; beyond it, classes are those of the plain version.
OFF = 0.03


@pytest.mark.parametrize("which", ["given", "hand-made", "hot"])
def test_classes(spark, which):
    if which == "given":
        docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    elif which == "hand-made":
        docs = spark.createDataFrame([(i, t, 1) for i, t in variants()], "doc_id bigint, text string, node int").repartition(3)
    else:
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(hot())], "doc_id bigint, text string").repartition(3)
    rows = docs.select("doc_id", "text").collect()
    texts = [r["text"] for r in rows]
    got = neardup.classes(docs).collect()
    of = {r["id"]: r["class_id"] for r in got}
    assert len(of) == len(got) == len(rows)
    grouped(got)
    near = brute.near_pairs(texts, 0.8 - OFF)
    assert all(of[rows[i]["doc_id"]] == of[rows[j]["doc_id"]] for (i, j), s in near.items() if s >= 0.8 + OFF)
    loose = brute.joined(len(rows), near)
    for i, r in enumerate(rows):  # nothing is in one class that no chain of near texts joins
        j = next(k for k, x in enumerate(rows) if x["doc_id"] == of[r["doc_id"]])
        assert loose[i] == loose[j]
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(ids) == sorted({r["class_id"] for r in got})


def hot():
    """One text edited in 0 to 9 places, 300 times: large buckets of which most pairs lie below the threshold."""
    rnd = random.Random(5)
    base = [f"h{rnd.randrange(400)}" for _ in range(150)]
    out = []
    for i in range(300):
        w = list(base)
        for k in range(rnd.randrange(10)):
            w[rnd.randrange(150)] = f"e{i}x{k}"
        out.append(" ".join(w))
    return out


def test_very_long_text(spark):
    rnd = random.Random(2)
    long = [f"l{rnd.randrange(50_000)}" for _ in range(120_000)]
    other = list(long)
    for k in range(0, 120_000, 500):
        other[k] = f"o{k}"
    docs = spark.createDataFrame([(7, " ".join(long)), (3, " ".join(other)), (9, " ".join(long[:60_000]))], "doc_id bigint, text string")
    assert {(r["id"], r["class_id"]) for r in neardup.classes(docs).collect()} == {(7, 3), (3, 3), (9, 9)}


def test_repeated_and_null_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "p q"), (2, "p q"), (None, None), (None, None), (3, "")], "doc_id bigint, text string")
    got = sorted(neardup.deduplicate(docs).collect(), key=str)
    assert got == sorted([(1, long), (2, "p q"), (None, None), (None, None), (3, "")], key=str)


def test_empty(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    assert neardup.deduplicate(spark.createDataFrame([], "doc_id bigint, text string, n int")).count() == 0


def test_components_of_a_path(spark):
    n = 40
    links = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}") for i in range(n)] + [("x", "y")], "a string, b string")
    assert {(r["node"], r["root"]) for r in neardup.components(links).collect()} == {(f"{i:03d}", "000") for i in range(n + 1)} | {("x", "x"), ("y", "x")}


def test_samples_agree_as_the_similarity():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    w = rng.uniform(1, 4, 400).astype(np.float32)
    x = w.copy()
    x[:60] *= 2
    want = np.minimum(w, x).sum() / np.maximum(w, x).sum()
    a, b = (np.concatenate([cws.Sampler(40)(s + np.uint64(k), v, np.array([0])) for k in range(100)], axis=1) for v in (w, x))
    assert abs((a == b).mean() - want) < 0.03


def test_word_hashes():
    texts = ["a b  c", "", None, "hello", "w\u00f6rld\tx\n", "abcdefgh abcdefghi", "  ", "x", "x y", "abcdefgh"]
    h, n = word_hashes(pa.array(texts).slice(1))
    plain = [brute.WORD.findall(t or "") for t in texts[1:]]
    assert n.tolist() == [len(w) for w in plain]
    named = dict(zip([w for ws in plain for w in ws], h.tolist(), strict=True))
    assert len(set(named.values())) == len(named)
    assert [named[w] for ws in plain for w in ws] == h.tolist()


def test_classes_beyond_the_broadcast_bounds(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(hot()[:80])], "doc_id bigint, text string").repartition(3)
    want = {(r["id"], r["class_id"]) for r in neardup.classes(docs).collect()}
    for name, value in (("KEYS", 4), ("HOT", 3), ("GROUP", 5)):
        monkeypatch.setattr(neardup, name, value)
    assert {(r["id"], r["class_id"]) for r in neardup.classes(docs).collect()} == want


def twins(n):
    """n pairs of twins, at some 0.81 of each other; all texts begin alike and are at some 0.65 of the others."""
    base = " ".join(f"b{i}" for i in range(150))
    tail = lambda name, k: " ".join(f"{name}x{j}" for j in range(k))
    return [" ".join([base, tail(f"p{i}", 12), tail(f"p{i}{side}", 10 + i % 2)]) for i in range(n) for side in "lr"]


def test_no_link_of_a_large_bucket_is_lost(spark):
    n = 200
    texts = twins(n)
    near = brute.near_pairs(texts, 0.6)
    assert all(near[2 * i, 2 * i + 1] > 0.802 for i in range(n)) and max(s for (i, j), s in near.items() if i // 2 != j // 2) < 0.75
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    signed = neardup._bands(docs.selectExpr("cast(doc_id as string) AS key", "doc_id AS id", "unhex(md5(text)) AS node", "text AS t"), spark.sparkContext.broadcast(neardup.shingle_weights(docs.selectExpr("text AS t"))))
    bands = {r["id"]: set(r["bands"]) for r in signed.collect()}
    meet = {i for i in range(n) if bands[2 * i] & bands[2 * i + 1]}
    assert len(meet) > 0.98 * n
    of = {r["id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert [i for i in meet if of[2 * i + 1] != 2 * i] == []
    assert all(of[2 * i] == 2 * i for i in range(n))


def test_pairs_between_classes_are_those_of_all_pairs(spark, monkeypatch):
    texts = list(dict.fromkeys(twins(30) + hot()[:120]))
    d = spark.createDataFrame([(t, i % 3) for i, t in enumerate(texts)], "t string, part int").selectExpr("unhex(md5(t)) AS node", "t", "part")
    number = {bytes(r["node"]): texts.index(r["t"]) for r in d.collect()}
    idf = spark.sparkContext.broadcast(neardup.shingle_weights(d.select("t")))
    for name, value in (("KEYS", 4), ("HOT", 7), ("GROUP", 5)):
        monkeypatch.setattr(neardup, name, value)
    rows = d.selectExpr("node", "CASE WHEN part = 0 THEN unhex('00') ELSE node END AS root")  # a third of the texts are one class
    known = spark.createDataFrame([], "lead binary, node binary, sim double")
    found = neardup.between_classes(rows, known, d.select("node", "t"), neardup.fetch_from(d.select("node", "t")), idf, 0.8).collect()
    got = {tuple(sorted((number[bytes(r["lead"])], number[bytes(r["node"])]))): r["sim"] for r in found}
    near = {(i, j): x for (i, j), x in brute.near_pairs(texts, 0.5).items() if i % 3 or j % 3}
    assert len(got) == len(found) and {p for p, x in near.items() if x > 0.801} <= {p for p, x in got.items() if x >= 0.8}
    assert all(abs(near[p] - x) < 0.002 for p, x in got.items())
    assert len(got) < 0.7 * len(texts) ** 2 / 2


def test_splits_end_with_the_first_that_joins_nothing(spark, monkeypatch):
    """Texts at some 0.65 of each other: no split joins any, and the exact pass follows the first."""
    names, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, name: names.append(name) or write(df, name))
    texts = twins(121)[::2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r["id"]: r["class_id"] for r in neardup.classes(docs).collect()}
    assert got == {i: i for i in range(len(texts))}
    assert [n for n in names if n.startswith("part_")] == ["part_0", "part_6"]
    assert "between" in names
