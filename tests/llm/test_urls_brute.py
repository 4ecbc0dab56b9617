"""Mined rules against a plain count of all token combinations."""

import random
from itertools import combinations

from loomdoc.llm import urls


def mined(rows, min_rows, min_confidence, most=6):
    """{combination: confidence} of the least combinations that imply the label."""
    count, bad = {}, {}
    for tokens, is_bad in rows:
        if is_bad is None or not tokens:
            continue
        for n in range(1, min(most, len(tokens)) + 1):
            for c in combinations(sorted(tokens), n):
                count[c] = count.get(c, 0) + 1
                bad[c] = bad.get(c, 0) + is_bad
    good = {c: bad[c] / count[c] for c in count if bad[c] >= min_rows and bad[c] / count[c] >= min_confidence}
    return {c: v for c, v in good.items() if not any(set(d) < set(c) for d in good)}


def test_rules(spark):
    rnd = random.Random(6)
    rows = []
    for _ in range(400):
        t = sorted({f"h:{rnd.choice('abc')}", f"s:{rnd.choice('xyz')}", f"q:{rnd.choice('mn')}", "d:all.org"})
        rows.append((t, ("h:a" in t and "s:x" in t and rnd.random() < 0.9) or ("q:m" in t and "h:b" in t and rnd.random() < 0.7) or rnd.random() < 0.03))
    rows += [([], True), (["h:z"], None), (["h:rare"], True)]
    for min_rows, confidence in ((5, 0.6), (12, 0.8)):
        want = mined(rows, min_rows, confidence)
        got = urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_confidence=confidence, min_rows=min_rows).collect()
        assert {tuple(sorted(r["antecedent"])): round(r["confidence"], 9) for r in got} == {c: round(v, 9) for c, v in want.items()}
        assert want and all(r["rarest"] in r["antecedent"] for r in got)


def test_a_template_of_many_tokens(spark):
    """URLs that share a template have one combination of it, not one for each subset; any token of the template fits for the others."""
    template = [f"s:t{i}" for i in range(24)]
    rows = [(sorted([*template, "q:bad"] if i % 2 else template), i % 2 == 1) for i in range(80)]
    rows += [(["q:bad", f"h:{i}"], False) for i in range(100)]
    got = urls.mined_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_rows=20).collect()
    assert [(sorted(r["antecedent"]), r["confidence"]) for r in got] == [(["q:bad", "s:t0"], 1.0)]
    assert sorted(map(sorted, got[0]["alternatives"])) == sorted([["q:bad"], sorted(template)])


def test_alternatives_fit(spark):
    pages = [(i, f"http://x.org/{'/'.join(f't{k}' for k in range(12))}?{'bad' if i % 2 else 'good'}=1") for i in range(80)]
    pages += [(100 + i, f"http://h{i}.org/?bad=1") for i in range(100)] + [(900, "http://y.org/t7/?bad=2"), (901, "http://y.org/t7/"), (902, "http://y.org/?bad=2")]
    labels = [(i, i % 2 if i < 80 else 0) for i in [*range(80), *range(100, 200)]]
    got = urls.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"), rules=urls.RULES[1:]).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i in range(80) if i % 2} | {900}


def test_odd_rows(spark):
    pages = [(1, None), (1, None), (2, "http://a.org/" + "x/" * 20_000), (3, "http://b.org/"), (3, "http://b.org/")]
    df = lambda rows: spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 0)], "doc_id bigint, toxic int")
    got = urls.judge(df(pages), labels)
    assert sorted((r["page_id"], r["verdict"]) for r in got.collect()) == [(1, "allow"), (1, "allow"), (2, "allow"), (3, "allow"), (3, "allow")]
    assert urls.judge(df([]), labels).count() == 0 and urls.judge(df(pages), labels.limit(0)).count() == 5
