"""The queries against plain readings of their contracts, on the small tables and on hand-made rows."""

import os
import random

import brute
import pytest

DATA = "/root/testdata/sf0.001"
RND = random.Random(5)


def hand_made():
    w = [f"w{k}" for k in range(400)]
    passage = " ".join(w[:60])
    bench = " ".join(f"Item{k}" for k in range(30))
    texts = [
        None, "", " \t\n", "x", "the " * 30, passage, "a b " + passage + " c\nd", " ".join(w[5:58]) + " tail", passage + " " + passage, " ".join(w[:49]), " ".join(RND.choices(w[:6], k=300)), " ".join(RND.choices(w[:6], k=300)),
        bench, "pre " + " ".join(bench.split()[3:20]) + " post", bench.upper() + "!", " ".join(bench.split()[:12]), "zig ZAG", "zig-zag zig zag", "solo " * 5,
        "mail a@b.com_x@y.org, a@b c..d@e.f.g.h. ip 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.255 12345678901234.1.1.1", "card 4111 1111 1111 1111, 4111-1111-1111-1112 411111111111111 12  34 0000000000000000000 00000000000000000000", "call +1 (787) 555-1710 or +49 30 1234567- +1 2 +123456789012345678 +1+22 333 444 555",
        "é𝄞 a@b.co 𝄞 +1 (787) 555-1710", "\n".join(["same line", "same line ", "same line", "", "", "other"]), "#*$%&|<> # x", "1." * 5000, "a." * 3000 + "@b.c" + ".d" * 5000, "9" * 3000 + " " + "+" * 50 + "1" * 40,
        " ".join(w) + " " + " ".join(w[100:180]), "it's <|endoftext|> THE Straße don't İ ﬁ e\u0301 \u3000x\u200b\n\nnext  two   spaces ", " \u0301x \x1c y\x85z",
    ]
    return [(i * 7 % 101, t) for i, t in enumerate(texts)]


ITEMS = [(1, " ".join(f"item{k}" for k in range(30))), (1, " ".join(f"item{k}" for k in range(30))), (2, " ".join(f"item{k}" for k in range(10, 30))), (30, "zig zag"), (4, "solo"), (5, ""), (6, None), (7, "x"), (None, "w1 w2 w3 w4")]


def table(spark, name):
    return spark.read.parquet(f"{DATA}/{name}.parquet")


@pytest.fixture(scope="module", params=["given", "hand-made"])
def docs(spark, request):
    if request.param == "given":
        d = table(spark, "documents")
        return d, [(r["doc_id"], r["text"]) for r in d.collect()], table(spark, "benchmark")
    rows = hand_made()
    d = spark.createDataFrame([(i, t, "en", None if i % 5 == 0 else "s", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_words int")
    return d.repartition(3), rows, spark.createDataFrame(ITEMS, "item_id bigint, text string")


def same(got, want):
    assert len(got) == len(want)
    bad = {k: (got.get(k), v) for k, v in want.items() if got.get(k) != v}
    assert not bad, dict(list(bad.items())[:3])


def test_substring_dedup(docs):
    from loomdoc.llm import substring

    same({r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(docs[0]).collect()}, brute.op3(docs[1]))


def test_token_files(spark, docs, tmp_path):
    import public_tokenizers
    from loomdoc.llm import tokens
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokens.write_ids(docs[0], f"file://{tmp_path}/ids", path, end_id=1)
    got = tokens.read_ids(spark, f"file://{tmp_path}/ids").collect()
    tok = Tokenizer.from_file(path)
    same({r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in got}, brute.op5(docs[1], tok))
    text = dict(docs[1])
    assert all(r["ids"] == [*tok.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 1] for r in got)


def test_personal_data(docs):
    from loomdoc.llm import pii

    got = {}
    for r in pii.find(docs[0]).collect():
        base = [s for s in r["spans"] if s["kind"] != "term"]
        got[r["doc_id"]] = (tuple(sum(s["kind"] == k for s in base) for k in brute.KINDS), [f"{s['kind']}:{s['start']}:{s['end']}" for s in base])
    same(got, {i: brute.op7(t) for i, t in docs[1]})


def test_quality_measures(docs):
    from loomdoc.llm import quality

    got = quality.judge(docs[0]).collect()
    same({r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got}, {i: brute.op9(t) for i, t in docs[1]})
    assert not any(r["kept"] and r["base_failed"] for r in got)


@pytest.mark.parametrize("rows", [20_000, 0])
def test_decontamination(docs, rows):
    from loomdoc.llm import decontam
    from pyspark.sql import functions as F

    got = decontam.judge(docs[0], docs[2], broadcast_rows=rows).select("*", F.sha2(F.array_join("items", ","), 256).alias("h")).collect()
    items = [(r["item_id"], r["text"]) for r in docs[2].collect()]
    want = brute.op10(docs[1], [(i, t) for i, t in items if i is not None])
    hits = brute.op10(docs[1], items)
    same({r["doc_id"]: (r["n_words"], r["n_hit"], len(r["items"]), r["h"], r["contaminated"]) for r in got}, {i: (a[0], b[1], a[2], a[3], b[4]) for (i, a), b in zip(want.items(), hits.values(), strict=True)})


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/EN/x", "http://example.com/en/1?q=://net/fr/", "http://www.example.com/en/", "http://a.www.example.com/en/z#f", "http://notexample.com/en/", "ftp://x.net/es/a", "http://x.net/fr", "http://net/fr/", "http://x.netx/fr/", "http://com", "http://É.COM/a", "x://a\nb.com/\nc?d", "http://u@h:80/p?q#r", "http://example.com?/en/"]


def test_url_filters(spark):
    from loomdoc.llm import urls

    rows = [(r["page_id"], r["url"]) for r in table(spark, "pages").collect()] + [(10_000 + i, u) for i, u in enumerate(URLS)]
    got = urls.judge(spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id bigint, url string, host string"), table(spark, "labels")).collect()
    want = {i: brute.op4(u) for i, u in rows}
    same({r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}, {i: (*v[:3], v[3] or "allow") for i, v in want.items()})


def test_url_rules_are_mined(spark):
    from loomdoc.llm import urls

    rows = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}{'-x' if i % 2 else ''}.site.org/{'ads' if i % 5 < 2 else 'news'}/{i}") for i in range(600)]
    toxic = lambda i: int(i % 3 == 0 and i % 2 == 0 and i % 5 < 2)
    got = urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), spark.createDataFrame([(i, toxic(i)) for i, _ in rows[:300]], "doc_id bigint, toxic int")).collect()
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {i for i, _ in rows if toxic(i)}


@pytest.mark.skipif(not os.path.exists(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["op9", "op10", "op8", "op6", "op7", "op3"])
def test_empty_tables(spark, name):
    from loomdoc.llm import decontam, mixing, pii, quality, sharding, substring

    d = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    run = {"op9": lambda: quality.judge(d), "op10": lambda: decontam.judge(d, b), "op8": lambda: sharding.assign_shards(d), "op6": lambda: mixing.mix(d), "op7": lambda: pii.find(d), "op3": lambda: substring.digest(d)}
    assert run[name]().count() == 0


def test_substring_hot_anchors(docs, monkeypatch):
    """Every shared anchor takes the way of the hot ones."""
    from loomdoc.llm import substring

    monkeypatch.setattr(substring, "HOT", 0)
    same({r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.digest(docs[0]).collect()}, brute.op3(docs[1]))


def test_substring_texts(docs):
    from loomdoc.llm import substring

    out = substring.deduplicate(docs[0])
    assert out.columns == docs[0].columns
    got, text = {r["doc_id"]: r["text"] for r in out.collect()}, dict(docs[1])
    for i, (_, gone, digest) in brute.op3(docs[1]).items():
        assert (brute.sha(got[i]) == digest) if gone else (got[i] == text[i])


def phrase_rows(n):
    """Different documents of 50 words around one phrase of 20, the seed of all; the last one's second half repeats the first one's."""
    phrase = " ".join(f"p{k}" for k in range(20))
    return [(i, " ".join([*(f"a{i}x{k}" for k in range(15)), phrase, *(f"b{i}x{k}" for k in range(15))])) for i in range(n)]


@pytest.mark.parametrize("hot", [2000, 10])
def test_substring_one_anchor_many_stretches(spark, monkeypatch, hot):
    """With so few bits of a stretch's hash in use that many collide, comparing the words keeps all."""
    from loomdoc.llm import substring

    monkeypatch.setattr(substring, "BITS", 6)
    monkeypatch.setattr(substring, "HOT", hot)
    rows = phrase_rows(1500)
    got = substring.digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert len(got) == len(rows) and all(r["n_removed"] == 0 and r["n_words"] == 50 for r in got)


def test_substring_repeated_ids_and_long_texts(spark):
    """Rows of one id never remove each other, whatever their texts; texts of 100,000 words and more are cut as short ones are."""
    from loomdoc.llm import substring

    word = lambda k: f"w{k * 7919 % 100_003}"
    long = [word(k) for k in range(120_000)]
    rows = [(7, " ".join(long)), (7, " ".join(long[50_000:])), (9, "x " * 10 + " ".join(long[1000:101_000]) + " y"), (8, "z z " * 60_000), (8, "z z " * 60_000), (10, "z " * 51)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.digest(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect())
    assert got == [(7, 70_000, 0), (7, 120_000, 0), (8, 120_000, 0), (8, 120_000, 0), (9, 100_011, 100_000), (10, 51, 51)]
