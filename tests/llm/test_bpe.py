"""Byte-pair encoding and decoding against the library, the lookahead of merge lists, odd rows."""

import hashlib
import json
import random

import numpy as np
import pytest
from loomdoc.llm import bpe

RND = random.Random(3)
CHARS = "abcdefghijklmnopqrstuvwxyzABCDEFZ0123456789'’'''  \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0.,!?<|>éÉßİΣςǅﬁ́̈　​漢字かが゙가각가٣²½Ⅷ𝄞😀\x00\x7f"


@pytest.fixture(scope="module")
def public():
    return pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def path(public):
    return public.path("word_bpe_49k.json")


def odd_texts():
    out = [None, "", " ", "\n", "it's <|endoftext|> THE<|startoftext|>n't", "<|endoftext|>" * 3, "<|endoftext|", "'ll'll's'S'RE", "a'\x1cs"]
    out += ["".join(RND.choices(CHARS, k=RND.randint(1, 60))) for _ in range(2000)]
    out += ["".join(RND.choices("abcdefghijklmnopqrstuvwxyz", k=n)) for n in (1000, 5000, 150_000)] + ["".join(RND.choices("ab1", k=n)) for n in (5000, 140_000)]
    return [*out, "a" * 140_000, "1" * 140_000, "!" * 3000, "the" * 50_000, "ing" * 40_000, "é" * 3000, "it'sn't" * 20_000]


def want_of(rows, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    out = {}
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        text = tok.decode(ids, skip_special_tokens=False)
        out[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    return out


@pytest.mark.parametrize("which", ["given", "odd"])
def test_against_the_library(spark, path, which, monkeypatch):
    if which == "given":
        docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    else:
        rows = list(enumerate(odd_texts()))
        docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, ids int, i string").repartition(3)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.digest(docs, path).collect()}
    assert got == want_of(rows, path)


def test_beyond_what_is_remembered(path, monkeypatch):
    import pyarrow as pa
    from loomdoc.llm import tokens

    monkeypatch.setattr(bpe, "WORDS", 5)
    monkeypatch.setattr(tokens, "CACHE", 40)
    enc, rows = bpe.StreamingEncoder(path), odd_texts()[:600]
    want = want_of(enumerate(rows), path)
    for _ in range(2):
        ids, at = enc(pa.array(rows, pa.string()))
        assert all(hashlib.sha256(ids[a:b].astype("<u4").tobytes()).hexdigest() == want[i][1] for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)))


def test_rows_and_texts(spark, path):
    rows = [(1, "the cat"), (1, "the cat"), (None, "x"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    back = bpe.decode(bpe.encode(docs, path), path).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == [(0, "x</w>"), (1, "the</w> cat</w>"), (1, "the</w> cat</w>"), (2, ""), (3, "")]
    assert bpe.digest(docs.limit(0), path).count() == 0


def test_symbol_by_symbol(path):
    """However the symbols come in, the tokens are those of the whole run, and little is held."""
    m = bpe.StreamingEncoder(path).merges
    word = m.symbols("".join(RND.choices("abcdetionsr", k=6000)), True)
    t = bpe.Transducer(m)
    t.most, out, held = m.lookahead + 1, [], 0
    for x in word[:-1]:
        out += t.push([x])
        held = max(held, len(t.held))
    assert [*out, *t.finish(word[-1:])] == m.merged(word)
    assert held <= m.lookahead + max(m.size.values())


def small_lists():
    """Proper merge lists over few symbols, so that long chains are common."""
    for seed in range(300):
        r = random.Random(seed)
        symbols = list("abc"[: r.randint(1, 3)])
        tokens, merges = list(symbols), []
        for _ in range(r.randint(1, 9)):
            pair = (r.choice(tokens), r.choice(tokens))
            if "".join(pair) not in tokens:
                merges.append(pair)
                tokens.append("".join(pair))
        yield r, symbols, bpe.MergeList({t: i for i, t in enumerate(tokens)}, merges)


def test_lookahead_suffices():
    """Tokens that end further than the lookahead from the end of a text are those of every longer text."""
    for r, symbols, m in small_lists():
        for _ in range(40):
            text = r.choices(range(len(symbols)), k=r.randint(1, 60))
            whole = m.merged(text)
            for cut in range(1, len(text)):
                end = 0
                for k, t in enumerate(m.merged(text[:cut])):
                    end += m.size[t]
                    if end > cut - m.lookahead:
                        break
                    assert whole[k] == t, (text, cut, m.rule)


def test_long_and_short_merging_agree():
    for r, symbols, m in small_lists():
        text = r.choices(range(len(symbols)), k=150)
        assert m.merged(text) == m._merged_long(text)


def test_lists_that_are_not_proper():
    with pytest.raises(ValueError, match="not proper"):
        bpe.MergeList({"a": 0, "b": 1, "ab": 2, "aab": 3}, [("a", "ab"), ("a", "b")])


def test_bytes_to_text(public):
    """A byte-level vocabulary: characters whose bytes are in several tokens, and bytes that make none."""
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    tok, dec = Tokenizer.from_file(path), bpe.Decoder(path)
    for _ in range(500):
        ids = RND.choices(range(50_257), k=RND.randint(0, 30))
        assert "".join(dec(np.array(ids, np.int64))) == tok.decode(ids, skip_special_tokens=False)
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    parts = [vocab[bpe.SHIFTED.get(b, chr(b))] for b in "é𝄞漢".encode()]
    assert "".join(dec(np.array(parts, np.int64))) == "é𝄞漢"


def test_parts_of_the_decoder(path, monkeypatch):
    dec = bpe.Decoder(path)
    ids = np.array(RND.choices(range(49_408), k=50), np.int64)
    whole = "".join(dec(ids))
    monkeypatch.setattr(bpe, "IDS_AT_ONCE", 3)
    assert "".join(dec(ids)) == whole
