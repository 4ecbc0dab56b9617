"""Single documents read from token files, repeated ids, odd rows."""

import brute
import pytest
from loomdoc.llm import tokens

SCHEMA = "doc_id bigint, text string, start int"


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_read_some(spark, tmp_path, vocabulary):
    from tokenizers import Tokenizer

    rows = [(i, f"text number {i} " * (i % 7), 0) for i in range(300)] + [(7, "again seven", 0), (None, "no id", 0), (301, None, 0)]
    tokens.write_ids(spark.createDataFrame(rows, SCHEMA).repartition(5), f"file://{tmp_path}/t", vocabulary, end_id=1)
    wanted = spark.createDataFrame([(5,), (7,), (301,), (999,), (None,), (5,)], "doc_id bigint")
    got = tokens.read_some(spark, f"file://{tmp_path}/t", wanted).collect()
    tok = Tokenizer.from_file(vocabulary)
    want = sorted((i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in rows if i in (5, 7, 301))
    assert sorted((r["doc_id"], list(r["ids"])) for r in got) == want
    starts = sorted((r["start"], r["n_tokens"]) for r in tokens.read_ids(spark, f"file://{tmp_path}/t").collect())
    assert [a + n for a, n in starts[:-1]] == [a for a, _ in starts[1:]] and starts[0][0] == 0  # one after the other, over all shards


def test_empty(spark, tmp_path, vocabulary):
    tokens.write_ids(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/t", vocabulary, end_id=1)
    assert tokens.read_ids(spark, f"file://{tmp_path}/t").count() == 0
    assert tokens.read_some(spark, f"file://{tmp_path}/t", spark.createDataFrame([(1,)], "doc_id bigint")).count() == 0


def test_against_the_plain_version(spark, tmp_path, vocabulary):
    from tokenizers import Tokenizer

    rows = [(i, "word " * (i * 40)) for i in range(60)]
    tokens.write_ids(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA), f"file://{tmp_path}/t", vocabulary, end_id=1)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read_ids(spark, f"file://{tmp_path}/t", digest_only=True).collect()}
    assert got == brute.op5(rows, Tokenizer.from_file(vocabulary))
