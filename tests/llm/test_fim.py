"""The fill-in-middle transformation against a plain version and its SQL, with frames of a few bytes as well."""

import hashlib
import random
import re

import duckdb
import pytest
from loomdoc.llm import fim, oracles

RND = random.Random(7)
SCHEMA = "doc_id bigint, text string, form string, n int"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain(doc_id, text):
    t = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", t)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 100:
        return (n, "plain", None, None, sha(t), sha(t)), t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return (n, form, len(prefix), len(middle), sha(out), sha(t)), out


def rows():
    texts = [None, "", "\n", "\n\n\n", "one line", "one line\n", "a\nb", "<P>\nx", "x\n<S>", "<\nP>", "a<\n<P\nS>\n<<M", "é𝄞\n漢字\ńx\n" * 40, "\r\n\x0b\x85 \n" * 9, "long " * 40_000 + "\n" + "tail\n" * 3, "x\n" * 100_000, "line <" * 9 + "\n"]
    texts += ["".join(RND.choices("ab\n<PSM>é𝄞", k=RND.randint(1, 200))) for _ in range(400)]
    return [*enumerate(texts), (None, "no id\nat all\n"), (5, "again\nand\nagain"), (5, "again\nand\nagain")]


@pytest.mark.parametrize("size", [1 << 16, 7])
def test_plain_version(size, monkeypatch):
    """Frame by frame, without Spark, so that the size of a frame can be made small."""
    monkeypatch.setattr(fim, "FRAME_BYTES", size)
    for i, t in rows():
        if size < 100 and len(t or "") > 20_000:
            continue
        w = fim.Writer()
        w.write((t or "").encode())
        f = w.close()
        assert b"".join(f.frame(k) for k in range(len(f.frames))) == (t or "").encode()
        assert (f.chars[-1], f.units[-1]) == (len(t or ""), (t or "").count("\n"))
        n, form, p, m, out = fim._transformed(i, f, 7)
        want, text = plain(i, t)
        assert (n, form, p, m) == want[:4]
        assert b"".join(fim._stream(out, 0, out.bytes[-1])).decode() == text
        assert b"".join(fim.restored(out, form)).decode() == (t or "")


def test_rows(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in data], SCHEMA).repartition(3)
    stored = fim.store(docs)
    moved = fim.transform(stored)
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) for r in fim.digest(stored).collect()), key=key)
    assert got == sorted(((i, *plain(i, t)[0]) for i, t in data), key=key)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in fim.texts(moved).collect()) == sorted((i is None, i, plain(i, t)[1]) for i, t in data)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in fim.texts(moved, restore=True).collect()) == sorted((i is None, i, t or "") for i, t in data)
    assert fim.digest(fim.store(docs.limit(0))).count() == 0


def test_only_cut_frames_are_decompressed(monkeypatch):
    monkeypatch.setattr(fim, "FRAME_BYTES", 64)
    w = fim.Writer()
    w.write(b"".join(b"line %d\n" % i for i in range(1000)))
    f, seen = w.close(), []
    monkeypatch.setattr(fim.Frames, "frame", lambda self, i: seen.append(i) or fim._unpack.decompress(self.frames[i]))
    assert fim._place(f, 500, 1000)[0] == sum(len(b"line %d\n" % i) for i in range(500))
    assert len(seen) == 1


def test_sql():
    db = duckdb.connect()
    data = [(i, t) for i, t in rows() if len(t or "") < 20_000]
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", data)
    got = db.sql(f"SELECT doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 FROM ({oracles.FILL_IN_MIDDLE})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(((i, *plain(i, t)[0]) for i, t in data), key=key)
