"""Queries over pages against their SQL where titles were cut within a character reference, as some of the larger tables' are."""

import duckdb
import pytest
from loomdoc import plans
from loomdoc.streaming import news
from pyspark.sql import functions as F

SAID = "The economy of "
CUT = ["&quot", "&quo", "&qu", "&q", "&", "&a", "&am", "&amp", "&amp;", "&quot;", "&copy", "&lt", "&ampquot;", "&amp;quot;", "&amp;amp;quot;", "\u00a0R&amp;D", "&amp;lt;"]
FILLER = "An article about later years that is long enough to count as a paragraph of its own {}."
PAGE = "<html><head><title>{0}</title><script>var t=\"</p>\";</script></head><body><article><h1>{0}</h1><p>{1}</p><p>{2}</p></article><footer>&copy; a.org</footer></body></html>"


@pytest.fixture
def same(spark, tmp_path):
    """Holds a query over pages (page_id, url, html) against its SQL."""

    def check(name, rows, files=1):
        where = f"{tmp_path}/pages.parquet"
        spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(files).write.parquet(where)
        got = plans.QUERIES[name](spark, str(tmp_path))
        cols, db = sorted(got.columns), duckdb.connect()
        db.sql(f"CREATE VIEW pages AS SELECT * FROM '{where}/*.parquet'")
        want = db.sql(f"SELECT {', '.join(cols)} FROM ({plans.SQL[name]})").fetchall()
        got = sorted(tuple(str(r[c]) for c in cols) for r in got.collect())
        assert got == sorted(tuple(str(x) for x in r) for r in want)
        return got

    return check


def cut_pages(paragraph=FILLER):
    # the first ones on the last of thirty days, the others over all of them
    return [(29 + 30 * i if i < 4 else i, f"https://a.org/{i}", PAGE.format(SAID + c, paragraph.format(f"R&amp;D {c}"), FILLER.format(i))) for i, c in enumerate(CUT)]


def test_news_bodies(same):
    empty = [(90, "https://a.org/empty", PAGE.format("", FILLER, FILLER).replace("<title>", "<title>told")), (91, "https://a.org/two", PAGE.format("first", FILLER, FILLER).replace("</article>", "<h1>second</h1></article>"))]
    got = same("a30_news_bodies", cut_pages() + empty)
    assert len(got) == len(CUT) + 1
    assert {g[2] for g in got} >= {f"{SAID}&quot", f'{SAID}"', f"{SAID}&quo", f"{SAID}&", "first"}


def test_tags(same):
    assert len(same("k1_k2_page_tags", cut_pages())) == len(CUT)


def test_new_articles(same):
    got = same("k3_new_page_articles", [(4 * i + 1, url, html) for i, (_, url, html) in enumerate(cut_pages())])
    assert {g[2] for g in got} >= {f"{SAID}&quot", f'{SAID}"', f"{SAID}&quo"}


def test_feed(same):
    got = same("k6_page_feed", [(30 * i + 29, url, html) for i, (_, url, html) in enumerate(cut_pages())])
    assert [int(g[2]) for g in sorted(got, key=lambda g: int(g[2]))] == list(range(1, len(CUT) + 1))


def test_filter(same):
    got = same("l8_client_filter", cut_pages())
    assert len(got) == len(CUT) and f"{SAID}&quot" in {g[0] for g in got}


#: Two pairs of URLs that share the first 32 bits of their SHA-256, and with them the ids of their chunks.
ALIKE = ["https://a.org/46230", "https://a.org/95836", "https://a.org/54029", "https://a.org/95918"]


def alike_pages(first=26):
    return [(first + i, url, PAGE.format(f"Title {i}", FILLER.format(i), "word " * (40 + 300 * (i % 2)))) for i, url in enumerate(ALIKE)]


def test_summary(same):
    assert [g[0] for g in same("k10_ingest_summary", alike_pages() + cut_pages())] == [str(6 + len(CUT))]


def test_summary_of_no_articles(same):
    assert same("k10_ingest_summary", [(1, "https://a.org/1", None)]) == [("0", "0", "success")]


def test_summary_of_many_batches(spark, tmp_path):
    for first in (0, 30):
        spark.createDataFrame(alike_pages(first), "page_id bigint, url string, html string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/pages.parquet")
    news.ingest(news.pages_stream(spark, str(tmp_path), files=1), f"{tmp_path}/points", f"{tmp_path}/checkpoint", F.expr("DATE '2024-01-01'"))
    assert news.stored(spark, f"{tmp_path}/points").select("batch").distinct().count() == 2
    assert [tuple(r) for r in news.totals(spark, f"{tmp_path}/points").collect()] == [(4, 6, "success")]
    assert {(r["url"], r["page_id"]) for r in news.current(spark, f"{tmp_path}/points").collect()} == {(url, 30 + i) for i, url in enumerate(ALIKE)}


def test_kept_news(same):
    assert len(same("k10_kept_news", alike_pages())) == 6


def test_news_ingest(same):
    got = same("k10_news_ingest", alike_pages() + cut_pages())
    assert {u for g in got for u in ALIKE if u in g} == set(ALIKE) and len(got) == 6 + len(CUT)
