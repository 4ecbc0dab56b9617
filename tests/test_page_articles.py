"""Articles of pages by hand: whole titles and bodies, where prefixes would merge articles or lose words."""

import hashlib

from loomdoc import plans

OPENING = "A licence line that many different documents share word for word, up to "


def test_whole_titles_and_bodies(spark, tmp_path):
    filler = "<p>" + "zzz " * 100 + "</p>"
    pages = [(30 * i, f"https://a.org/{i}", f"<html><body><h1>{OPENING}{i}</h1>{filler}<p>{'zzz ' * 20} {word}.</p></body></html>") for i, word in [(1, "economy"), (2, "zzz"), (3, "history"), (5, "court"), (4, "zzz")]]
    pages += [(90 + 27, "https://a.org/late", f"<h1>Zzz</h1>{filler}<p>{'zzz ' * 20} ERZ.</p>"), (90 + 28, "https://a.org/none", f"<h1>Zzz</h1>{filler}"), (30 * 7, "https://a.org/again", f"<h1>{OPENING}1</h1>{filler}")]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    run = lambda name: plans.QUERIES[name](spark, str(tmp_path)).collect()
    ident = lambda title, day: hashlib.md5(f"{title}2024-01-{day:02d}".encode()).hexdigest()[:12]
    tags = {r["place"]: r["tag"] for r in run("k1_k2_page_tags")}
    assert tags == {30: "GS-3", 60: "GS-2", 90: "GS-1", 120: "GS-2", 150: "GS-2", 210: "GS-2", 117: "GS-2", 118: "GS-2"}
    # 60 and 120 are stored (numbers in fours); 210 is 30 again; the others have the same opening only
    got = {(r["id"], r["place"], r["title"]) for r in run("k3_new_page_articles")}
    assert got == {(ident(f"{OPENING}{i}", 1), 30 * i, f"{OPENING}{i}") for i in (1, 3, 5, 2) if 30 * i % 4} | {(ident("Zzz", 28), 117, "Zzz"), (ident("Zzz", 29), 118, "Zzz")}
    assert [(r["id"], r["place"]) for r in run("k6_page_feed")] == [(ident("Zzz", 28), 1)]
    assert {r["place"] for r in run("k5_page_retention")} == {117, 118}
    assert sum(r["n"] for r in run("k4_k8_page_day_statistics")) == 8
