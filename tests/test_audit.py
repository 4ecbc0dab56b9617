"""The nine rules, pages that a telling phrase makes duplicates, and days of work."""

import datetime
import json

from loomdoc import plans
from loomdoc.operators import blocks as B
from loomdoc.operators import evaluation as E


def test_nine_rules(spark):
    meta = {"file_name": "a", "extracted_at": "b"}
    good = {"page_num": 1, "type": "table", "text": "x", "is_boilerplate": None, "entities": []}
    no = lambda k: {x: v for x, v in good.items() if x != k}
    doc = lambda bs, ts=(), m=meta: json.dumps({"document_metadata": m, "text_blocks": bs, "tables": list(ts)})
    cases = [
        (doc([good], [{"table_id": "t", "rows": []}]), []),
        ("{", E.RULES),
        (None, E.RULES),
        (doc([]), E.RULES[2:]),
        (doc([good], m={"file_name": "a"}), ["metadata_present"]),
        (doc([good, good | {"page_num": 0}]), ["page_numbers_valid"]),
        (doc([good | {"type": "diagram"}]), ["block_types_valid"]),
        (doc([good | {"text": " "}, good | {"type": "blank_page", "text": ""}]), ["non_empty_text"]),
        (doc([good | {"type": "blank_page", "text": ""}]), []),
        (doc([no("is_boilerplate")]), ["boilerplate_tagged"]),
        (doc([good], [{"table_id": 1, "rows": []}]), ["table_structure_valid"]),
        (doc([good, no("entities")]), ["ner_populated"]),
    ]
    d = spark.createDataFrame([(i, j) for i, (j, _) in enumerate(cases)], "doc_id bigint, json string")
    got = {r["doc_id"]: r for r in E.nine_rules(d).collect()}
    for i, (_, failed) in enumerate(cases):
        assert [r for r in E.RULES if not got[i][r]] == list(failed) and got[i]["failed"] == len(failed), i


def test_telling_phrases_lower_the_limit(spark):
    same, a, b = (" ".join(f"{x}{i:02d}" for i in range(n)) for x, n in (("same", 12), ("left", 4), ("right", 4)))
    rows = [(1, 1, f"{same} {a}"), (1, 2, f"{same} {b}"), (2, 1, f"{same} {a}"), (2, 2, f"{same} {b} Gandhara"), (3, 1, f"{same} {a} Cave Architecture"), (3, 2, f"{same} {b}")]
    got = {tuple(r) for r in B.duplicate_pages(spark.createDataFrame(rows, "doc_id bigint, page_num bigint, text string")).collect()}
    assert got == {(2, 2)}


def test_a_day_of_work_for_each_day(spark, tmp_path):
    html = "<h1>Title {0}</h1><p>" + "words " * 40 + "</p>"
    pages = [(i, f"https://a.org/{i}", html.format(i)) for i in range(60)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["date"]: (r["articles"], r["added"]) for r in plans.QUERIES["k9_backfill_page_days"](spark, str(tmp_path)).collect()}
    assert got == {datetime.date(2024, 1, 1 + i): (2, sum(x % 4 != 0 for x in (i, i + 30))) for i in range(20, 28)}
