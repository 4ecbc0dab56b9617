"""Questions without a model: turns, round counting, titles, odd requests."""

from loomdoc.operators import quiz

SCHEMA = "key bigint, subject string, topic string, pdf_name string, count bigint, content string"


def test_turns_and_rounds(spark):
    s = [f"Sentence number {i} of the text is long enough to be quoted" for i in range(5)]
    text = ". ".join(s) + ". Page 7 of this text is a heading and is never quoted here.  Too short. " + "x" * 219 + "."
    rows = [(1, "History", "", "a.pdf", 9, text), (2, None, None, None, 25, None), (3, "Law", "T", "p", 0, text), (4, "Law", "T", "p", None, text), (5, "Law", "T", "p", -3, text), (6, "S", "Topic", "", 4, ". ".join(s[:3]) + ".")]
    got = {}
    for r in quiz.fallback_questions(spark.createDataFrame(rows, SCHEMA), "key").collect():
        got.setdefault(r["key"], {})[r["id"]] = r
    assert {k: len(v) for k, v in got.items()} == {1: 9, 2: 25, 6: 4}
    full = [f"{x}." for x in s]
    for i, r in got[1].items():
        a, b, c = (full[(3 * i + j) % 5] for j in range(3))
        assert r["correct"] == (2 * i + 1) % 4 and len(r["options"]) == 4
        if i % 4 == 0:
            assert r["question"] == f"With reference to a.pdf, consider the following statements:\n1. {a}\n2. {b}\n3. {c}\n\nWhich of the statements given above is/are correct?"
        if i % 4 == 2:
            assert f"1. Sentence number {3 * i % 5} : {a}..." in r["question"]
        if i % 4 == 3:
            assert r["options"][:2] == [a, b]
    for i, r in got[2].items():
        theme = quiz.THEMES[i % 20][0].replace("{title}", "General Studies")
        assert theme in r["question"] and "{title}" not in r["question"] + "".join(r["options"])
    assert quiz.THEMES[0][1].replace("{title}", "Topic") in got[6][0]["question"]
    assert all("{" not in r["question"] for v in got.values() for r in v.values())
