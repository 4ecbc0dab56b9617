"""Disclosing terms, their spans, the rewritten text and repeated rows."""

from loomdoc.llm import pii


def rows():
    out = [(i, f"note {i} filler{i % 7} text by Zanzibar mail ann@x.org today item{i} row{i}") for i in range(40)]
    out += [(100 + i, f"plain filler{i % 7} text of row{i} and item{i + 50} today note mail by") for i in range(300)]
    return [*out, (500, "A ZANZIBAR without the address, Zanzibars too"), (500, "another text for 500: bob@y.org"), (0, out[0][1])]


def test_disclosing_terms(spark):
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows()], "doc_id bigint, text string, key int")
    got = {}
    for r in pii.find(docs).collect():
        got.setdefault(r["doc_id"], set()).add(tuple((s["kind"], s["start"], s["end"]) for s in r["spans"]))
    text = dict(rows()[:340])
    for i in range(40):
        (spans,) = got[i]
        named = {(k, text[i][a:b]) for k, a, b in spans}
        assert ("email", "ann@x.org") in named and ("term", "Zanzibar") in named
        assert not any(k == "term" and v.lower().startswith(("filler", "text", "note", "mail", "by", "today")) for k, v in named)
    assert all(got[100 + i] == {()} for i in range(300))
    assert got[500] == {(("term", 2, 10),), (("email", 22, 31),)}
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert "Zanzibar" not in texts[3] and "[EMAIL]" in texts[3] and texts[100] == text[100]
