"""Queries of boilerplate, tables, entities and chunking."""

from pyspark.sql import functions as F

from ..operators import boilerplate as P
from ..operators import chunking as C
from ..operators import tables as X
from ..operators.postprocess import postprocess
from ..sources.layout import BLOCKS_SQL, blocks
from .registry import SQL, query, table

S = "[ \\t\\n\\x0b\\f\\r]+"
#: Lines among the blocks that the ladder knows, by number.
LINES = {
    1: "Page 12 of 90",
    2: "General Studies - Paper II",
    3: "Unit 7",
    4: "eGyankosh | IGNOU",
    5: "Check Your Progress 2",
    6: "Drishti IAS notes",
    7: "Rao, Anil Kumar. 1999. Title",
    8: "Sharma R S. 2004. 'Looking for the Aryans'",
    9: "All rights reserved",
    10: "Intro ..... 12",
    11: "DRAFT",
    12: "No part of this document may be copied",
    13: "notes of unit",
    14: "44",
    15: "x ignou the people's university y",
    16: "Contact: +91 98765 43210",
    17: "The people's university",
    18: "ople's",
    19: "see https://www.jstor.org/stable/4",
    20: "Course contents",
    21: "z he people's ople's w",
    22: "Indira Gandhi National Open University",
    23: "in Proceedings of the Indian History Congress",
    24: "Total  war",
    25: "University",
    26: "call whatsapp: +91 98765 43210",
    27: "Demographic data 205",
    28: "violence by non-state actors",
}
PUT = "CASE seq % 31 " + " ".join("WHEN {} THEN '{}'".format(k, v.replace("'", "''")) for k, v in LINES.items()) + " ELSE text END"
Y = "CASE WHEN seq % 17 = 13 THEN 800.0 WHEN seq % 6 = 0 THEN 20.0 ELSE 400.0 END"
ROWS = f"WITH {BLOCKS_SQL}, b AS (SELECT doc_id, seq, page_num, type, {PUT} AS text, ({Y})::DOUBLE AS y0 FROM blocks)"


def _put(spark, d):
    b = blocks(table(spark, d, "documents"))
    return b.withColumns({"text": F.expr(PUT.replace("''", "\\'")), "y0": F.expr(f"cast({Y} as double)")}).select("doc_id", "seq", "page_num", "type", "text", "y0")


#: The patterns of each kind, written out for SQL.
PATTERNS = {
    "exercise_heading": r"(?i)^\s*(check\s+your\s+progress\s*[-–]?\s*\d*|intext\s+questions?\s*\d*|self\s+assessment\s+questions?\s*\d*|activity\s+\d+|terminal\s+questions?)\s*$",
    "bibliography": r"^[A-Z][a-zA-Z\-]+,\s+[A-Z][a-zA-Z\s\.]+\.\s+\d{4}\.|^[A-Z][a-zA-Z\s\-]+\.\s+\d{4}\.\s+['\"‘’“”]|(?i:^doi\s*:\s*(10\.\d{4,}))|(?i:https?://(doi\.org/|dx\.doi\.org/|[a-z]+\.jstor\.org/stable/|[a-z]+\.luminosoa\.org/))|(?i:\b(Proceedings\s+of\s+the\s+Indian\s+History\s+Congress|Modern\s+Asian\s+Studies|The\s+Journal\s+of\s+Asian\s+Studies)\b)",
    "footer": r"(?i)^\s*(page\s+\d+\s*(of\s+\d+)?|\d+\s*/\s*\d+|-\s*\d+\s*-|\[\s*\d+\s*\]|\d+|turn\s+over|pto)\s*$|^\s*continued\s+on\s+next\s+page",
    "header": r"(?i)^\s*(upsc\s+(civil\s+services|prelims|mains|examination)|general\s+studies\s*[-–:]?\s*paper\s+[i|v|x\d]+|egyankosh\s*\|\s*ignou|subject\s*:\s*(history|geography|polity|economy|anthropology)|module\s+\d+|vision\s+ias|drishti\s+ias|insights\s+on\s+india|forum\s+ias|byju'?s\s+classes)|^\s*(chapter\s+\d+\s*[-–:]?|violence\s+and\s+repression|modern\s+warfare|total\s+war|violence\s+by\s+non[-\s]state\s+actors|unit\s+\d+|block[-\s]\d+|ignou\s+the\s+people'?s\s+university|the\s+people'?s\s+university|ignou)\s*$",
    "copyright": r"(?i)all\s+rights?\s+reserved|copyright\s*(©|\(c\))?\s*\d{4}|for\s+(internal|personal)\s+use\s+only|do\s+not\s+(copy|duplicate|reproduce|distribute)|no\s+part\s+of\s+this\s+(publication|document)\s+may\s+be|www\.[a-z0-9\-]+\.[a-z]{2,}|email\s*:\s*[^\s]+@[^\s]+|call\s*/?s*whatsapp\s*:\s*\+?\d[\d\s\-]{8,}|contact\s*:\s*\+?\d[\d\s\-]{8,}",
    "toc": r"(?i)\.{4,}\s*\d+\s*$|_{4,}\s*\d+\s*$|^\s*(contents|table\s+of\s+contents|course\s+contents|pages?)\s*$|^.{5,80}\s+\d{2,3}\s*$",
    "watermark": r"(?i)^\s*(draft|confidential|sample\s+only|for\s+review\s+only|not\s+for\s+sale|people'?s|ople'?s|he\s+people'?s\s+ople'?s|he\s+people'?s|university|indira\s+gandhi\s+national\s+open\s+university|ingou)\s*$",
}
TOP = ["upsc", "paper", "module", "chapter", "notes", "unit", "block"]


def _is(kind):
    return "regexp_matches(trim(text), '{}')".format(PATTERNS[kind].replace("'", "''"))


KIND = f"""CASE WHEN trim(text) = '' THEN NULL WHEN {_is("exercise_heading")} THEN 'exercise_heading' WHEN {_is("bibliography")} THEN 'bibliography' WHEN {_is("footer")} THEN 'footer' WHEN {_is("header")} THEN 'header'
  WHEN y0 > 842 * 0.93 AND length(trim(text)) < 80 AND ({" OR ".join(f"contains(lower(text), '{w}')" for w in TOP)}) THEN 'header' WHEN y0 < 842 * 0.07 AND length(trim(text)) < 60 THEN 'footer'
  WHEN {_is("copyright")} THEN 'copyright' WHEN {_is("toc")} THEN 'toc' WHEN {_is("watermark")} THEN 'watermark' END"""
C1 = f"{ROWS}, k AS (SELECT *, {KIND} AS boilerplate_type FROM b), c1 AS (SELECT *, boilerplate_type IS NOT NULL AND boilerplate_type NOT IN ('exercise_heading', 'bibliography') AS is_boilerplate FROM k)"


@query(f"{C1} SELECT doc_id, seq, boilerplate_type, is_boilerplate FROM c1")
def c1_boilerplate_ladder(spark, d):
    return P.tag(_put(spark, d)).select("doc_id", "seq", "boilerplate_type", "is_boilerplate")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, trim(text) AS line FROM blocks WHERE trim(text) <> '' AND length(trim(text)) < 120 GROUP BY ALL HAVING count(DISTINCT page_num) >= 3")
def c2_repeating_lines(spark, d):
    return P.repeating_lines(blocks(table(spark, d, "documents")))


C2 = f"""{C1}, rep AS (SELECT doc_id, trim(text) AS line FROM b WHERE trim(text) <> '' AND length(trim(text)) < 120 GROUP BY ALL HAVING count(DISTINCT page_num) >= 3),
  h AS (SELECT c1.*, rep.line IS NOT NULL AND NOT is_boilerplate AND coalesce(boilerplate_type NOT IN ('exercise_heading', 'bibliography'), true) AS hit FROM c1 LEFT JOIN rep ON rep.doc_id = c1.doc_id AND rep.line = trim(c1.text)),
  c2 AS (SELECT doc_id, seq, page_num, type, text, CASE WHEN hit THEN 'repeating_header_footer' ELSE boilerplate_type END AS bt, hit OR is_boilerplate AS bp FROM h),
  t AS (SELECT *, CASE WHEN bp AND bt IN ('header', 'repeating_header_footer') THEN 'header' WHEN bp AND bt = 'footer' THEN 'footer' ELSE type END AS ty FROM c2),
  s AS (SELECT *, coalesce(bt NOT IN ('exercise_heading', 'bibliography'), true) AND NOT bp AND ty IN ('header', 'footer') AND length(trim(text)) < 120 AS short FROM t),
  c3 AS (SELECT doc_id, seq, page_num, text, ty AS type, CASE WHEN short THEN ty ELSE bt END AS boilerplate_type, short OR bp AS is_boilerplate FROM s)"""


@query(f"{C2} SELECT doc_id, seq, type, boilerplate_type, is_boilerplate FROM c3")
def c3_enforced_types(spark, d):
    return P.enforce_types(P.tag_repeats(P.tag(_put(spark, d)))).select("doc_id", "seq", "type", "boilerplate_type", "is_boilerplate")


#: Every thirteenth line is a contents page's paragraph.
CONTENTS = "concat('Course Contents: theme and unit, with introduction and pages. ', repeat('and so on ', 20))"
HITS = " + ".join(f"contains(lower(text), '{w}')::INT" for w in ("course contents", "theme", "unit", "introduction", "pages"))
C4 = C2.replace(f"{PUT} AS text", f"CASE WHEN seq % 13 = 3 THEN {CONTENTS} ELSE {PUT} END AS text").replace("page_num, type, CASE", "page_num, CASE WHEN seq % 13 = 3 THEN 'paragraph' ELSE type END AS type, CASE")


@query(f"""{C4}, pg AS (SELECT DISTINCT doc_id, page_num FROM c3 WHERE type = 'paragraph' AND length(text) > 200 AND {HITS} >= 3),
  n AS (SELECT c3.*, pg.doc_id IS NOT NULL AND is_boilerplate AND regexp_matches(trim(text), '^[0-9]{{1,4}}$') AS num FROM c3 LEFT JOIN pg USING (doc_id, page_num))
  SELECT doc_id, seq, CASE WHEN num THEN 'toc_page_number' ELSE type END AS type, CASE WHEN num THEN 'toc_page_number' ELSE boilerplate_type END AS boilerplate_type FROM n""")
def c4_contents_numbers(spark, d):
    put = _put(spark, d).withColumns({"text": F.expr(f"CASE WHEN seq % 13 = 3 THEN {CONTENTS} ELSE text END"), "type": F.expr("CASE WHEN seq % 13 = 3 THEN 'paragraph' ELSE type END")})
    return P.tag_contents_numbers(P.enforce_types(P.tag_repeats(P.tag(put)))).select("doc_id", "seq", "type", "boilerplate_type")


CUT = "text"
for _p in (
    "ignou\\s+the\\s+people''?s\\s+university",
    "the\\s+people''?s\\s+university",
    "he\\s+people''?s\\s+ople''?s",
    "he\\s+people''?s",
    "people''?s\\s+university",
    "indira\\s+gandhi\\s+national\\s+open\\s+university",
    "ignou",
):
    CUT = f"regexp_replace({CUT}, '(?i)\\s*{_p}\\s*', ' ', 'g')"
BLED = "regexp_matches(text, '(?i)the\\s+people''?s\\s+university|he\\s+people''?s|people''?s\\s+university|indira\\s+gandhi\\s+national\\s+open\\s+university|ignou')"


@query(f"""{ROWS}, w AS (SELECT *, type IN ('paragraph', 'heading', 'list_item', 'caption') AND {BLED} AS was_corrected FROM b)
  SELECT doc_id, seq, was_corrected, CASE WHEN was_corrected THEN trim(regexp_replace({CUT}, '[ \\t]{{2,}}', ' ', 'g')) ELSE text END AS text FROM w""")
def c5_inline_watermarks(spark, d):
    return P.strip_watermarks(_put(spark, d)).select("doc_id", "seq", "was_corrected", "text")


@query()
def c6_boilerplate_process(spark, d):
    return P.process(_put(spark, d)).select("doc_id", "seq", "type", "boilerplate_type", "is_boilerplate", "was_corrected", "text")


# ---- tables: a text with bars is a table, a line a row
TABLES = """WITH t AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda l: string_split(l, ' | ')) AS all_rows FROM documents WHERE contains(text, '|')),
  tables AS (SELECT doc_id, all_rows[1] AS headers, all_rows[2:] AS rows FROM t)"""


def _tables(spark, d):
    t = table(spark, d, "documents").where(F.contains("text", F.lit("|"))).select("doc_id", F.transform(F.split("text", "\n"), lambda x: F.split(x, r" \| ")).alias("a"))
    return t.select("doc_id", F.col("a")[0].alias("headers"), F.slice("a", 2, F.size("a")).alias("rows"))


FILLED = "list_filter(list_transform({0}, lambda c: trim(c)), lambda c: c <> '')"


@query(f"""{TABLES}, n AS (SELECT *, len(rows) AS n, len(list_filter(rows, lambda r: regexp_matches(array_to_string(r, ' '), '\\.{{4,}}'))) AS dots,
  len(list_filter(rows, lambda r: len(list_distinct({FILLED.format('r')})) < len({FILLED.format('r')}))) AS twice FROM tables)
  SELECT doc_id, n > 0 AND (dots / nullif(n, 0) > 0.5 OR twice / nullif(n, 0) > 0.4) AS contents_like FROM n""")
def e3_contents_like_tables(spark, d):
    return _tables(spark, d).select("doc_id", X.contents_like(F.col("rows")).alias("contents_like"))


#: Every second table as a contents list, with its first row twice.
LISTED = TABLES + """, listed AS (SELECT doc_id, headers, CASE WHEN doc_id % 2 = 0 THEN list_concat(rows[:1], list_transform(rows, lambda r: list_concat(r, [' ..... 7 ']))) ELSE rows END AS rows FROM tables)"""


@query(f"""{LISTED}, n AS (SELECT *, len(rows) AS n, len(list_filter(rows, lambda r: regexp_matches(array_to_string(r, ' '), '\\.{{4,}}'))) AS dots, len(list_filter(rows, lambda r: len(list_distinct({FILLED.format('r')})) < len({FILLED.format('r')}))) AS twice FROM listed),
  r AS (SELECT doc_id, unnest(rows) AS row, generate_subscripts(rows, 1) AS row_no FROM n WHERE n > 0 AND (dots / n > 0.5 OR twice / n > 0.4)), cells AS (SELECT doc_id, row_no, trim(array_to_string({FILLED.format('row')}, ' ')) AS text FROM r),
  m AS (SELECT *, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS mark FROM cells WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY doc_id, mark ORDER BY row_no) = 1),
  said AS (SELECT DISTINCT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS mark FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents))
  SELECT doc_id, row_no, text FROM m ANTI JOIN said USING (doc_id, mark)""")
def e4_rescued_rows(spark, d):
    more = F.concat(F.slice("rows", 1, 1), F.transform("rows", lambda r: F.array_append(r, F.lit(" ..... 7 "))))
    listed = _tables(spark, d).withColumn("rows", F.when(F.col("doc_id") % 2 == 0, more).otherwise(F.col("rows")))
    return X.rescued_rows(listed, blocks(table(spark, d, "documents")))


@query(f"""{TABLES} SELECT doc_id, CASE WHEN len(rows) = 0 OR len(headers) = 0 THEN 'empty' WHEN len(rows) <= 1 AND len(headers) <= 1 THEN 'single_cell'
  WHEN len(list_filter(headers, lambda h: lower(trim(h)) NOT IN ('', 'column_1', 'column_2', 'column_3', 'column_4', 'column_5', 'column_6', 'column_7', 'column_8', 'list?', 's/no', 's.no', 'sno'))) = 0 THEN 'generic_headers'
  WHEN len(list_filter(rows, lambda r: len({FILLED.format('r')}) <= 1)) / len(rows) > 0.4 THEN 'sparse_rows' END AS reason FROM tables""")
def e5_e6_degenerate_tables(spark, d):
    return _tables(spark, d).select("doc_id", X.degenerate(F.col("headers"), F.col("rows")).alias("reason"))


@query(f"""{TABLES}, s AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN list_transform(headers, lambda h: 'same ') ELSE headers END AS h FROM tables)
  SELECT doc_id, array_to_string(CASE WHEN len(h) > 1 AND len(list_distinct(list_transform(h, lambda x: lower(trim(x))))) = 1 THEN CASE WHEN len(h) = 2 THEN ['Field', 'Value'] ELSE list_transform(h, lambda x, i: 'Column_' || i) END ELSE h END, ',') AS headers FROM s""")
def e7_repaired_headers(spark, d):
    same = F.when(F.col("doc_id") % 2 == 0, F.transform("headers", lambda h: F.lit("same "))).otherwise(F.col("headers"))
    return _tables(spark, d).select("doc_id", F.array_join(X.repair_headers(same), ",").alias("headers"))


@query()
def e8_phantom_columns(spark, d):
    t = X.merge_phantom_column(_tables(spark, d))
    return t.select("doc_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


@query(f"""{TABLES}, r AS (SELECT doc_id, headers, unnest(rows) AS row, generate_subscripts(rows, 1) AS i FROM tables)
  SELECT doc_id, 'tbl_' || doc_id || '_row_' || i AS block_id, 'Table: ' || array_to_string(list_transform(row, lambda c, k: coalesce(headers[k], 'Column_' || k) || ': ' || trim(c)), ' | ') AS text FROM r""")
def e9_table_row_texts(spark, d):
    return X.row_texts(_tables(spark, d))


@query(f"""{TABLES}, r AS (SELECT doc_id, headers, CASE WHEN doc_id % 2 = 0 THEN 'Crops' ELSE '' END AS caption, unnest(list_transform(rows, lambda q: list_concat(q, ['more']))) AS row, generate_subscripts(rows, 1) AS i FROM tables)
  SELECT doc_id, 'tbl_' || doc_id || '_row_' || i AS block_id, CASE WHEN caption <> '' THEN 'Table (' || caption || '): ' ELSE 'Table: ' END || array_to_string(list_transform(row, lambda c, k: coalesce(headers[k], 'Column_' || k) || ': ' || trim(c)), ' | ') AS text FROM r""")
def e9_captioned_row_texts(spark, d):
    """Rows with a cell more than there are headers."""
    t = _tables(spark, d).withColumn("rows", F.transform("rows", lambda r: F.array_append(r, F.lit("more"))))
    return X.row_texts(t, F.when(F.col("doc_id") % 2 == 0, "Crops").otherwise(""))


@query("""WITH d AS (SELECT doc_id, doc_id % 3 AS k, lang, text FROM documents)
  SELECT doc_id, CASE k WHEN 1 THEN 'graph ' || lang WHEN 2 THEN '```Mermaid graph ' || chr(10) || lang || '```' ELSE '' END AS code, trim(text) AS summary FROM d""")
def e10_split_diagrams(spark, d):
    n = F.col("doc_id")
    marked = F.concat(F.lit("graph "), "lang", F.lit(" ---SUMMARY--- "), "text")
    fenced = F.concat(F.lit("```Mermaid graph \n"), "lang", F.lit("``` "), "text")
    t = F.when(n % 3 == 1, marked).when(n % 3 == 2, fenced).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.split_diagram(t).alias("x")).select("doc_id", "x.*")


@query("""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, trim(text) AS t FROM documents)
  SELECT doc_id, 'blk_' || doc_id || '_line_' || i AS block_id, x AS text FROM (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i FROM l WHERE len(ls) > 1)
  UNION ALL SELECT doc_id, 'blk_' || doc_id, t FROM l WHERE len(ls) <= 1""")
def e12_blob_lines(spark, d):
    return X.blob_lines(table(spark, d, "documents").select("doc_id", F.format_string("blk_%d", "doc_id").alias("block_id"), "text"))


N = f"len(list_filter(string_split_regex(trim(text), '{S}'), lambda w: w <> ''))"


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT doc_id, page_num, seq, type, text, CASE WHEN seq % 2 = 0 THEN 50.0 ELSE 300.0 END AS x0, CASE WHEN seq % 2 = 0 THEN 290.0 ELSE 560.0 END AS x1, 30.0 * (seq // 2 % 20) AS y0, 30.0 * (seq // 2 % 20) + 12 + length(text) % 40 AS y1, {N} AS n FROM blocks WHERE trim(text) <> ''),
  j AS (SELECT a.doc_id, a.page_num, a.seq AS label_seq, v.seq AS value_seq, trim(a.text) || ': ' || trim(v.text) AS text, greatest(0.0, least(a.y1, v.y1) - greatest(a.y0, v.y0)) / least(a.y1 - a.y0, v.y1 - v.y0) AS ratio
    FROM b a JOIN b v ON a.doc_id = v.doc_id AND a.page_num = v.page_num AND a.seq <> v.seq AND a.n <= 4 AND v.n >= 3 AND v.x0 BETWEEN a.x1 - 15 AND a.x1 + 150),
  best AS (SELECT * FROM j WHERE ratio > 0.45 QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, label_seq ORDER BY ratio DESC, value_seq) = 1)
  SELECT doc_id, page_num, label_seq, value_seq, text FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, page_num, value_seq ORDER BY label_seq) = 1""")
def e13_label_values(spark, d):
    even = F.col("seq") % 2 == 0
    y = (30 * (F.floor(F.col("seq") / 2) % 20)).cast("double")
    b = blocks(table(spark, d, "documents")).withColumns({"x0": F.when(even, 50.0).otherwise(300.0), "x1": F.when(even, 290.0).otherwise(560.0), "y0": y, "y1": y + 12 + F.length("text") % 40})
    return X.label_values(b)


TOLD = "concat(CASE seq % 7 WHEN 0 THEN 'Article 21A of 1950 and the 42nd Constitutional Amendment Act' WHEN 1 THEN 'the Supreme Court and RBI in 2019, Reserve Bank' WHEN 2 THEN 'PM-KISAN, the Right to Information Act, 2005' WHEN 3 THEN 'Battle of Plassey on 23rd June 1757' WHEN 4 THEN 'code of criminal procedure 1973; Industrial Policy 1991' ELSE '' END, ' ', text)"
#: The entities' patterns, written out for SQL, in order of priority.
ENTITIES = [
    ("CONSTITUTIONAL_ARTICLE", r"(?i)\b(?:article|art\.)\s+\d+[a-z]?(?:\(\d+\))?|\b\d+(?:st|nd|rd|th)\s+constitutional\s+amendment(?:\s+act)?\b"),
    ("ACT_POLICY", r"(?i)\b[a-z\s]+\s+act,?\s+\d{4}\b|\b[a-z\s]+\s+policy,?\s+\d{4}\b|\bcode\s+of\s+[a-z\s]+\d{4}\b"),
    ("GOVT_BODY", r"(?i)\b(?:niti\s+aayog|election\s+commission|finance\s+commission|upsc|spsc|cag|law\s+commission|national\s+green\s+tribunal|ngt|supreme\s+court|high\s+court|rbi|reserve\b[a-z\s]*bank)\b"),
    ("SCHEME", r"(?i)\b(?:pm-?[a-z]+|mgnrega|ayushman\s+bharat|poshan\s+abhiyaan|swachh\s+bharat|make\s+in\s+india|digital\s+india|atmanirbhar\s+bharat)\b"),
    ("HISTORICAL_EVENT", r"(?i)\b(?:battle\s+of\s+[a-z]+|quit\s+india\s+movement|non-?cooperation\s+movement|civil\s+disobedience\s+movement|swadeshi\s+movement|treaty\s+of\s+[a-z]+|revolt\s+of\s+1857|sepoy\s+mutiny)\b"),
    ("DATE_YEAR", r"\b(?:1[0-9]{3}|20[0-2][0-9])\b|\b\d{1,2}(?:st|nd|rd|th)?\s+(?:january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}\b"),
]


def _entity_sql():
    """Matches of a label, but for those that overlap one of an earlier label: a step for each label. Places follow from what lies between matches."""
    steps, before = [], None
    for i, (label, pattern) in enumerate(ENTITIES):
        steps.append(f"""p{i} AS (SELECT doc_id, seq, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS p FROM x WHERE regexp_matches(t, '{pattern}')),
  s{i} AS (SELECT doc_id, seq, m[k] AS text, length(array_to_string(p[:k], '')) + length(array_to_string(m[:k - 1], '')) AS b FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM p{i})),
  k{i} AS (SELECT doc_id, seq, '{label}' AS label, trim(text) AS text, b AS "begin", b + length(text) AS "end" FROM s{i} s""" + (f" WHERE NOT EXISTS (SELECT 1 FROM a{i - 1} a WHERE a.doc_id = s.doc_id AND a.seq = s.seq AND s.b < a.\"end\" AND s.b + length(s.text) > a.\"begin\")" if before else "") + ")")
        steps.append(f"a{i} AS (SELECT * FROM k{i}" + (f" UNION ALL SELECT * FROM a{i - 1}" if before else "") + ")")
        before = i + 1
    return f"WITH {BLOCKS_SQL}, x AS (SELECT doc_id, seq, regexp_replace({TOLD}, '[^ -~]', '', 'g') AS t FROM blocks), " + ", ".join(steps)


LAST = len(ENTITIES) - 1


def _told(spark, d):
    return blocks(table(spark, d, "documents")).select("doc_id", "seq", F.regexp_replace(F.expr(TOLD), "[^ -~]", "").alias("text"))


@query(f'{_entity_sql()} SELECT doc_id, seq, label, text, "begin"::INT AS start, "end"::INT AS "end" FROM a{LAST}')
def e1_entities(spark, d):
    e = _told(spark, d).select("doc_id", "seq", F.explode(X.entities(F.col("text"))).alias("e"))
    return e.select("doc_id", "seq", "e.label", "e.text", "e.start", "e.end")


@query(f"{_entity_sql()} SELECT doc_id, label, count(*) AS n FROM a{LAST} GROUP BY ALL")
def e1_e2_entity_counts(spark, d):
    return X.entity_counts(_told(spark, d))


REASON = SQL["e5_e6_degenerate_tables"].replace("SELECT doc_id, CASE WHEN len(rows) = 0", "SELECT doc_id, headers, rows, CASE WHEN len(rows) = 0")
#: Tables of all kinds: cut to one row and column, with headers that name nothing, with rows of one cell.
BENT = TABLES + """, bent AS (SELECT doc_id * 10 + k AS doc_id, CASE k WHEN 1 THEN headers[:1] WHEN 2 THEN list_transform(headers, lambda h, i: CASE i WHEN 1 THEN ' S.No' WHEN 2 THEN 'Column_8' ELSE '' END) ELSE headers END AS headers,
  CASE k WHEN 1 THEN list_transform(rows[:1], lambda r: r[:1]) WHEN 3 THEN list_transform(rows, lambda r: list_concat([' '], r[2:2])) ELSE rows END AS rows FROM tables, (SELECT unnest(range(4)) AS k))"""


def _bent(spark, d):
    """Tables as they are, as a single cell, with generic headers, with sparse rows."""
    t = _tables(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    generic = F.transform("headers", lambda h, i: F.when(i == 0, " S.No").when(i == 1, "Column_8").otherwise(""))
    headers = F.when(F.col("k") == 1, F.slice("headers", 1, 1)).when(F.col("k") == 2, generic).otherwise(F.col("headers"))
    one = F.transform(F.slice("rows", 1, 1), lambda r: F.slice(r, 1, 1))
    sparse = F.transform("rows", lambda r: F.concat(F.array(F.lit(" ")), F.slice(r, 2, 1)))
    return t.select((F.col("doc_id") * 10 + F.col("k")).alias("doc_id"), headers.alias("headers"), F.when(F.col("k") == 1, one).when(F.col("k") == 3, sparse).otherwise(F.col("rows")).alias("rows"))


WHY = REASON.split("tables AS", 1)[1].split("SELECT doc_id, headers, rows, ", 1)[1].replace("AS reason FROM tables", "AS reason FROM bent")


@query(f"{BENT}, w AS (SELECT doc_id, headers, rows, {WHY}) SELECT doc_id, array_to_string(headers, '|') AS headers, len(rows) AS n_rows, reason IS NOT NULL AS needs_review FROM w WHERE reason IS NULL OR reason NOT IN ('empty', 'single_cell')")
def e6_triaged_tables(spark, d):
    t = X.triaged_tables(_bent(spark, d))
    return t.select("doc_id", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows"), "needs_review")


@query(f"""{BENT}, w AS (SELECT doc_id, headers, rows, {WHY}), r AS (SELECT doc_id, unnest(rows) AS row, generate_subscripts(rows, 1) AS row_no FROM w WHERE reason IN ('empty', 'single_cell')),
  cells AS (SELECT doc_id, row_no, array_to_string({FILLED.format('row')}, ' ') AS text FROM r), said AS (SELECT DISTINCT doc_id * 10 + 1 AS doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS mark FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents WHERE doc_id % 2 = 0))
  SELECT doc_id, row_no, 'list_item' AS type, text FROM cells c WHERE text <> '' AND NOT EXISTS (SELECT 1 FROM said s WHERE s.doc_id = c.doc_id AND s.mark = lower(trim(regexp_replace(c.text, '\\s+', ' ', 'g'))))""")
def e6_rescued_cells(spark, d):
    said = blocks(table(spark, d, "documents").where("doc_id % 2 = 0")).withColumn("doc_id", F.col("doc_id") * 10 + 1)
    return X.rescued_cells(_bent(spark, d), said).select("doc_id", "row_no", "type", "text")


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN seq % 4 = 0 THEN 1 ELSE page_num END ELSE CASE WHEN page_num % 2 = 0 THEN page_num ELSE dense_rank() OVER (PARTITION BY doc_id ORDER BY page_num) END END AS page_num, type, text FROM blocks""")
def e11_normalised_documents(spark, d):
    """Half of the documents as flat blocks, some without page; half as pages, some without number."""
    b = blocks(table(spark, d, "documents"))
    struct = F.struct(F.when((F.col("doc_id") % 2 == 1) | (F.col("seq") % 4 == 0), None).otherwise(F.col("page_num")).alias("page_num"), "type", "text")
    inner = lambda x: F.transform(F.sort_array(x), lambda y: y["b"])
    flat = b.where("doc_id % 2 = 0").groupBy("doc_id").agg(inner(F.collect_list(F.struct("seq", struct.alias("b")))).alias("text_blocks"))
    page = b.where("doc_id % 2 = 1").groupBy("doc_id", "page_num").agg(inner(F.collect_list(F.struct("seq", struct.alias("b")))).alias("text_blocks"))
    number = F.when(F.col("page_num") % 2 == 0, F.col("page_num")).alias("page_num")
    paged = page.groupBy("doc_id").agg(inner(F.collect_list(F.struct(F.col("page_num").alias("o"), F.struct(number, "text_blocks").alias("b")))).alias("pages"))
    return X.normalised(flat.unionByName(paged, allowMissingColumns=True)).select("doc_id", "page_num", "type", "text")


# ---- chunks
@query()
def f1_f3_page_chunks(spark, d):
    return C.page_chunks(blocks(table(spark, d, "documents")))


@query()
def f4_sentence_chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.sentence_chunks(F.col("text"))).alias("n", "text"))


@query(f"""WITH w AS (SELECT 'doc/' || doc_id AS url, source, list_filter(string_split_regex(text, '{S}'), lambda x: x <> '') AS ws FROM documents),
  i AS (SELECT url, source, ws, unnest(range(0, len(ws), 200)) AS i FROM w), c AS (SELECT url, source, i, ws[i + 1:i + 250] AS c FROM i)
  SELECT url, 'ca_' || sha256(url)[:8] || '_' || printf('%03d', row_number() OVER (PARTITION BY url ORDER BY i) - 1) AS chunk_id, len(c)::BIGINT AS n_words, 'Title: ' || source || chr(10) || chr(10) || array_to_string(c, ' ') AS text FROM c WHERE len(c) >= 30""")
def f5_word_windows(spark, d):
    return C.word_windows(table(spark, d, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), "text"))


@query("""WITH w AS (SELECT 'doc/' || doc_id AS url, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws, source FROM documents), i AS (SELECT url, source, ws, unnest(range(0, len(ws), 200)) AS i FROM w), c AS (SELECT source, ws[i + 1:i + 250] AS c FROM i),
  t AS (SELECT length('Title: ' || source || chr(10) || chr(10) || array_to_string(c, ' ')) AS n FROM c WHERE len(c) >= 30) SELECT count(*) AS chunks, avg(n) AS avg_chars, min(n) AS min_chars, max(n) AS max_chars FROM t""")
def f7_window_statistics(spark, d):
    return C.chunk_statistics(f5_word_windows(spark, d).select(F.length("text").alias("character_count")))


@query(f"WITH {BLOCKS_SQL} SELECT count(*) AS chunks, avg(length(text)) AS avg_chars, min(length(text)) AS min_chars, max(length(text)) AS max_chars FROM blocks")
def f7_chunk_statistics(spark, d):
    return C.chunk_statistics(blocks(table(spark, d, "documents")).select(F.length("text").alias("character_count")))


@query()
def e15_postprocessed_blocks(spark, d):
    e = postprocess(_put(spark, d))
    return e.select("doc_id", "seq", "type", "boilerplate_type", "is_boilerplate", "was_corrected", "text", F.size("entities").alias("n_entities"))


@query()
def f6_recursive_chunks(spark, d):
    return C.recursive_chunks(table(spark, d, "documents"))
