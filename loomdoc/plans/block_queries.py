"""Queries of the block operators. Blocks come from the lines of ``documents`` (sources.layout)."""

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..sources.layout import BLOCKS_SQL, blocks, pages_of
from .registry import query, table

WITH = f"WITH {BLOCKS_SQL}"
#: A text's words in DuckDB.
WORDS = "list_filter(string_split_regex({0}, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: w <> '')"


def _blocks(spark, d):
    return blocks(table(spark, d, "documents"))


JUNK = """(trim(text) = '' AND type <> 'blank_page') OR lower(trim(text)) IN ('headright', 'boxshadowdwn', 'boxshadow')
  OR (regexp_matches(trim(text), '^[0-9\\-–]$') AND type IN ('paragraph', 'footer')) OR regexp_matches(trim(text), '(?i)^2019[-–]200?$')
  OR regexp_matches(trim(text), '(?i)^\\(?https?://\\S+\\)?$')"""


@query(f"{WITH} SELECT doc_id, seq, page_num, type, text FROM blocks WHERE NOT ({JUNK})")
def b3_drop_junk_blocks(spark, d):
    return B.drop_junk(_blocks(spark, d)).select("doc_id", "seq", "page_num", "type", "text")


DUP_PAGES = f"""{WITH}, pages AS (SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY seq) AS text FROM blocks GROUP BY ALL),
  p AS (SELECT doc_id, page_num, lower(trim(regexp_replace(text, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))) AS t, dense_rank() OVER (PARTITION BY doc_id ORDER BY page_num) AS r FROM pages),
  q AS (SELECT doc_id, page_num, r, list_distinct({WORDS.format('t')}) AS w, CASE WHEN contains(t, 'cave architecture') OR contains(t, 'gandhara') THEN 0.5 ELSE 0.8 END AS enough FROM p WHERE length(t) >= 60),
  dup AS (SELECT DISTINCT a.doc_id, a.page_num FROM q a JOIN q b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r - 4 AND a.r - 1
  WHERE len(list_intersect(a.w, b.w)) >= a.enough * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))))"""


@query(f"{DUP_PAGES} SELECT doc_id, page_num FROM dup")
def b1_duplicate_pages(spark, d):
    return B.duplicate_pages(pages_of(_blocks(spark, d)))


KEPT = DUP_PAGES.replace("FROM blocks GROUP BY ALL)", "FROM blocks WHERE type NOT IN ('header', 'footer') GROUP BY ALL)")


@query(f"{KEPT} SELECT doc_id, seq FROM blocks ANTI JOIN dup USING (doc_id, page_num)")
def b1_kept_blocks(spark, d):
    return B.drop_duplicate_pages(_blocks(spark, d)).select("doc_id", "seq")


@query(f"""{WITH}, x AS (SELECT *, type = 'heading' AND lag(type) OVER w = type AND lag(page_num) OVER w = page_num AND lag(lower(trim(text))) OVER w = lower(trim(text)) AS again
  FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)) SELECT doc_id, seq, type, text FROM x WHERE NOT coalesce(again, false)""")
def b8_repeated_headings(spark, d):
    return B.drop_repeated_headings(_blocks(spark, d)).select("doc_id", "seq", "type", "text")


@query(f"""{WITH}, s AS (SELECT doc_id, page_num, text, CASE WHEN length(text) < 200 THEN 'footer' ELSE type END AS type FROM blocks)
  SELECT DISTINCT doc_id, page_num, 'blank_page' AS type, '' AS text FROM s b WHERE NOT EXISTS (SELECT 1 FROM s c WHERE c.doc_id = b.doc_id AND c.page_num = b.page_num AND c.type NOT IN ('footer', 'header', 'toc_page_number') AND trim(c.text) <> '')""")
def b10_blank_pages(spark, d):
    return B.blank_pages(_blocks(spark, d).withColumn("type", F.when(F.length("text") < 200, "footer").otherwise(F.col("type"))))


@query(f"{WITH} SELECT doc_id, seq, printf('blk_%04d', row_number() OVER (PARTITION BY doc_id ORDER BY page_num, seq)) AS block_id FROM blocks")
def b11_block_ids(spark, d):
    return B.block_ids(_blocks(spark, d)).select("doc_id", "seq", "block_id")


@query(f"""{WITH}, r AS (SELECT *, y0 / nullif(max(y0) OVER (PARTITION BY doc_id, page_num), 0) AS ratio FROM blocks),
  s AS (SELECT doc_id, seq, text, CASE WHEN ratio >= 0.85 AND type IN ('footer', 'paragraph', 'heading') AND NOT (type = 'paragraph' AND len({WORDS.format('text')}) <= 4) THEN 'header'
    WHEN ratio <= 0.15 AND type IN ('header', 'paragraph', 'heading') THEN 'footer' ELSE type END AS type FROM r)
  SELECT doc_id, seq, CASE WHEN type = 'header' AND length(trim(text)) > 150 THEN 'paragraph' ELSE type END AS type FROM s""")
def b13_retype_by_position(spark, d):
    return B.retype_by_position(_blocks(spark, d)).select("doc_id", "seq", "type")


@query(f"{WITH} SELECT doc_id, seq, CASE WHEN type = 'footer' AND length(text) < 80 AND regexp_matches(text, '^[0-9]+(\\.[0-9]+)*[ \\t]+[A-Z]') THEN 'heading' ELSE type END AS type FROM blocks")
def b16_footers_to_headings(spark, d):
    return B.footers_to_headings(_blocks(spark, d)).select("doc_id", "seq", "type")


ODD = "CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[{0}]', '', 'g')) / length(text) ELSE 0.0 END"
LATIN, PRINTABLE = "\\x20-\\x7E\\x{A0}-\\x{24F}\\x{900}-\\x{97F}", "\\x20-\\x7E"
#: A third of the lines in private-use characters, so that some are broken.
BROKEN = "CASE WHEN seq % 3 = 0 THEN translate(text, 'eantr', '\ue001\ue002\ue003\ue004\ue005') ELSE text END"


@query(f"{WITH}, x AS (SELECT doc_id, seq, {BROKEN} AS text FROM blocks) SELECT doc_id, seq, {ODD.replace('{0}', LATIN)} > 0.4 AS encoding_error FROM x")
def b17_mojibake_at_parse(spark, d):
    return B.flag_mojibake(_blocks(spark, d).withColumn("text", F.expr(BROKEN))).select("doc_id", "seq", "encoding_error")


@query(f"{WITH}, x AS (SELECT doc_id, seq, type, {BROKEN} AS text FROM blocks) SELECT doc_id, seq, type = 'footer' AND text <> '' AND {ODD.replace('{0}', PRINTABLE)} >= 0.3 AS encoding_error FROM x")
def b18_mojibake_of_boilerplate(spark, d):
    b = _blocks(spark, d).withColumns({"text": F.expr(BROKEN), "is_boilerplate": F.col("type") == "footer"})
    return B.flag_boilerplate_mojibake(b).select("doc_id", "seq", "encoding_error")


GAP = f"""{WITH}, xs AS (SELECT DISTINCT doc_id, page_num, round(x0) AS x FROM blocks WHERE x1 - x0 <= 0.7 * 612),
  g AS (SELECT *, lead(x) OVER (PARTITION BY doc_id, page_num ORDER BY x) AS nx FROM xs),
  gap AS (SELECT doc_id, page_num, arg_min((x + nx) / 2, (x - nx, x)) AS middle FROM g WHERE nx - x >= 15 AND (x + nx) / 2 BETWEEN 0.3 * 612 AND 0.7 * 612 GROUP BY ALL)"""


@query(f"{GAP} SELECT doc_id, page_num, middle FROM gap")
def b21_column_gap(spark, d):
    return B.column_gap(_blocks(spark, d))


@query(f"""{GAP}, a AS (SELECT b.*, middle, (x1 - x0 > 0.7 * 612)::INT AS anchor FROM blocks b LEFT JOIN gap USING (doc_id, page_num)),
  s AS (SELECT *, 2 * sum(anchor) OVER (PARTITION BY doc_id, page_num ORDER BY y0, seq ROWS UNBOUNDED PRECEDING) - anchor AS section, CASE WHEN anchor = 1 THEN 0 WHEN x0 >= middle THEN 1 ELSE 0 END AS side FROM a)
  SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY section, side, y0, seq) AS read_order FROM s""")
def b22_column_order(spark, d):
    return B.column_order(_blocks(spark, d)).select("doc_id", "seq", "read_order")


COLOUR = "CASE WHEN length(text) % 3 = 0 THEN 'green' WHEN length(text) % 3 = 1 THEN 'blue' END"


@query(f"""{WITH}, c AS (SELECT *, {COLOUR} AS colour FROM blocks),
  n AS (SELECT *, CASE WHEN colour IS NOT NULL AND NOT coalesce(lag(colour) OVER (PARTITION BY doc_id, page_num ORDER BY seq) = colour, false) THEN 1 ELSE 0 END AS new FROM c)
  SELECT doc_id, seq, CASE WHEN colour IS NOT NULL THEN printf('box_p%d_%03d', page_num, (sum(new) OVER (PARTITION BY doc_id, page_num ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT) END AS box FROM n""")
def b23_callout_boxes(spark, d):
    return B.callout_boxes(_blocks(spark, d).withColumn("colour", F.expr(COLOUR))).select("doc_id", "seq", "box")


@query(f"""{WITH}, r AS (SELECT doc_id, page_num, x0 - 5 AS rx0, y0 - 1 AS ry0, x1 - 20 AS rx1, y1 + 1 AS ry1 FROM blocks WHERE seq % 5 = 2)
  SELECT doc_id, seq FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND r.page_num = b.page_num AND least(x1, rx1) > greatest(x0, rx0) AND least(y1, ry1) > greatest(y0, ry0)
    AND (least(x1, rx1) - greatest(x0, rx0)) * (least(y1, ry1) - greatest(y0, ry0)) > 0.85 * (x1 - x0) * (y1 - y0))""")
def b15_covered_blocks(spark, d):
    b = _blocks(spark, d)
    rects = b.where("seq % 5 = 2").select("doc_id", "page_num", (F.col("x0") - 5).alias("rx0"), (F.col("y0") - 1).alias("ry0"), (F.col("x1") - 20).alias("rx1"), (F.col("y1") + 1).alias("ry1"))
    return B.covered_blocks(b, rects).select("doc_id", "seq")


@query(f"""{WITH}, e AS (SELECT doc_id, page_num, sum(length(text)) AS e FROM blocks GROUP BY ALL), f AS (SELECT doc_id, page_num, sum(length(text)) AS f FROM blocks WHERE type = 'paragraph' AND seq % 3 <> 0 GROUP BY ALL)
  SELECT doc_id, page_num, CASE WHEN coalesce(e, 0) < 30 THEN 'BLANK_IN_PDF' WHEN coalesce(f, 0) = 0 THEN 'MISSED' WHEN f < 30 AND e > 60 THEN 'PARTIAL' ELSE 'OK' END AS verdict FROM e FULL JOIN f USING (doc_id, page_num)""")
def b25_page_audit(spark, d):
    b = _blocks(spark, d)
    chars = lambda x: x.groupBy("doc_id", "page_num").agg(F.sum(F.length("text")).alias("chars"))
    return B.page_audit(chars(b), chars(b.where("type = 'paragraph' AND seq % 3 <> 0")))


@query(f"""{WITH}, p AS (SELECT doc_id, seq, page_num, 'again: ' || text AS text FROM blocks WHERE page_num % 4 = 2)
  SELECT doc_id, seq, page_num, text FROM blocks WHERE page_num % 4 <> 2 UNION ALL SELECT * FROM p""")
def b26_patch_pages(spark, d):
    b = _blocks(spark, d).select("doc_id", "seq", "page_num", "text")
    return B.patch_pages(b, b.where("page_num % 4 = 2").withColumn("text", F.concat(F.lit("again: "), "text"))).select("doc_id", "seq", "page_num", "text")


CHAIN = """, n AS (SELECT *, lead(type) OVER w AS nt, lead(page_num) OVER w AS np, lead(text) OVER w AS ntext FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
  j AS (SELECT *, coalesce({0}, false) AS joins FROM n),
  c AS (SELECT *, sum(CASE WHEN pj THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq) AS chain FROM (SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc_id ORDER BY seq), false) AS pj FROM j)),
  p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chain ORDER BY seq) AS place FROM c)
  SELECT doc_id, seq, CASE WHEN joins THEN {1} ELSE text END AS text FROM p WHERE place % 2 = 1"""


@query(WITH + CHAIN.format("type = 'caption' AND nt = 'caption' AND np = page_num AND NOT regexp_matches(text, '[.?!]$')", "text || ' ' || ntext"))
def b7_rejoin_captions(spark, d):
    return B.rejoin_captions(_blocks(spark, d)).select("doc_id", "seq", "text")


#: Every ninth line is boilerplate between paragraphs.
BODY = WITH.replace("WITH", "WITH", 1) + ", every AS (SELECT * FROM blocks), body AS (SELECT * FROM every WHERE seq % 9 <> 4)"
ENDS, STARTS = "regexp_matches(text, '[.!?:\u2019\"''\u201d]\\s*$')", "regexp_matches(ltrim(ntext), '^[A-Z\u2018\u201c]')"
SPLIT = CHAIN.replace("FROM blocks", "FROM body").format(f"type = 'paragraph' AND nt = 'paragraph' AND np = page_num + 1 AND trim(text) <> '' AND NOT {ENDS} AND trim(ntext) <> '' AND NOT {STARTS}", "rtrim(text) || ' ' || ltrim(ntext)")


@query(f"{BODY}{SPLIT} UNION ALL SELECT doc_id, seq, text FROM every WHERE seq % 9 = 4")
def d15_split_sentences(spark, d):
    return B.merge_split_sentences(_blocks(spark, d).withColumn("is_boilerplate", F.expr("seq % 9 = 4"))).select("doc_id", "seq", "text")


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, t AS (SELECT doc_id, page_num, seq, length(text) AS n, trim(regexp_replace(regexp_replace(lower(text), '[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x5E\\x60\\x7B-\\x7E]', '', 'g'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS t FROM blocks),
  w AS (SELECT *, {WORDS.format('t')} AS ws FROM t), v AS (SELECT *, list_distinct(ws) AS s, length(t) AS m FROM w),
  pairs AS (SELECT a.doc_id, a.page_num, a.seq AS a, b.seq AS b, CASE WHEN a.n >= b.n THEN b.seq ELSE a.seq END AS shorter, row_number() OVER (PARTITION BY a.doc_id, a.page_num ORDER BY a.seq, b.seq) AS k
    FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.page_num = b.page_num AND a.seq < b.seq
    WHERE len(a.ws) >= 8 AND abs(a.m - b.m) <= 0.5 * greatest(a.m, b.m) AND len(list_intersect(a.s, b.s)) >= 0.85 * (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))),
  fold AS (SELECT DISTINCT doc_id, page_num, 0::BIGINT AS k, []::BIGINT[] AS gone, []::BIGINT[] AS done FROM pairs
    UNION ALL SELECT f.doc_id, f.page_num, p.k, CASE WHEN list_contains(gone, a) OR list_contains(done, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, shorter) END,
      CASE WHEN list_contains(gone, a) OR list_contains(done, a) OR list_contains(gone, b) THEN done ELSE list_append(done, a) END FROM fold f JOIN pairs p ON p.doc_id = f.doc_id AND p.page_num = f.page_num AND p.k = f.k + 1),
  gone AS (SELECT doc_id, unnest(arg_max(gone, k)) AS seq FROM fold GROUP BY doc_id, page_num)
  SELECT doc_id, seq FROM blocks ANTI JOIN gone USING (doc_id, seq)""")
def b12_near_duplicate_blocks(spark, d):
    return B.near_duplicate_blocks(_blocks(spark, d)).select("doc_id", "seq")


@query(f"""{WITH}, b AS (SELECT doc_id, seq // 20 AS page_num, 'heading' AS type, seq, CASE WHEN seq % 6 = 2 THEN ' 17 ' WHEN seq % 6 = 4 THEN 'Anthropology' ELSE (seq + 1) || '. ' || text END AS text, x0, y0 FROM blocks)
  SELECT doc_id, page_num, string_agg(trim(text), chr(10) ORDER BY -y0, x0, seq) FILTER (NOT regexp_matches(trim(text), '(?i)^(anthropology|formation of new population and species|[0-9]{{1,3}})$')) AS text FROM b GROUP BY ALL HAVING count(*) >= 15 AND bool_or(regexp_matches(text, '^[0-9]+\\.\\s'))""")
def b9_shredded_tables(spark, d):
    b = _blocks(spark, d).withColumns({"page_num": F.floor(F.col("seq") / 20), "type": F.lit("heading"), "text": _cells()})
    return B.shredded_tables(b)


def _cells():
    return F.when(F.col("seq") % 6 == 2, " 17 ").when(F.col("seq") % 6 == 4, "Anthropology").otherwise(F.concat((F.col("seq") + 1).cast("string"), F.lit(". "), "text"))


@query(f"""{WITH}, b AS (SELECT doc_id, seq // 20 AS page_num, CASE WHEN seq % 20 = 7 THEN 'paragraph' ELSE 'heading' END AS type, seq, CASE WHEN seq % 6 = 2 THEN ' 17 ' WHEN seq % 6 = 4 THEN 'Anthropology' ELSE (seq + 1) || '. ' || text END AS text, x0, y0 FROM blocks),
  t AS (SELECT doc_id, page_num, string_agg(trim(text), chr(10) ORDER BY -y0, x0, seq) FILTER (NOT regexp_matches(trim(text), '(?i)^(anthropology|formation of new population and species|[0-9]{{1,3}})$')) AS text FROM b WHERE type = 'heading' GROUP BY ALL HAVING count(*) >= 15 AND bool_or(regexp_matches(text, '^[0-9]+\\.\\s'))),
  u AS (SELECT doc_id, page_num, 0 AS kind, 0 AS seq, 'table_fragment' AS type, text FROM t UNION ALL SELECT doc_id, page_num, 1, seq, type, text FROM b WHERE type <> 'heading' OR NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND t.page_num = b.page_num))
  SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, kind, seq) AS place, type, text FROM u""")
def b9_merged_fragments(spark, d):
    b = _blocks(spark, d).withColumns({"page_num": F.floor(F.col("seq") / 20), "type": F.expr("CASE WHEN seq % 20 = 7 THEN 'paragraph' ELSE 'heading' END"), "text": _cells()})
    return B.merge_shredded(b)


RGB = "(seq * 37 % 256) AS r, (seq * 91 % 256) AS g, (length(text) * 53 % 256) AS b"


@query(f"""{WITH}, c AS (SELECT doc_id, seq, {RGB} FROM blocks) SELECT doc_id, seq, CASE WHEN r >= 230 AND g >= 230 AND b >= 230 THEN NULL WHEN r > 200 AND b > 150 AND r - g > 20 AND b - g > 10 THEN 'pink_callout'
  WHEN r > 200 AND g > 180 AND b < 150 AND r - b > 60 THEN 'yellow_callout' WHEN b > 180 AND b - r > 30 AND b - g > 20 THEN 'blue_callout' END AS highlight FROM c""")
def b23_highlights(spark, d):
    c = _blocks(spark, d).selectExpr("doc_id", "seq", *RGB.replace("(", "(").split(", "))
    return c.select("doc_id", "seq", B.highlight(F.col("r"), F.col("g"), F.col("b")).alias("highlight"))


@query(f"{WITH} SELECT doc_id, seq, (x0, y0, x1, y1) IN ((50.0, 0.0, 560.0, 12.0)) AS bbox_approximate FROM blocks")
def b6_approximate_boxes(spark, d):
    moved = _blocks(spark, d)
    whole = (F.col("x0") == 50) & (F.col("y0") == 0) & (F.col("x1") == 560) & (F.col("y1") == 12)
    moved = moved.withColumns({"x0": F.when(whole, 0.0).otherwise(F.col("x0")), "x1": F.when(whole, 612.0).otherwise(F.col("x1")), "y1": F.when(whole, 792.0).otherwise(F.col("y1"))})
    return B.approximate_boxes(moved).select("doc_id", "seq", "bbox_approximate")


# ---- passes of the cleaner that look at one block, a page, or a page's tables
COLLAPSED = "CASE WHEN seq % 4 = 1 THEN 'paragraph' ELSE type END"
PUT_IN = "CASE WHEN seq % 4 = 1 THEN concat('The Heritage of India', chr(10), ' 12 ', chr(10), 'Chapter 3 of all', chr(10), text, chr(10), chr(10), '2) an item', chr(10), 'closing words ', text, repeat(' and so on', 40)) ELSE text END"
KINDS = """CASE WHEN lower(x) IN ('social science - part i', 'social science - part 1', 'social science part 1', 'social science part i', 'india''s struggle for independence', 'the heritage of india') THEN 'header'
  WHEN regexp_matches(x, '^[0-9]{1,3}$') THEN 'footer'
  WHEN regexp_matches(x, '(?i)^\\s*(chapter\\s+\\d+|exercises\\s*$|things\\s+to\\s+know\\b|india[''’]?s\\s+struggle\\s+for\\s+independence\\b|revolt\\s+of\\s+1857\\b|rise\\s+of\\s+indian\\s+nationalism\\b|indian\\s+national\\s+congress\\b|boycott\\s+and\\s+swadeshi\\b|morley[- ]minto\\b|khilafat\\b|non[- ]cooperation\\b|civil\\s+disobedience\\b|quit\\s+india\\b|the\\s+medieval\\s+period\\b|languages?\\s+and\\s+literature\\b|architecture\\b|cave\\s*architecture\\b|the\\s+heritage\\s+of\\s+india\\b)') THEN 'heading'
  WHEN regexp_matches(x, '(?i)^\\s*(\\d+[\\.\\)]|[a-z][\\.\\)]|[•\\-➢])\\s+') THEN 'list_item' END"""


@query(f"""{WITH}, b AS (SELECT doc_id, seq, {COLLAPSED} AS type, {PUT_IN} AS text FROM blocks), c AS (SELECT * FROM b WHERE type = 'paragraph' AND length(text) > 400 AND contains(text, chr(10))),
  l AS (SELECT doc_id, seq, unnest(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS x, generate_subscripts(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), 1) AS i FROM c),
  k AS (SELECT *, {KINDS} AS type FROM l), named AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, seq ORDER BY i) - 1 AS part, type, x AS text FROM k WHERE type IS NOT NULL),
  rest AS (SELECT doc_id, seq, count(type) AS part, 'paragraph' AS type, string_agg(x, ' ' ORDER BY i) FILTER (type IS NULL) AS text FROM k GROUP BY ALL HAVING count(*) > count(type))
  SELECT * FROM named UNION ALL SELECT * FROM rest UNION ALL SELECT doc_id, seq, 0, type, text FROM b WHERE NOT (type = 'paragraph' AND length(text) > 400 AND contains(text, chr(10)))""")
def b2_split_collapsed(spark, d):
    put = PUT_IN.replace("chr(10)", r"'\n'")
    return B.split_collapsed(_blocks(spark, d).withColumns({"type": F.expr(COLLAPSED), "text": F.expr(put)})).select("doc_id", "seq", F.col("part").cast("long").alias("part"), "type", "text")


HAND = "CASE seq % 6 WHEN 0 THEN 'Let’s recal l ' WHEN 1 THEN 'now let”s imagine ' WHEN 2 THEN 'Let’s  di scus s ' WHEN 3 THEN 'LET’S D O ' ELSE '' END"


@query(f"""{WITH}, b AS (SELECT doc_id, seq, type, {HAND} || text AS text FROM blocks),
  h AS (SELECT *, regexp_matches(text, '(?i)\\bLet[''’]s\\s+(recal\\s*l|imagin\\s*e|discus\\s*s|di\\s*scus\\s*s|d\\s*o)\\b') AS hit FROM b)
  SELECT doc_id, seq, CASE WHEN hit AND type = 'paragraph' THEN 'heading' ELSE type END AS type, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\\bLet[''’]s\\s+recal\\s*l\\b', 'Let''s recall', 'g'),
    '(?i)\\bLet[''’]s\\s+imagin\\s*e\\b', 'Let''s imagine', 'g'), '(?i)\\bLet[''’]s\\s+(?:discus\\s*s|di\\s*scus\\s*s)\\b', 'Let''s discuss', 'g'), '(?i)\\bLet[''’]s\\s+d\\s*o\\b', 'Let''s do', 'g') AS text FROM h""")
def b4_stylised_headings(spark, d):
    return B.repair_stylised(_blocks(spark, d).withColumn("text", F.concat(F.expr(HAND), "text"))).select("doc_id", "seq", "type", "text")


#: Pages of twenty lines, of which every seventh document's are in two columns; some blocks have no box.
SHEET = "seq // 20 AS page_num, CASE WHEN seq % 11 = 5 THEN NULL ELSE CASE WHEN seq % 2 = 0 THEN 50.0 ELSE 320.0 END END::DOUBLE AS x0, CASE WHEN doc_id % 3 = 0 THEN 550.0 WHEN seq % 2 = 0 THEN 290.0 ELSE 560.0 END::DOUBLE AS x1, (800 - 17 * (seq * 7 % 40))::DOUBLE AS y0, (812 - 17 * (seq * 7 % 40))::DOUBLE AS y1"


@query(f"""{WITH}, b AS (SELECT doc_id, seq, type, {SHEET} FROM blocks), p AS (SELECT *, x0 IS NOT NULL AS boxed, min(x0) OVER w AS lo, greatest(max(x1) FILTER (x0 IS NOT NULL) OVER w - min(x0) OVER w, 100) AS width FROM b WINDOW w AS (PARTITION BY doc_id, page_num)),
  q AS (SELECT *, (x0 + x1) / 2 < lo + width / 2 AS l, boxed AND (x1 - x0) / width < 0.5 AS narrow FROM p),
  n AS (SELECT *, count(*) FILTER (narrow AND l) OVER w AS nl, count(*) FILTER (narrow AND NOT l) OVER w AS nr, count(*) FILTER (boxed) OVER w AS nb FROM q WINDOW w AS (PARTITION BY doc_id, page_num)),
  o AS (SELECT *, CASE WHEN NOT boxed THEN 9 WHEN NOT (nl >= 4 AND nr >= 4 AND (nl + nr) / greatest(nb, 1) > 0.6) THEN 0 WHEN type = 'header' THEN 0 WHEN type = 'footer' THEN 3 WHEN l THEN 1 ELSE 2 END AS part FROM n)
  SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY part, CASE WHEN boxed THEN -round_even(y0 / 6, 0) END NULLS FIRST, CASE WHEN boxed THEN x0 END NULLS FIRST, seq) AS read_order FROM o""")
def b5_reading_order(spark, d):
    sheet = _blocks(spark, d).select("doc_id", "seq", "type", F.floor(F.col("seq") / 20).alias("page_num"), F.expr("CASE WHEN seq % 11 = 5 THEN NULL WHEN seq % 2 = 0 THEN 50.0D ELSE 320.0D END").alias("x0"), F.expr("CASE WHEN doc_id % 3 = 0 THEN 550.0D WHEN seq % 2 = 0 THEN 290.0D ELSE 560.0D END").alias("x1"), F.expr("cast(800 - 17 * (seq * 7 % 40) AS double)").alias("y0"), F.expr("cast(812 - 17 * (seq * 7 % 40) AS double)").alias("y1"))
    return B.reading_order(sheet).select("doc_id", "seq", "read_order")


#: A fold over a page as a recursion over its blocks; ASCII only, as SQL has no compatibility form.
ASCII = "regexp_replace(text, '[^ -~]', ''{0})"
TWICE = "CASE WHEN seq % 3 = 1 THEN 'Said  Before' ELSE {0} END"


@query(f"""WITH RECURSIVE {BLOCKS_SQL}, b AS (SELECT doc_id, seq // 30 AS page_num, seq, {TWICE.format(ASCII.format(", 'g'"))} AS text FROM blocks),
  m AS (SELECT doc_id, page_num, seq, lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))[:120] AS mark, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY seq) AS k FROM b),
  fold AS (SELECT DISTINCT doc_id, page_num, 0::BIGINT AS k, NULL::BIGINT AS seq, false AS gone, []::VARCHAR[] AS last FROM m
    UNION ALL SELECT f.doc_id, f.page_num, m.k, m.seq, list_contains(last, mark), CASE WHEN list_contains(last, mark) THEN last ELSE list_append(last, mark)[-10:] END FROM fold f JOIN m ON m.doc_id = f.doc_id AND m.page_num = f.page_num AND m.k = f.k + 1)
  SELECT doc_id, seq FROM fold WHERE k > 0 AND NOT gone""")
def b14_recent_repeats(spark, d):
    b = _blocks(spark, d).select("doc_id", F.floor(F.col("seq") / 30).alias("page_num"), "seq", F.expr(TWICE.format(ASCII.format(""))).alias("text"))
    return B.drop_recent_repeats(b).select("doc_id", "seq")


ASK = "CASE seq % 7 WHEN 0 THEN 'Q. ' WHEN 1 THEN 'with reference to ' WHEN 2 THEN 'Which  of ' WHEN 3 THEN '(b) ' WHEN 4 THEN 'What was ' ELSE '' END"


@query(f"""{WITH}, b AS (SELECT doc_id, seq, type, {ASK} || text AS text FROM blocks), h AS (SELECT *, type = 'footer' AND regexp_matches(trim(text), '(?i)^(Q[.\\t\\s]|PREVIOUS YEAR QUESTION|With reference|Consider the following|Which (of|one|among)|How many|What (is|are|was|were)|\\([a-d]\\)\\s)') AS hit FROM b)
  SELECT doc_id, seq, CASE WHEN hit THEN 'pyq_question' ELSE type END AS type, type = 'footer' AND NOT hit AS is_boilerplate, hit AS was_corrected FROM h""")
def b19_rescued_questions(spark, d):
    b = _blocks(spark, d).withColumns({"text": F.concat(F.expr(ASK), "text"), "is_boilerplate": F.col("type") == "footer"})
    return B.rescue_questions(b).select("doc_id", "seq", "type", "is_boilerplate", "was_corrected")


@query(f"""{WITH}, b AS (SELECT doc_id, seq, page_num, CASE WHEN seq % 5 = 2 THEN 'blank_page' ELSE type END AS type FROM blocks), t AS (SELECT DISTINCT doc_id, page_num FROM blocks WHERE contains(text, '|'))
  SELECT doc_id, seq, type FROM b WHERE type <> 'blank_page' OR NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = b.doc_id AND t.page_num = b.page_num)""")
def b20_false_blanks(spark, d):
    b = _blocks(spark, d)
    marked = b.withColumn("type", F.when(F.col("seq") % 5 == 2, "blank_page").otherwise(F.col("type")))
    return B.drop_false_blanks(marked, b.where(F.contains("text", F.lit("|")))).select("doc_id", "seq", "type")
