"""Queries of stores and their upkeep: news days, article caches, vector deletion, retries, files and figures, and the tables and spans of extraction."""

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import state as S
from ..operators import tables as X
from ..sources.layout import BLOCKS_SQL, blocks
from .layout_queries import TABLES, _tables
from .registry import query, table


def _any(words, c="t"):
    return " OR ".join(f"contains({c}, '{w}')" for w in words)


TAGS = f"""CASE WHEN {_any(["court", "parliament", "bill", "election", "governor", "constitution", "judicial"])} THEN 'Polity' WHEN {_any(["gdp", "rbi", "inflation", "budget", "fta", "trade", "rupee", "tax"])} THEN 'Economy'
  WHEN {_any(["india-", "treaty", "summit", "bilateral", "un ", "nato", "g20"])} THEN 'International' WHEN {_any(["forest", "climate", "biodiversity", "pollution", "carbon", "wildlife"])} THEN 'Environment'
  WHEN {_any(["isro", "space", "ai ", "technology", "research", "satellite", "digital"])} THEN 'Science' WHEN {_any(["army", "navy", "missile", "defence", "security", "border"])} THEN 'Defense'
  WHEN {_any(["yojana", "scheme", "mission", "launch", "government program"])} THEN 'Schemes' ELSE 'Polity' END"""
PAPERS = f"""CASE WHEN {_any(["economy", "rbi", "inflation", "gdp", "tax", "banking", "rupee", "fiscal", "isro", "drdo", "ai", "space", "climate", "environment", "pollution", "wildlife", "security", "defense", "missile"])} THEN 'GS-3'
  WHEN {_any(["constitution", "parliament", "supreme court", "high court", "governance", "treaty", "bilateral", "un", "diplomacy", "ambassador", "foreign policy"])} THEN 'GS-2'
  WHEN {_any(["culture", "heritage", "monument", "history", "geography", "monsoon", "cyclone", "earthquake", "society", "women"])} THEN 'GS-1' ELSE 'GS-2' END"""
#: A line as an article, some with a word that tells a tag.
TITLES = "CASE seq % 12 WHEN 0 THEN 'Budget day' WHEN 1 THEN 'A Summit' WHEN 2 THEN 'Carbon' WHEN 3 THEN 'ISRO' WHEN 4 THEN 'Navy' WHEN 5 THEN 'Yojana' WHEN 6 THEN 'Heritage' WHEN 7 THEN 'GDP' ELSE lang END"
NEWS = f"""{BLOCKS_SQL}, n AS (SELECT b.doc_id, seq, {TITLES} AS title, b.text AS content FROM blocks b JOIN documents USING (doc_id)), low AS (SELECT *, lower(concat_ws(' ', coalesce(title, ''), content)) AS t FROM n), news AS (SELECT *, {TAGS} AS tag, {PAPERS} AS paper FROM low)"""


def _news(spark, d):
    docs = table(spark, d, "documents")
    return blocks(docs).join(docs.select("doc_id", "lang"), "doc_id").select("doc_id", "seq", F.expr(TITLES).alias("title"), F.col("text").alias("content"))


@query(f"""WITH {NEWS} SELECT doc_id, seq, tag, CASE tag WHEN 'Polity' THEN 'polity_governance' WHEN 'Economy' THEN 'economy' WHEN 'International' THEN 'international_relations' WHEN 'Environment' THEN 'environment_ecology' WHEN 'Science' THEN 'science_technology' WHEN 'Defense' THEN 'defense_security' ELSE 'government_schemes' END AS category,
  left(content, 400) AS summary, 'medium' AS priority FROM news""")
def k2_analysed_articles(spark, d):
    return S.analysed(_news(spark, d)).select("doc_id", "seq", "tag", "category", "summary", "priority")


@query(f"WITH {NEWS} SELECT doc_id, seq, paper FROM news")
def k1_papers(spark, d):
    paper = S.tag_by_words(F.concat_ws(" ", F.coalesce("title", F.lit("")), "content"), S.PAPERS, "GS-2")
    return _news(spark, d).select("doc_id", "seq", paper.alias("paper"))


DAYS = "e AS (SELECT DATE '2024-01-01' + (doc_id % 40)::INT AS date, doc_id AS place, 'a' || doc_id AS id FROM documents)"


def _days(spark, d):
    return table(spark, d, "documents").select(F.expr("date_add(DATE '2024-01-01', cast(doc_id % 40 as int))").alias("date"), F.col("doc_id").alias("place"), F.concat(F.lit("a"), F.col("doc_id").cast("string")).alias("id"))


@query(f"""WITH {DAYS}, p AS (SELECT *, place % 3 = 0 AND place % 40 < 30 AS new FROM e WHERE place % 3 <> 0 OR place % 40 < 30), m AS (SELECT * FROM p WHERE date IN (SELECT date FROM p WHERE new))
  SELECT date, 'UPSC Daily Briefing — ' || strftime(date, '%B %d, %Y') AS title, 'UPSC news roundup for ' || date || ' — ' || count(*) FILTER (new) || ' articles from The Hindu and PIB.' AS overview, count(*) AS n_articles, string_agg(id, ',' ORDER BY new, place) AS ids FROM m GROUP BY date""")
def k4_merged_days(spark, d):
    e = _days(spark, d)
    m = S.merged_days(e.where("place % 3 <> 0"), e.where("place % 3 = 0 AND place % 40 < 30"))
    return m.select("date", "title", "overview", "n_articles", F.array_join("ids", ",").alias("ids"))


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '' ELSE source END AS title, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS headline, CASE WHEN doc_id % 5 = 0 THEN source END AS tag, CASE WHEN doc_id % 7 < 3 THEN lang ELSE '' END AS category, CASE WHEN doc_id % 4 = 0 THEN '' ELSE text END AS summary, text AS analysis,
    CASE WHEN doc_id % 6 = 0 THEN true END AS i1, CASE WHEN doc_id % 9 = 0 THEN doc_id % 2 = 0 END AS i2 FROM documents)
  SELECT doc_id, coalesce(nullif(title, ''), nullif(headline, ''), 'Untitled') AS title, coalesce(nullif(tag, ''), nullif(category, ''), 'Polity') AS tag, coalesce(nullif(summary, ''), nullif(analysis, ''), '') AS summary, coalesce(i1, false) OR coalesce(i2, false) AS isImportant FROM a""")
def k7_day_view(spark, d):
    n = F.col("doc_id")
    a = table(spark, d, "documents").select(
        "doc_id",
        F.when(n % 2 == 0, "").otherwise(F.col("source")).alias("title"),
        F.when(n % 3 != 0, F.col("lang")).alias("headline"),
        F.when(n % 5 == 0, F.col("source")).alias("tag"),
        F.when(n % 7 < 3, F.col("lang")).otherwise("").alias("category"),
        F.when(n % 4 == 0, "").otherwise(F.col("text")).alias("summary"),
        F.col("text").alias("analysis_summary"),
        F.when(n % 6 == 0, True).alias("isImportant"),
        F.when(n % 9 == 0, n % 2 == 0).alias("is_most_important"),
    )
    return S.day_view(a).select("doc_id", "title", "tag", "summary", "isImportant")


@query(f"WITH {DAYS} SELECT * FROM e WHERE date::VARCHAR NOT IN ('2024-01-03', '2024-01-17')")
def k11_purged_days(spark, d):
    return S.purged(_days(spark, d), ["2024-01-03", "2024-01-17"])


@query(f"WITH {DAYS} SELECT date, place, id FROM e WHERE place % 40 >= 10 UNION ALL SELECT date, place, 'new ' || id FROM e WHERE place % 40 < 10 AND place % 2 = 0")
def a27_upserted_days(spark, d):
    e = _days(spark, d)
    return S.upsert_days(e, e.where("place % 40 < 10 AND place % 2 = 0").withColumn("id", F.concat(F.lit("new "), "id"))).where("place % 40 >= 10 OR place % 2 = 0")


@query("SELECT event_id, event_id::DOUBLE AS stored_at FROM events WHERE 7000.0 - event_id <= 6700")
def j6_fresh_articles(spark, d):
    c = table(spark, d, "events").select("event_id", F.col("event_id").cast("double").alias("stored_at"))
    return S.fresh(c, 7000.0, 6700.0)


@query("SELECT 'events' AS store, count(*) AS rows FROM events UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'vectors', count(*) FROM embeddings UNION ALL SELECT 'cleared', count(*) FROM events WHERE event_type = 'view'")
def j7_storage_counts(spark, d):
    e = table(spark, d, "events")
    removed = S.cleared(e, F.col("event_type") == "view").select(F.lit("cleared").alias("store"), F.col("removed").alias("rows"))
    return S.storage_counts(events=e, pages=table(spark, d, "pages"), vectors=table(spark, d, "embeddings")).unionByName(removed)


@query("SELECT f AS file_id, count(vec_id) AS deleted, (SELECT count(*) FROM embeddings WHERE vec_id % 37 NOT IN (3, 5)) AS kept FROM (SELECT unnest([3, 5, 99])::BIGINT AS f) LEFT JOIN embeddings ON vec_id % 37 = f GROUP BY f")
def a20_deleted_vectors(spark, d):
    points = table(spark, d, "embeddings").select((F.col("vec_id") % 37).alias("file_id"), "vec_id")
    gone = spark.range(1).select(F.explode(F.array(*[F.lit(x).cast("long") for x in (3, 5, 99)])).alias("file_id"))
    kept, counts = S.deleted_vectors(points, gone)
    return counts.join(F.broadcast(kept.agg(F.count("*").alias("kept"))), how="cross")


RETRIED = """r AS (SELECT doc_id AS id, CASE WHEN doc_id % 4 = 1 OR doc_id % 5 = 2 THEN 'skipped' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'ingested' END AS status,
  CASE WHEN doc_id % 4 = 1 THEN 'no path' WHEN doc_id % 5 = 2 THEN 'file missing' WHEN doc_id % 7 = 0 THEN 'timeout' END AS reason FROM documents WHERE doc_id % 3 = 0)"""


def _retried(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select(n.alias("id"), F.when(n % 3 == 0, "failed").otherwise("ingested").alias("status"), F.when(n % 4 != 1, F.format_string("%d.json", n)).alias("path"))
    files = table(spark, d, "documents").where(n % 5 != 2).select(F.format_string("%d.json", n).alias("path"))
    return S.retries(docs, files, table(spark, d, "documents").select(n.alias("id"), F.when(n % 7 == 0, "timeout").alias("error")))


@query(f"WITH {RETRIED} SELECT * FROM r")
def a24_retries(spark, d):
    return _retried(spark, d)


@query(f"WITH {RETRIED} SELECT count(*) FILTER (status = 'ingested') AS recovered, count(*) FILTER (status = 'skipped') AS skipped, count(*) FILTER (status = 'failed') AS still_failed FROM r")
def a24_retry_counts(spark, d):
    return S.retry_counts(_retried(spark, d))


@query("SELECT source AS folder, 'f ' || doc_id || '.v2.pdf' AS name, 'f ' || doc_id || '.v2_extracted_preprocessed.json' AS path, doc_id % 4 <> 0 AS there FROM documents")
def a35_expected_files(spark, d):
    docs = table(spark, d, "documents")
    name = F.format_string("f %d.v2.pdf", "doc_id")
    files = docs.where("doc_id % 4 <> 0").select(F.format_string("f %d.v2_extracted_preprocessed.json", "doc_id").alias("path"))
    return S.expected_files(docs.select(F.col("source").alias("folder"), name.alias("name")), files)


@query("SELECT source AS folder, count(*) AS total, count(*) FILTER (doc_id % 5 <> 0) AS extract_ok, count(*) FILTER (doc_id % 5 = 0) AS extract_fail, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 <> 0) AS chunk_ok, count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 3 = 0) AS chunk_fail FROM documents GROUP BY source")
def a37_folder_tallies(spark, d):
    o = table(spark, d, "documents").select(F.col("source").alias("folder"), (F.col("doc_id") % 5 != 0).alias("extracted"), (F.col("doc_id") % 3 != 0).alias("chunked"))
    return S.folder_tallies(o)


@query(f"""WITH {BLOCKS_SQL}, f AS (SELECT doc_id, page_num, seq AS "at", length(text) AS width, (seq * 13 % 200) AS height, length(text) * 50 AS bytes, CASE WHEN seq % 2 = 0 THEN 'png' ELSE 'jpg' END AS ext FROM blocks)
  SELECT doc_id, "at", printf('fig_p%03d_%02d.%s', page_num, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, "at"), ext) AS filename FROM f WHERE NOT ((width > 0 AND width < 60) OR (height > 0 AND height < 60) OR bytes < 3000)""")
def a34_kept_figures(spark, d):
    n = F.length("text")
    f = blocks(table(spark, d, "documents")).select("doc_id", "page_num", F.col("seq").alias("at"), n.alias("width"), (F.col("seq") * 13 % 200).alias("height"), (n * 50).alias("bytes"), F.when(F.col("seq") % 2 == 0, "png").otherwise("jpg").alias("ext"))
    return S.kept_figures(f).select("doc_id", "at", "filename")


#: Tables with what exports leave in them: placeholders, numbered headers, a running header's column, a citing row.
LEFT_IN = """, x AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN list_transform(headers, lambda h, i: (i - 1)::VARCHAR) WHEN 1 THEN ['0', '1'] WHEN 2 THEN list_concat(['bhic-101'], headers) ELSE list_concat(['<!-- image -->'], headers[2:]) END AS headers,
    list_concat(CASE WHEN doc_id % 4 = 2 THEN list_transform(rows, lambda r, i: list_concat([CASE WHEN i % 2 = 0 THEN ' Page Nos. ' ELSE '' END], r)) ELSE list_transform(rows, lambda r: list_concat(r[:1], ['<!-- x -->'], r[3:])) END, [['(Adapted from a book)', ''], ['(Kumar, p. 7)']]) AS rows, CASE WHEN doc_id % 3 = 0 THEN 'Table 1' ELSE '' END AS caption FROM tables)"""
CELL = "CASE WHEN contains({0}, '<!--') THEN {1} ELSE {0} END"


@query(TABLES + LEFT_IN + f""", y AS (SELECT doc_id, caption, list_transform(headers, lambda h, i: {CELL.format('h', "'Col_' || i")}) AS h, list_transform(rows, lambda r: list_transform(r, lambda c: {CELL.format('c', "''")})) AS r FROM x),
  z AS (SELECT doc_id, caption, r, CASE WHEN len(h) > 0 AND len(list_filter(h, lambda v: NOT regexp_matches(v, '^[0-9]+$'))) = 0 THEN CASE WHEN len(h) = 2 THEN ['Section / Unit', 'Page Number'] ELSE list_transform(h, lambda v: 'Column_' || (v::INT + 1)) END ELSE h END AS h FROM y),
  p AS (SELECT *, len(h) > 0 AND len(r) > 0 AND len(list_filter(r, lambda q: trim(q[1]) <> '' AND NOT regexp_matches(trim(q[1]), '(?i)india:\\s*6\\s*th\\s*century\\s*bce\\s*to\\s*200\\s*bce|^\\s*page\\s+nos?\\.\\s*$|^\\s*bhic-101\\s*$'))) = 0 AS ph FROM z),
  c AS (SELECT doc_id, caption, CASE WHEN ph THEN h[2:] ELSE h END AS h, CASE WHEN ph THEN list_transform(list_filter(r, lambda q: len(q) > 1), lambda q: q[2:]) ELSE r END AS r FROM p),
  s AS (SELECT *, list_transform(r, lambda q: array_to_string(list_filter(list_transform(q, lambda v: trim(v)), lambda v: v <> ''), ' ')) AS said FROM c),
  v AS (SELECT *, list_transform(said, lambda v: regexp_matches(v, '(?i)^\\s*\\(.*?(?:Kumar|MHI|Block|Unit|p\\.\\s*\\d+|Press|Edition|ISBN|Source|Adapted).*?\\)\\s*$')) AS cites FROM s), u AS (SELECT *, list_filter(said, lambda v, i: cites[i]) AS cs FROM v)
  SELECT doc_id, array_to_string(h, '|') AS headers, array_to_string(list_transform(list_filter(r, lambda q, i: NOT cites[i]), lambda q: array_to_string(q, '|')), chr(10)) AS rows,
    CASE WHEN len(cs) = 0 THEN caption WHEN caption <> '' THEN caption || ' (' || array_to_string(cs, ') (') || ')' WHEN len(cs) = 1 THEN cs[1] ELSE cs[1] || ' (' || array_to_string(cs[2:], ') (') || ')' END AS caption FROM u""")
def a4_repaired_exports(spark, d):
    k = F.col("doc_id") % 4
    headers = F.when(k == 0, F.transform("headers", lambda h, i: i.cast("string"))).when(k == 1, F.array(F.lit("0"), F.lit("1"))).when(k == 2, F.concat(F.array(F.lit("bhic-101")), "headers")).otherwise(F.concat(F.array(F.lit("<!-- image -->")), F.slice("headers", 2, F.size("headers"))))
    run = F.transform("rows", lambda r, i: F.concat(F.array(F.when(i % 2 == 1, " Page Nos. ").otherwise("")), r))
    held = F.transform("rows", lambda r: F.concat(F.slice(r, 1, 1), F.array(F.lit("<!-- x -->")), F.slice(r, 3, F.size(r))))
    cites = F.array(F.array(F.lit("(Adapted from a book)"), F.lit("")), F.array(F.lit("(Kumar, p. 7)")))
    t = _tables(spark, d).select("doc_id", headers.alias("headers"), F.concat(F.when(k == 2, run).otherwise(held), cites).alias("rows"), F.when(F.col("doc_id") % 3 == 0, "Table 1").otherwise("").alias("caption"))
    r = X.repaired_export(t)
    return r.select("doc_id", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda q: F.array_join(q, "|")), "\n").alias("rows"), "caption")


@query(f"""WITH {BLOCKS_SQL}, s AS (SELECT doc_id, page_num, seq // 2 AS blk, seq AS "at", CASE WHEN seq % 6 = 0 THEN '3. ' ELSE '' END || text AS text, (8 + seq % 5)::DOUBLE AS size, (seq * 97 % 842)::DOUBLE AS y0 FROM blocks WHERE doc_id % 2 = 0 AND trim(text) <> ''),
  b AS (SELECT doc_id, page_num, blk, string_agg(trim(text), ' ' ORDER BY "at") AS text, max(size) AS size, min(y0) AS y0 FROM s GROUP BY ALL HAVING length(string_agg(trim(text), ' ' ORDER BY "at")) >= 2),
  k AS (SELECT *, CASE WHEN y0 > 842 * 0.93 THEN 'footer' WHEN y0 < 842 * 0.07 THEN 'header' WHEN size >= 11 AND length(text) < 120 THEN 'heading' WHEN regexp_matches(text, '^(z |\\? |\\([a-d]\\)\\s|\\d+\\.\\s|[•\\-➢]\\s)') THEN 'list_item' ELSE 'paragraph' END AS type, count(*) OVER (PARTITION BY doc_id, page_num) AS n FROM b),
  r AS (SELECT doc_id, page_num, printf('blk_dict_p%04d_%03d', page_num, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY blk)) AS block_id, type, text, type IN ('header', 'footer') AS is_boilerplate FROM k WHERE n > 1)
  SELECT * FROM r UNION ALL SELECT doc_id, page_num, 'blk_' || seq, type, text, type = 'footer' FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = b.doc_id AND r.page_num = b.page_num)""")
def a7_restructured_pages(spark, d):
    b = blocks(table(spark, d, "documents"))
    n = F.col("seq")
    s = b.where("doc_id % 2 = 0").select("doc_id", "page_num", F.floor(n / 2).alias("blk"), n.alias("at"), F.concat(F.when(n % 6 == 0, "3. ").otherwise(""), "text").alias("text"), (8 + n % 5).cast("double").alias("size"), (n * 97 % 842).cast("double").alias("y0"), F.lit(842.0).alias("page_height"), F.trim("text").alias("t")).where("t <> ''")
    own = b.select("doc_id", "page_num", F.format_string("blk_%d", "seq").alias("block_id"), "type", "text", (F.col("type") == "footer").alias("is_boilerplate"))
    return B.restructured_pages(own, s)


@query(f"""WITH {BLOCKS_SQL}, r AS (SELECT doc_id, page_num, seq, 'Table: ' || text AS text FROM blocks WHERE seq % 3 = 0), b AS (SELECT doc_id, page_num, 0 AS kind, seq, text FROM blocks WHERE seq % 3 <> 0 UNION ALL SELECT doc_id, page_num, 1, seq, text FROM r)
  SELECT doc_id, page_num, kind, seq, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, kind, seq) AS place FROM b""")
def e14_merged_page_rows(spark, d):
    b = blocks(table(spark, d, "documents"))
    return X.merged_page_rows(b.where("seq % 3 <> 0"), b.where("seq % 3 = 0").withColumn("text", F.concat(F.lit("Table: "), "text")))
