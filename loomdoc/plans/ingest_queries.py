"""Queries of the ingest flows: news pages as a stream, the stages of files, re-ingest of what has changed."""

import uuid

from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import recheck, reingest, state
from ..operators.chunking import word_windows
from ..shared import shared_dir
from ..sources import catalogue, collections
from ..sources.layout import BLOCKS_SQL, blocks
from ..streaming import news, protocol, stages
from .registry import query, table


def _fresh(spark, name):
    """A folder of its own in the shared place."""
    return f"{shared_dir(spark)}/loomdoc-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


PAPERS = {
    "GS-3": ["economy", "rbi", "inflation", "gdp", "tax", "banking", "rupee", "fiscal", "isro", "drdo", "ai", "space", "climate", "environment", "pollution", "wildlife", "security", "defense", "missile"],
    "GS-2": ["constitution", "parliament", "supreme court", "high court", "governance", "treaty", "bilateral", "un", "diplomacy", "ambassador", "foreign policy"],
    "GS-1": ["culture", "heritage", "monument", "history", "geography", "monsoon", "cyclone", "earthquake", "society", "women"],
}
PAPER = "CASE " + " ".join(f"WHEN {' OR '.join(f"contains(low, '{w}')" for w in ws)} THEN '{p}'" for p, ws in PAPERS.items()) + " ELSE 'GS-2' END"
#: What the pages' markup says, without the parts that are skipped.
PLAIN = "regexp_replace(" * 3 + "html, '(?s)<script.*?</script>', '', 'g'), '(?s)<(style|nav|header|aside)[ >].*?</(style|nav|header|aside)>', '', 'g'), '(?s)<footer.*?(</footer>|$)', '', 'g')"
SAID = "trim(regexp_replace(replace(regexp_replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&amp;?', '&', 'g'), '&quot;', '\"'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
ARTICLES_SQL = f"""plain AS (SELECT page_id, url, coalesce({PLAIN}, '') AS h FROM pages),
  parts AS (SELECT page_id, url, regexp_extract(h, '(?s)<h1>(.*?)</h1>', 1) AS h1, regexp_extract(h, '(?s)<title>(.*?)</title>', 1) AS t, list_transform(string_split(h, '<p>')[2:], lambda p: regexp_replace(p, '(?s)(</p>|</article>|</div>|<div|<ul|<h1|<h2).*$', '')) AS ps, contains(h, '<h1>') AS has_h1 FROM plain),
  said AS (SELECT page_id, url, {SAID.format("CASE WHEN has_h1 THEN h1 ELSE t END")} AS title, list_transform(ps, lambda p: {SAID.format('p')}) AS ps FROM parts),
  articles AS (SELECT page_id, url, title, list_filter(ps, lambda p: length(p) > 40) AS paragraphs FROM said)"""
POINTS_SQL = f"""{ARTICLES_SQL},
  bodies AS (SELECT page_id, url, title, array_to_string(paragraphs, ' ') AS body, DATE '2024-01-01' + (page_id % 30)::INT AS date, CASE WHEN contains(url, 'thehindu.com') THEN 'thehindu.com' WHEN contains(url, 'pib.gov.in') THEN 'pib.gov.in' ELSE 'web' END AS source FROM articles WHERE url IS NOT NULL AND title <> ''),
  tagged AS (SELECT *, {PAPER} AS gs_category FROM (SELECT *, lower(title || ' ' || body) AS low, list_filter(string_split(body, ' '), lambda w: w <> '') AS ws FROM bodies WHERE length(body) >= 100)),
  cut AS (SELECT *, unnest(CASE WHEN len(ws) <= 250 THEN [0] ELSE list_filter(range(0, len(ws), 200), lambda i: len(ws) - i >= 30) END) AS i FROM tagged),
  points AS (SELECT page_id, url, title, date, source, upper(source) AS source_label, gs_category, 'ca_' || sha256(url)[:8] || '_' || printf('%03d', i // 200 + 1) AS chunk_id, title || chr(10) || chr(10) || CASE WHEN len(ws) <= 250 THEN body ELSE array_to_string(ws[i + 1:i + 250], ' ') END AS text FROM cut QUALIFY row_number() OVER (PARTITION BY url, i ORDER BY page_id DESC) = 1)"""
DATE = "date_add(DATE '2024-01-01', cast(page_id % 30 as int))"


def _ingested(spark, d):
    out = _fresh(spark, "news")
    news.ingest(news.pages_stream(spark, d), f"{out}/points", f"{out}/checkpoint", F.expr(DATE))
    return f"{out}/points"


@query(f"WITH {POINTS_SQL} SELECT chunk_id, text, title, url, source, source_label, date, gs_category, page_id FROM points")
def k10_news_ingest(spark, d):
    return news.current(spark, _ingested(spark, d)).drop("point_id")


@query(f"WITH {POINTS_SQL} SELECT chunk_id, date, gs_category FROM points WHERE date >= DATE '2024-01-28' - 5")
def k10_kept_news(spark, d):
    return news.current(spark, _ingested(spark, d), F.expr("DATE '2024-01-28'"), 5).select("chunk_id", "date", "gs_category")


@query(f"WITH {POINTS_SQL} SELECT count(DISTINCT url) AS scraped_articles, count(*) AS chunks_upserted, 'success' AS status FROM points")
def k10_ingest_summary(spark, d):
    return news.totals(spark, _ingested(spark, d))


@query(f"WITH {ARTICLES_SQL} SELECT page_id, title, array_to_string(paragraphs, ' ') AS body FROM articles WHERE title <> '' AND length(array_to_string(paragraphs, ' ')) >= 100")
def a30_news_bodies(spark, d):
    from ..sources import web

    return web.body_v2(web.articles(table(spark, d, "pages"))).select("page_id", "title", "body")


#: Outcomes of stages out of the events: eight of a file, with repeated and misplaced ones among them.
OUTCOMES = '''e AS (SELECT event_id // 8 AS file_id, event_id AS "at", ['save', 'extract', 'preprocess', 'embed', 'upsert'][1 + (event_id % 8 + CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END) % 5] AS stage, floor(value)::BIGINT % 9 <> 0 AS ok, event_type AS detail FROM events)'''
ACCEPTED = f"""WITH RECURSIVE {OUTCOMES}, acc AS (
    SELECT file_id, min("at") AS "at", 1 AS k, arg_min(ok, "at") AS ok, arg_min(detail, "at") AS detail FROM e WHERE stage = 'save' GROUP BY file_id
    UNION ALL SELECT a.file_id, min(e."at"), a.k + 1, arg_min(e.ok, e."at"), arg_min(e.detail, e."at") FROM acc a JOIN e ON e.file_id = a.file_id AND e."at" > a."at" AND e.stage = ['save', 'extract', 'preprocess', 'embed', 'upsert'][a.k + 1] WHERE a.ok AND a.k < 5 GROUP BY a.file_id, a.k),
  t AS (SELECT e.*, acc.k, CASE WHEN acc.k IS NULL THEN '' WHEN NOT acc.ok THEN 'failed' ELSE ['registered,extracting', 'extracted,preprocessing', 'preprocessed,embedding', 'embedding', 'ingested'][acc.k] END AS passed,
    CASE WHEN acc.k IS NULL THEN NULL WHEN NOT acc.ok THEN 'failed' ELSE ['extracting', 'preprocessing', 'embedding', 'embedding', 'ingested'][acc.k] END AS now, CASE WHEN NOT acc.ok THEN CASE WHEN acc.k = 1 THEN 'Pre-registration failure: ' ELSE '' END || acc.detail END AS err FROM e LEFT JOIN acc USING (file_id, "at"))"""


def _outcomes(spark, d):
    e = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")
    place = (F.col("event_id") % 8 + F.when(F.col("user_id") % 5 == 0, 1).otherwise(0)) % 5
    stage = F.element_at(F.array(*[F.lit(s) for s in stages.STAGES]), (place + 1).cast("int"))
    return e.select(F.floor(F.col("event_id") / 8).alias("file_id"), F.col("event_id").alias("at"), stage.alias("stage"), (F.floor("value") % 9 != 0).alias("ok"), F.col("event_type").alias("detail"))


def _statuses(spark, d):
    out = _fresh(spark, "stages")
    stages.run(_outcomes(spark, d), f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(stages.OUT).parquet(f"{out}/rows")


@query(f"""{ACCEPTED} SELECT file_id, "at", stage, k IS NOT NULL AS accepted, passed, last_value(now IGNORE NULLS) OVER w AS status, last_value(err IGNORE NULLS) OVER w AS error_message,
  last_value(CASE WHEN k = 2 AND ok THEN detail END IGNORE NULLS) OVER w AS extracted_json_path, last_value(CASE WHEN k = 3 AND ok THEN detail END IGNORE NULLS) OVER w AS preprocessed_json_path FROM t WINDOW w AS (PARTITION BY file_id ORDER BY "at")""")
def a36_stage_outcomes(spark, d):
    return _statuses(spark, d).withColumn("passed", F.array_join("passed", ","))


@query(f"""{ACCEPTED}, l AS (SELECT file_id, arg_max(now, "at") AS status FROM t GROUP BY file_id) SELECT coalesce(status, 'none') AS status, count(*) AS files FROM l GROUP BY ALL""")
def a36_file_statuses(spark, d):
    last = _statuses(spark, d).groupBy("file_id").agg(F.max_by("status", "at").alias("status"))
    return last.groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("files"))


#: The documents as they were: some with other words, some not there yet, some that have gone since.
BEFORE = "SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'older words ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 4 UNION ALL SELECT -1 - doc_id, source, text FROM documents WHERE doc_id % 20 = 7"


def _windows(docs):
    """Windows of words, by document."""
    c = word_windows(docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"), F.col("source").alias("title"), "text"))
    return c.select(F.substring("url", 5, 30).cast("long").alias("doc_id"), "chunk_id", "n_words", "text")


def _reingested(spark, d):
    docs, out = table(spark, d, "documents"), _fresh(spark, "store")
    docs.createOrReplaceTempView("loomdoc_before")
    before = spark.sql(BEFORE.replace("FROM documents", "FROM loomdoc_before"))
    reports = [reingest.reingest(x, out, _windows) for x in (before, docs.select("doc_id", "source", "text"), docs.select("doc_id", "source", "text"))]
    return out, reports


@query("""WITH w AS (SELECT doc_id, 'doc/' || doc_id AS url, source, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
  i AS (SELECT doc_id, url, source, ws, unnest(range(0, len(ws), 200)) AS i FROM w), c AS (SELECT doc_id, url, source, i, ws[i + 1:i + 250] AS c FROM i)
  SELECT doc_id, 'ca_' || sha256(url)[:8] || '_' || printf('%03d', row_number() OVER (PARTITION BY url ORDER BY i) - 1) AS chunk_id, len(c)::BIGINT AS n_words, 'Title: ' || source || chr(10) || chr(10) || array_to_string(c, ' ') AS text FROM c WHERE len(c) >= 30""")
def a38_reingested_chunks(spark, d):
    out, _ = _reingested(spark, d)
    return reingest.stored(spark, out)


@query(f"""WITH b AS ({BEFORE}), j AS (SELECT b.doc_id AS was, n.doc_id AS now, b.text IS NOT DISTINCT FROM n.text AS same FROM b FULL JOIN documents n USING (doc_id)),
  r AS (SELECT 1 AS run, count(was) AS new, 0 AS changed, 0 AS gone, 0 AS kept FROM j UNION ALL SELECT 2, count(*) FILTER (was IS NULL), count(*) FILTER (was IS NOT NULL AND now IS NOT NULL AND NOT same), count(*) FILTER (now IS NULL), count(*) FILTER (was IS NOT NULL AND now IS NOT NULL AND same) FROM j
    UNION ALL SELECT 3, 0, 0, 0, count(now) FROM j) SELECT run::BIGINT AS run, new, changed, gone, kept, run < 3 AS wrote FROM r""")
def a38_reingest_runs(spark, d):
    _, reports = _reingested(spark, d)
    rows = [(i + 1, r["new"], r["changed"], r["gone"], r["kept"], r["buckets"] > 0) for i, r in enumerate(reports)]  # three runs
    return spark.createDataFrame(rows, "run bigint, new bigint, changed bigint, gone bigint, kept bigint, wrote boolean")


POINTS_BEFORE = "b AS (SELECT vec_id, 'p' || vec_id AS point_id, vec_id % 37 AS file_id, 'chk_' || vec_id AS chunk_id, 'class ' || label AS classification, 'first' AS text, embedding AS vector, label % 2 AS c FROM embeddings)"


def _collected(spark, d):
    """Two collections: filled, some points stored again or added, two files removed."""
    where, own = _fresh(spark, "collections"), uuid.uuid4().hex[:12]
    n = F.col("vec_id")
    b = table(spark, d, "embeddings").select(n, F.concat(F.lit("p"), n.cast("string")).alias("point_id"), (n % 37).alias("file_id"), F.concat(F.lit("chk_"), n.cast("string")).alias("chunk_id"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("classification"), F.lit("first").alias("text"), F.col("embedding").alias("vector"), (F.col("label") % 2).alias("c"))
    new = b.where("vec_id % 4 = 0").withColumn("text", F.lit("again")).unionByName(b.where("vec_id % 10 = 3").withColumns({"point_id": F.concat(F.lit("n"), n.cast("string")), "text": F.lit("added")}))
    gone = spark.range(3, 6, 2).withColumnRenamed("id", "file_id")
    names = [f"loomdoc_{own}_even", f"loomdoc_{own}_odd"]
    collections.ensure(spark, names, where)
    for c, name in enumerate(names):
        part = lambda df: df.where(F.col("c") == c).select(*spark.table(name).columns)  # noqa: B023, E731
        collections.put(collections.upserted(spark.table(name), part(b)), name, where)
        collections.put(collections.upserted(spark.table(name), part(new)), name, where)
        collections.put(collections.removed(spark.table(name), gone), name, where)
    return [spark.table(x).withColumn("c", F.lit(i)) for i, x in enumerate(names)]


@query(f"""WITH {POINTS_BEFORE}, n AS (SELECT * REPLACE ('again' AS text) FROM b WHERE vec_id % 4 = 0 UNION ALL SELECT * REPLACE ('n' || vec_id AS point_id, 'added' AS text) FROM b WHERE vec_id % 10 = 3), u AS (SELECT * FROM b WHERE vec_id % 4 <> 0 UNION ALL SELECT * FROM n)
  SELECT c, point_id, file_id, chunk_id, classification, text, len(vector)::INT AS dims FROM u WHERE file_id NOT IN (3, 5)""")
def a21_collections(spark, d):
    even, odd = _collected(spark, d)
    return even.unionByName(odd).select("c", "point_id", "file_id", "chunk_id", "classification", "text", F.size("vector").alias("dims"))


@query("SELECT doc_id AS file_id, lower(source) AS folder, lower(source) || '/' || doc_id || '.pdf' AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS length, md5(coalesce(text, '')) AS md5 FROM documents")
def a18_uploads(spark, d):
    out = _fresh(spark, "uploads")
    collections.upload(table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.upper("source").alias("classification"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), out)
    return collections.uploads(spark, out).select("file_id", "folder", "path", F.octet_length("content").cast("long").alias("length"), F.md5("content").alias("md5"))


@query()
def a17_folder_files(spark, d):
    """The tables' files by name and size."""
    return collections.folder_files(spark, d, "*.parquet").select("path", "name", "length")


#: Pages of which some come out empty, and how many rounds each takes to come out right: 0 to 4.
TRIES = f"{BLOCKS_SQL}, pg AS (SELECT doc_id, page_num, count(*) AS n FROM blocks GROUP BY ALL), need AS (SELECT *, CASE WHEN (doc_id + page_num) % 3 = 0 THEN (doc_id + 2 * page_num) % 5 ELSE 0 END AS need FROM pg)"


@query(f"""WITH RECURSIVE {TRIES}, r AS (SELECT doc_id, page_num, need, 0 AS attempts, need > 0 AS missing FROM need
    UNION ALL SELECT doc_id, page_num, need, attempts + 1, need > attempts + 1 FROM r WHERE missing AND attempts < 3)
  SELECT doc_id, page_num::BIGINT AS page_num, max(attempts)::INT AS attempts, NOT bool_and(missing) AS has_text FROM r GROUP BY ALL""")
def a13_rechecked_pages(spark, d):
    pg = blocks(table(spark, d, "documents")).groupBy("doc_id", F.col("page_num").cast("long").alias("page_num")).agg(F.count("*").alias("n"))
    need = F.when((F.col("doc_id") + F.col("page_num")) % 3 == 0, (F.col("doc_id") + 2 * F.col("page_num")) % 5).otherwise(0)

    def page(after):
        here = F.col("need") <= after
        return [F.when(here, "text").otherwise("").alias("text"), (~here & (F.col("need") % 2 == 0)).alias("is_blank"), F.when(~here & (F.col("need") % 2 == 1), "timeout").alias("error")]

    def extract(todo, n):
        return todo.withColumn("need", need).select("doc_id", "page_num", *page(n))

    first = pg.withColumn("need", need).select("doc_id", "page_num", *page(0))
    rows, _ = recheck.rechecked(first, extract, _fresh(spark, "recheck"))
    return rows.select("doc_id", "page_num", "attempts", (F.col("text") != "").alias("has_text"))


PROTOCOL = """e AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'purchase' THEN 'r' WHEN 'error' THEN 'e' WHEN 'signup' THEN 'd' ELSE 'p' END AS c FROM events),
  g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g),
  sessions AS (SELECT user_id, min(ts) AS start, count(*) AS events, string_agg(c, '' ORDER BY ts, event_id) AS sequence FROM n GROUP BY user_id, s),
  told AS (SELECT user_id, start::VARCHAR AS start, events, sequence, CASE WHEN contains(sequence, 'e') THEN 'error' WHEN contains(sequence, 'r') THEN 'result' ELSE 'none' END AS outcome, regexp_matches(sequence, '^p*[re]d$') AS whole FROM sessions)"""


def _protocol(e):
    kind = F.when(F.col("event_type") == "purchase", "result").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "done").otherwise("progress")
    return e.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("no"), kind.alias("type"))


@query(f"WITH {PROTOCOL} SELECT user_id, events, sequence, outcome, whole FROM told")
def m_protocol_sessions(spark, d):
    return protocol.sessions(_protocol(table(spark, d, "events")), "6 hours").drop("start")


@query(f"WITH {PROTOCOL} SELECT outcome, whole, count(*) AS sessions, sum(events)::BIGINT AS events FROM told GROUP BY ALL")
def m_protocol_outcomes(spark, d):
    s = protocol.sessions(_protocol(table(spark, d, "events")), "6 hours")
    return s.groupBy("outcome", "whole").agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("""WITH w AS (SELECT doc_id, 'doc/' || doc_id AS url, source, list_filter(string_split_regex(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
  i AS (SELECT doc_id, url, source, ws, unnest(range(0, len(ws), 200)) AS i FROM w), c AS (SELECT doc_id, url, source, i, ws[i + 1:i + 250] AS c FROM i)
  SELECT doc_id, count(*) AS chunk_count, sum(len(c))::BIGINT AS words, string_agg('ca_' || sha256(url)[:8] || '_' || printf('%03d', n), ',' ORDER BY n) AS chunk_ids FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS n FROM c WHERE len(c) >= 30) GROUP BY doc_id""")
def a16_chunk_files(spark, d):
    out = _fresh(spark, "chunks")
    catalogue.write_chunk_buckets(_windows(table(spark, d, "documents")), out)
    c = catalogue.read_chunks(spark, out, "doc_id bigint, chunk_id string, n_words bigint, text string")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.sum("n_words").alias("words"), F.array_join(F.sort_array(F.collect_list("chunk_id")), ",").alias("chunk_ids"))


#: Documents with three files each, of which some aren't there, vectors, and documents that go, some of them unknown.
CASCADE = """d AS (SELECT doc_id AS id, CASE WHEN doc_id % 6 <> 0 THEN 'u/' || doc_id || '.pdf' END AS file_path, 'e/' || doc_id || '.json' AS extracted_json_path, CASE WHEN doc_id % 4 <> 0 THEN 'p/' || doc_id || '.json' END AS preprocessed_json_path FROM documents),
  f AS (SELECT file_path AS path FROM d WHERE id % 5 <> 0 AND file_path IS NOT NULL UNION ALL SELECT extracted_json_path FROM d WHERE id % 7 <> 0 UNION ALL SELECT preprocessed_json_path FROM d WHERE preprocessed_json_path IS NOT NULL),
  v AS (SELECT vec_id, vec_id // 3 AS file_id FROM embeddings), g AS (SELECT DISTINCT doc_id * CASE WHEN doc_id % 9 = 0 THEN -1 ELSE 1 END AS id FROM labels WHERE quality = 0),
  j AS (SELECT g.id, d.id IS NOT NULL AS found, file_path, file_path IN (SELECT path FROM f) AS pdf, extracted_json_path IN (SELECT path FROM f) AS ext, preprocessed_json_path IN (SELECT path FROM f) AS pre FROM g LEFT JOIN d USING (id)),
  report AS (SELECT id, found, (SELECT count(*) FROM v WHERE file_id = j.id) AS vectors_deleted, found AS record_deleted, coalesce(pdf, false) AS pdf_deleted, coalesce(ext, false) AS extracted_deleted, coalesce(pre, false) AS preprocessed_deleted,
    CASE WHEN NOT found THEN '' ELSE array_to_string(list_filter([CASE WHEN NOT coalesce(pdf, false) THEN 'PDF file not found on disk (path: ' || coalesce(file_path, 'None') || ') — skipped.' END, CASE WHEN NOT coalesce(ext, false) THEN 'Extracted JSON not found on disk — skipped.' END, CASE WHEN NOT coalesce(pre, false) THEN 'Preprocessed JSON not found on disk — skipped.' END], lambda x: x IS NOT NULL), '|') END AS warnings FROM j)"""


def _cascade(spark, d):
    n = F.col("doc_id")
    docs = table(spark, d, "documents").select(n.alias("id"), F.when(n % 6 != 0, F.format_string("u/%d.pdf", n)).alias("file_path"), F.format_string("e/%d.json", n).alias("extracted_json_path"), F.when(n % 4 != 0, F.format_string("p/%d.json", n)).alias("preprocessed_json_path"))
    files = docs.where("id % 5 <> 0").select(F.col("file_path").alias("path")).unionAll(docs.where("id % 7 <> 0").select("extracted_json_path")).unionAll(docs.select("preprocessed_json_path")).where("path IS NOT NULL")
    vectors = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 3).alias("file_id"))
    gone = table(spark, d, "labels").where("quality = 0").select((n * F.when(n % 9 == 0, -1).otherwise(1)).alias("id"))
    return catalogue.cascade(docs, vectors, files, gone)


@query(f"WITH {CASCADE} SELECT * FROM report")
def a25_cascade_reports(spark, d):
    return _cascade(spark, d)[1].withColumn("warnings", F.array_join("warnings", "|"))


@query(f"""WITH {CASCADE}, k AS (SELECT * FROM j WHERE found) SELECT 'documents' AS store, count(*) AS rows FROM d WHERE id NOT IN (SELECT id FROM k) UNION ALL SELECT 'vectors', count(*) FROM v WHERE file_id NOT IN (SELECT id FROM k)
  UNION ALL SELECT 'files', count(*) FROM f WHERE path NOT IN (SELECT p FROM (SELECT unnest([d.file_path, d.extracted_json_path, d.preprocessed_json_path]) AS p FROM k JOIN d USING (id)) WHERE p IS NOT NULL)""")
def a25_kept_stores(spark, d):
    kept, _ = _cascade(spark, d)
    one = lambda k: kept[k].agg(F.count("*").alias("rows")).select(F.lit(k).alias("store"), "rows")
    return one("documents").unionByName(one("vectors")).unionByName(one("files"))


#: Pages in fours: the third ones were partial, the fourth ones missing; both are read again, in every fifth document in vain.
AGAIN = f"""{BLOCKS_SQL}, old AS (SELECT doc_id, seq, page_num, 'blk_' || seq AS block_id, type, text, y0 FROM blocks WHERE page_num % 4 <> 3),
  raw AS (SELECT doc_id, page_num, seq % 5 AS b, trim(CASE seq % 6 WHEN 0 THEN '- ' || text WHEN 1 THEN '1. ' || text || ' and so on until the line is a long one, longer than a heading may be' ELSE text END, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text, (seq * 97 % 842)::DOUBLE AS y0 FROM blocks WHERE page_num % 4 >= 2 AND doc_id % 5 <> 0),
  new AS (SELECT doc_id, page_num, printf('blk_re_p%d_%04d', page_num, b) AS block_id, CASE WHEN length(text) < 80 AND NOT ends_with(text, '.') THEN 'heading' WHEN regexp_matches(text, '^(•|-|\\*|[1-5]\\.|\\(a\\)|\\(b\\)|\\(i\\))') THEN 'list_item' ELSE 'paragraph' END AS type, text, y0 FROM raw WHERE text <> ''),
  every AS (SELECT doc_id, page_num, block_id, type, text, y0, 0 AS kind, printf('%020d', seq) AS k FROM old WHERE NOT (page_num % 4 = 2 AND doc_id IN (SELECT doc_id FROM new)) UNION ALL SELECT doc_id, page_num, block_id, type, text, y0, 1, block_id FROM new)"""


@query(f"WITH {AGAIN} SELECT doc_id, page_num, block_id, type, text, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, y0, kind, k) AS place FROM every")
def b26_reextracted_pages(spark, d):
    b, n = blocks(table(spark, d, "documents")), F.col("seq")
    old = b.where("page_num % 4 <> 3").select("doc_id", "seq", "page_num", F.format_string("blk_%d", "seq").alias("block_id"), "type", "text", "y0")
    text = F.when(n % 6 == 0, F.concat(F.lit("- "), "text")).when(n % 6 == 1, F.concat(F.lit("1. "), "text", F.lit(" and so on until the line is a long one, longer than a heading may be"))).otherwise(F.col("text"))
    raw = b.where("page_num % 4 >= 2 AND doc_id % 5 <> 0").select("doc_id", "page_num", (n % 5).alias("b_idx"), text.alias("text"), (n * 97 % 842).cast("double").alias("y0"))
    return B.with_reextracted(old, raw, b.where("page_num % 4 = 2")).drop("y0")


@query(f"WITH {POINTS_SQL}, a AS (SELECT DISTINCT url, title, body, gs_category FROM tagged) SELECT url, title FROM a WHERE gs_category = 'GS-3' AND (contains(lower(title), 'er') OR contains(lower(body), 'er'))")
def l8_client_filter(spark, d):
    from ..sources import web

    a = web.articles(table(spark, d, "pages")).where("url IS NOT NULL AND title <> ''").select("url", "title", F.array_join("paragraphs", " ").alias("summary")).where(F.length("summary") >= 100)
    a = a.withColumn("tag", state.tag_by_words(F.concat_ws(" ", "title", "summary"), state.PAPERS, "GS-2"))
    return state.client_filter(a, "GS-3", "ER").select("url", "title").distinct()


@query("SELECT conv_id::VARCHAR AS session_id, role, text AS content, turn AS at FROM conversations WHERE conv_id IS NOT NULL")
def i3_appended_messages(spark, d):
    out = _fresh(spark, "messages")
    m = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), "role", F.col("text").alias("content"), F.col("turn").cast("long").alias("at"))
    for part in (m.where("at % 2 = 0"), m.where("at % 2 = 1"), m.withColumn("session_id", F.lit(""))):
        state.append_messages(part, out)
    return state.messages_of(spark, out)
