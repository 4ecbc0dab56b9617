"""Queries of memory, caches, news and evaluation. ``conversations`` are chat messages, ``events`` cache traffic and logs, ``pages`` articles."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import state as S
from ..sources import web as W
from ..sources.layout import BLOCKS_SQL, blocks
from .catalogue_queries import PAPERS as PAPERS_SQL
from .ingest_queries import ARTICLES_SQL
from .registry import query, table


def _chat(spark, d):
    content = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), F.to_json(F.struct(F.col("text").alias("answer")))).otherwise(F.col("text"))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("id"), "role", content.alias("content"))


@query("SELECT conv_id AS session_id, turn AS id, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def i1_last_messages(spark, d):
    return S.last_messages(_chat(spark, d), 3).select("session_id", "id", "role")


@query("""WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10)
  SELECT conv_id AS session_id, string_agg(CASE role WHEN 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS history FROM l GROUP BY conv_id
  UNION ALL SELECT DISTINCT conv_id + 1000000000, 'No previous conversation history.' FROM conversations WHERE conv_id % 3 = 0""")
def i2_history(spark, d):
    chat = _chat(spark, d)
    known = chat.select("session_id").distinct()
    return S.history(S.last_messages(chat), known.unionByName(known.where("session_id % 3 = 0").select((F.col("session_id") + 1000000000).alias("session_id"))))


@query("SELECT event_id, sha256(lower(trim(props)) || '|' || event_type || '|' || user_id) AS cache_key FROM events")
def j1_cache_keys(spark, d):
    return table(spark, d, "events").select("event_id", S.cache_key(F.col("props"), F.col("event_type"), F.col("user_id").cast("string")).alias("cache_key"))


def _cache(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").cast("double").alias("created_at"), (F.col("event_id") + F.when(F.col("event_type") == "view", 100).otherwise(3000)).cast("double").alias("expires_at"), (F.col("event_id") % 5 != 0).alias("answered"), (F.col("event_id") % 7 == 0).alias("gated"))


NOW = 7000.0
RAW = "c AS (SELECT user_id::VARCHAR AS cache_key, event_id::DOUBLE AS created_at, (event_id + CASE WHEN event_type = 'view' THEN 100 ELSE 3000 END)::DOUBLE AS expires_at, event_id % 5 <> 0 AS answered, event_id % 7 = 0 AS gated FROM events)"
STORED = f"{RAW}, s AS (SELECT cache_key, created_at, expires_at FROM c WHERE answered AND NOT gated QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY created_at DESC) = 1), stored AS (SELECT * FROM s)"


def _stored(spark, d):
    """A third of the entries was there before."""
    c = _cache(spark, d)
    old = c.where("created_at % 3 = 0 AND answered AND NOT gated").drop("answered", "gated")
    return S.cache_store(old, c.where("created_at % 3 <> 0"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id + 21600.0 WHEN 3 THEN NULL ELSE event_id + 604800.0 END::DOUBLE AS expires_at FROM events")
def j3_expiries(spark, d):
    n = F.col("event_id")
    mode = F.when(n % 4 == 0, "current_affairs").when(n % 4 == 1, "prelims").when(n % 4 == 2, "mains").otherwise("chat")
    return table(spark, d, "events").select("event_id", S.expires(n.cast("double"), mode).alias("expires_at"))


@query(f"WITH {STORED} SELECT * FROM stored")
def j3_stored_entries(spark, d):
    return _stored(spark, d)


@query(f"WITH {STORED}, k AS (SELECT DISTINCT user_id::VARCHAR AS cache_key FROM events WHERE event_id % 2 = 0) SELECT cache_key, created_at, expires_at FROM stored JOIN k USING (cache_key) WHERE expires_at > {NOW}")
def j2_lookups(spark, d):
    keys = table(spark, d, "events").where("event_id % 2 = 0").select(F.col("user_id").cast("string").alias("cache_key")).distinct()
    return S.cache_lookup(_stored(spark, d), keys, NOW)


@query(f"WITH {STORED} SELECT count(*) AS total, count(*) FILTER (WHERE expires_at > {NOW}) AS live, count(*) FILTER (WHERE NOT expires_at > {NOW}) AS expired FROM stored")
def j4_cache_stats(spark, d):
    return S.cache_stats(_stored(spark, d), NOW)


TAG = PAPERS_SQL.replace("contains(t,", "contains(lower(concat_ws(' ', title, summary)),")
ARTICLES = f"a AS (SELECT doc_id AS place, string_split(text, chr(10))[1] AS title, text AS summary, DATE '2024-01-01' + (doc_id % 30)::INT AS date, CASE WHEN doc_id % 3 = 0 THEN 'high' ELSE 'low' END AS priority FROM documents), articles AS (SELECT *, {TAG} AS tag, md5(title || date::VARCHAR)[:12] AS id FROM a)"
TODAY = "DATE '2024-01-28'"


def _articles(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("place"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"), F.expr("date_add(DATE '2024-01-01', cast(doc_id % 30 as int))").alias("date"), F.when(F.col("doc_id") % 3 == 0, "high").otherwise("low").alias("priority"))
    return a.withColumns({"tag": S.tag_by_words(F.concat_ws(" ", "title", "summary"), S.PAPERS, "GS-2"), "id": S.article_id(F.col("title"), F.col("date"))})


@query(f"WITH {ARTICLES} SELECT place, tag, id FROM articles")
def k1_k2_tags(spark, d):
    return _articles(spark, d).select("place", "tag", "id")


@query(f"WITH {ARTICLES}, s AS (SELECT id FROM articles WHERE place % 4 = 0) SELECT id, place, title FROM articles WHERE id NOT IN (SELECT id FROM s) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1")
def k3_new_articles(spark, d):
    a = _articles(spark, d)
    return S.new_articles(a, a.where("place % 4 = 0")).select("id", "place", "title")


@query(f"WITH {ARTICLES} SELECT id, place FROM articles WHERE date >= {TODAY} - 5")
def k5_retention(spark, d):
    return S.retained(_articles(spark, d), F.expr(TODAY), 5).select("id", "place")


@query(f"WITH {ARTICLES} SELECT id, date, row_number() OVER (PARTITION BY date ORDER BY (priority = 'high') DESC, id, articles.place) AS place FROM articles WHERE date >= {TODAY} - 5 AND tag = 'GS-3' AND (contains(lower(title), 'er') OR contains(lower(summary), 'er'))")
def k6_feed(spark, d):
    return S.feed(_articles(spark, d), F.expr(TODAY), 5, "GS-3", "er").select("id", "date", "place")


@query(f"WITH {ARTICLES} SELECT date, tag, count(*) AS n, count(*) FILTER (WHERE priority = 'high') AS important FROM articles GROUP BY ALL")
def k4_k8_day_statistics(spark, d):
    return S.day_statistics(_articles(spark, d))


def _page_articles(spark, d):
    """Articles with a page's whole title and body; tags read both. Pages have no date, so it follows from their number."""
    a = W.body_v1(W.articles(table(spark, d, "pages")))
    a = a.select(F.col("page_id").alias("place"), "title", F.col("body").alias("summary"), F.expr("date_add(DATE '2024-01-01', cast(page_id % 30 as int))").alias("date"), F.when(F.col("page_id") % 3 == 0, "high").otherwise("low").alias("priority"))
    return a.withColumns({"tag": S.tag_by_words(F.concat_ws(" ", "title", "summary"), S.PAPERS, "GS-2"), "id": S.article_id(F.col("title"), F.col("date"))})


#: Articles of pages as the markup of the given pages tells them.
PAGE_TEXT = "trim(regexp_replace(replace(regexp_replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&amp;?', '&', 'g'), '&quot;', '\"'), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g'))"
PAGE_ARTICLES = f"""{ARTICLES_SQL}, b AS (SELECT page_id AS place, title, array_to_string(paragraphs, chr(10)) AS body, {PAGE_TEXT} AS whole FROM articles JOIN plain USING (page_id)),
  s AS (SELECT place, title, CASE WHEN length(body) < 100 THEN whole ELSE body END AS summary, DATE '2024-01-01' + (place % 30)::INT AS date, CASE WHEN place % 3 = 0 THEN 'high' ELSE 'low' END AS priority FROM b), pa AS (SELECT *, {TAG} AS tag, md5(title || date::VARCHAR)[:12] AS id FROM s)"""


@query(f"WITH {PAGE_ARTICLES} SELECT place, tag, id FROM pa")
def k1_k2_page_tags(spark, d):
    return _page_articles(spark, d).select("place", "tag", "id")


@query(f"WITH {PAGE_ARTICLES} SELECT id, place, title FROM pa WHERE id NOT IN (SELECT id FROM pa WHERE place % 4 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1")
def k3_new_page_articles(spark, d):
    a = _page_articles(spark, d).select("place", "title", "id")
    return S.new_articles(a, a.where("place % 4 = 0")).select("id", "place", "title")


@query(f"WITH {PAGE_ARTICLES} SELECT id, place FROM pa WHERE date >= {TODAY} - 5")
def k5_page_retention(spark, d):
    return S.retained(_page_articles(spark, d), F.expr(TODAY), 5).select("id", "place")


@query(f"WITH {PAGE_ARTICLES} SELECT id, date, row_number() OVER (PARTITION BY date ORDER BY (priority = 'high') DESC, id, pa.place) AS place FROM pa WHERE date >= {TODAY} - 5 AND (contains(lower(title), 'er') OR contains(lower(summary), 'er'))")
def k6_page_feed(spark, d):
    return S.feed(_page_articles(spark, d), F.expr(TODAY), 5, None, "er").select("id", "date", "place")


@query(f"WITH {PAGE_ARTICLES} SELECT date, tag, count(*) AS n, count(*) FILTER (WHERE priority = 'high') AS important FROM pa GROUP BY ALL")
def k4_k8_page_day_statistics(spark, d):
    return S.day_statistics(_page_articles(spark, d))


@query(f"WITH {ARTICLES}, d AS (SELECT unnest(range({TODAY} - 7, {TODAY} + 1, INTERVAL 1 DAY))::DATE AS date), n AS (SELECT date FROM articles WHERE id NOT IN (SELECT id FROM articles WHERE place % 4 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1) SELECT date, (SELECT count(*) FROM articles a WHERE a.date = d.date) AS articles, (SELECT count(*) FROM n WHERE n.date = d.date) AS added FROM d")
def k9_backfill_days(spark, d):
    """One run for each of the last days: its articles, and those that are new to the stored ones."""
    return _backfilled(spark, _articles(spark, d))


def _backfilled(spark, articles):
    a = articles.select("place", "id", "date")
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date_sub({TODAY}, 7), {TODAY})")).alias("date"))
    return S.backfilled(a, a.where("place % 4 = 0"), days)


@query("""SELECT user_id AS id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY ALL""")
def a36_latest_status(spark, d):
    return S.latest_status(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), F.col("ts").alias("at"), F.col("event_id").alias("no")))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def a22_null_keeping_updates(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return S.update_with_coalesce(c, c.where("c_custkey % 4 = 0").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "new").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"])


TYPES = "'heading', 'paragraph', 'list_item', 'caption', 'footer', 'header', 'footnote', 'diagram', 'blank_page'"
AUDIT = f"""{BLOCKS_SQL}, audit AS (SELECT doc_id, count(*) > 0 AS has_blocks, bool_and(page_num >= 1) AS pages_valid, count(*) FILTER (WHERE trim(text) = '') = 0 AS no_empty_text, bool_and(type IN ({TYPES})) AS types_valid,
  count(DISTINCT seq) = count(*) AS ids_unique, count(*) FILTER (WHERE type = 'heading') > 0 AS has_headings FROM blocks GROUP BY ALL),
  a AS (SELECT *, ((NOT has_blocks)::INT + (NOT pages_valid)::INT + (NOT no_empty_text)::INT + (NOT types_valid)::INT + (NOT ids_unique)::INT + (NOT has_headings)::INT)::BIGINT AS failed FROM audit),
  cov AS (SELECT doc_id, round(100.0 * count(DISTINCT page_num) FILTER (WHERE seq % 11 <> 3) / (max(page_num) + doc_id % 2), 2) AS coverage FROM blocks GROUP BY doc_id),
  iss AS (SELECT doc_id, count(*) FILTER (WHERE length(text) < 5) AS critical, count(*) FILTER (WHERE length(text) BETWEEN 5 AND 20) AS major, count(*) FILTER (WHERE length(text) > 2000) AS minor FROM blocks GROUP BY doc_id),
  v AS (SELECT doc_id, round(((100 - 0.3::DOUBLE * (100 - coverage) - 2.2::DOUBLE * failed - 15 * critical - 5 * major - 2 * minor)::VARCHAR)::DECIMAL(30, 20), 1)::DOUBLE AS raw, greatest(0.0, least(100.0, raw)) AS score FROM a JOIN cov USING (doc_id) JOIN iss USING (doc_id)),
  scores AS (SELECT *, CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' WHEN score >= 55 THEN 'Fair' ELSE 'Poor' END AS rating FROM v)"""


def _scores(spark, d, audited=None):
    b = blocks(table(spark, d, "documents"))
    expected = b.groupBy("doc_id").agg((F.max("page_num") + F.col("doc_id") % 2).alias("pages"))
    n = F.length("text")
    issues = b.groupBy("doc_id").agg(F.count_if(n < 5).alias("critical"), F.count_if(n.between(5, 20)).alias("major"), F.count_if(n > 2000).alias("minor"))
    return E.score(E.audit(b) if audited is None else audited, E.coverage(b.where("seq % 11 <> 3"), expected), issues)


@query(f"WITH {PAGE_ARTICLES}, d AS (SELECT unnest(range({TODAY} - 7, {TODAY} + 1, INTERVAL 1 DAY))::DATE AS date), n AS (SELECT date FROM pa WHERE id NOT IN (SELECT id FROM pa WHERE place % 4 = 0) QUALIFY row_number() OVER (PARTITION BY id ORDER BY place) = 1) SELECT date, (SELECT count(*) FROM pa a WHERE a.date = d.date) AS articles, (SELECT count(*) FROM n WHERE n.date = d.date) AS added FROM d")
def k9_backfill_page_days(spark, d):
    return _backfilled(spark, _page_articles(spark, d))


def _extracted(spark, d):
    """Documents as extracted JSON. A document's number says what its JSON lacks."""
    n = F.col("doc_id")
    b = blocks(table(spark, d, "documents")).select(n, "seq", F.struct("page_num", "type", "text", F.when(n % 7 != 0, F.col("type") == "footer").alias("is_boilerplate"), F.when(n % 5 != 0, F.array().cast("array<string>")).alias("entities")).alias("b"))
    bs = b.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "b"))), lambda x: x["b"]).alias("bs"))
    meta = F.struct(F.concat(F.lit("doc_"), n.cast("string")).alias("file_name"), F.when(n % 3 != 0, "2024-01-01").alias("extracted_at"))
    tables = F.array(F.struct(F.lit("t1").alias("table_id"), F.when(n % 11 != 0, F.array().cast("array<string>")).alias("rows")))
    text = F.to_json(F.struct(meta.alias("document_metadata"), F.col("bs").alias("text_blocks"), tables.alias("tables")))
    return bs.select("doc_id", F.when(n % 13 == 0, F.concat(text, F.lit("}"))).otherwise(text).alias("json"))


NINE = f"""{BLOCKS_SQL}, nine AS (SELECT doc_id, doc_id % 13 <> 0 AS valid_json, doc_id % 13 <> 0 AND doc_id % 3 <> 0 AS metadata_present, doc_id % 13 <> 0 AS non_empty_blocks, doc_id % 13 <> 0 AS page_numbers_valid, doc_id % 13 <> 0 AS block_types_valid,
  doc_id % 13 <> 0 AND bool_and(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS non_empty_text, doc_id % 13 <> 0 AND doc_id % 7 <> 0 AS boilerplate_tagged, doc_id % 13 <> 0 AND doc_id % 11 <> 0 AS table_structure_valid, doc_id % 13 <> 0 AND doc_id % 5 <> 0 AS ner_populated FROM blocks GROUP BY doc_id)"""


@query(f"WITH {NINE} SELECT *, ({' + '.join(f'(NOT {r})::INT' for r in E.RULES)})::BIGINT AS failed FROM nine")
def l1_nine_rule_audit(spark, d):
    return E.nine_rules(_extracted(spark, d))


#: Scores by the nine rules: coverage, issues and ratings as above.
NINE_SCORES = NINE + f""", n AS (SELECT *, ({' + '.join(f'(NOT {r})::INT' for r in E.RULES)})::BIGINT AS failed FROM nine),
  {AUDIT[AUDIT.index("cov AS"):AUDIT.index("v AS (SELECT doc_id, round")]}{AUDIT[AUDIT.index("v AS (SELECT doc_id, round"):].replace("FROM a JOIN", "FROM n JOIN")}"""


@query(f"WITH {NINE_SCORES} SELECT doc_id, score, rating FROM scores")
def l3_nine_rule_scores(spark, d):
    return _scores(spark, d, E.nine_rules(_extracted(spark, d)))


@query(f"WITH {NINE_SCORES} SELECT doc_id, score, score >= 75 AS ready FROM scores")
def l3_readiness(spark, d):
    return E.readiness(l3_nine_rule_scores(spark, d))


@query(f"WITH {NINE_SCORES} SELECT count(*) AS documents, count(*) FILTER (score >= 75) AS ready, round(avg(score), 4) AS mean_score, min(score) AS least_score FROM scores")
def l3_ready_documents(spark, d):
    return E.ready_documents(l3_nine_rule_scores(spark, d))


@query(f"WITH {NINE} SELECT *, ({' + '.join(f'(NOT {r})::INT' for r in E.RULES)})::BIGINT AS failed FROM nine")
def l1_audit(spark, d):
    return l1_nine_rule_audit(spark, d)


@query(f"WITH {BLOCKS_SQL}, t AS (SELECT doc_id, trim(text) AS t FROM blocks WHERE length(trim(text)) > 40 GROUP BY ALL HAVING count(DISTINCT page_num) > 1) SELECT doc_id, count(*) AS texts FROM t GROUP BY doc_id")
def l2_contamination(spark, d):
    return E.contamination(blocks(table(spark, d, "documents")))


@query(f"WITH {AUDIT} SELECT doc_id, score, rating FROM scores")
def l3_quality_scores(spark, d):
    return _scores(spark, d)


#: Lines cut in two, so that sentences part between blocks; every seventh is boilerplate.
HALVES = f"{BLOCKS_SQL}, h AS (SELECT doc_id, 2 * seq + k AS seq, page_num, CASE WHEN seq % 7 = 3 THEN type ELSE 'paragraph' END AS type, seq % 7 = 5 AS is_boilerplate, CASE k WHEN 0 THEN left(text, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END AS text, seq % 50 = 7 AS bbox_approximate FROM blocks, (SELECT unnest([0, 1]) AS k))"
T = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
L4 = f"""{HALVES}, t AS (SELECT doc_id, seq, {T} AS t, type = 'paragraph' AND NOT is_boilerplate AS body FROM h), p AS (SELECT *, lead(t) OVER w AS nx, lead(body) OVER w AS nb FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY seq)),
  l4 AS (SELECT doc_id, count(*) FILTER (WHERE body AND nb AND t <> '' AND NOT regexp_matches(t, '[.!?:"]$') AND regexp_matches(nx, '^[a-z]')) AS n FROM p GROUP BY doc_id)"""


def _halves(spark, d):
    b = blocks(table(spark, d, "documents")).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    n, half = F.col("seq"), F.floor(F.length("text") / 2).cast("int")
    text = F.when(F.col("k") == 0, F.substring("text", F.lit(1), half)).otherwise(F.substring("text", half + 1, F.length("text")))
    return b.select("doc_id", (2 * n + F.col("k")).alias("seq"), "page_num", F.when(n % 7 == 3, F.col("type")).otherwise("paragraph").alias("type"), (n % 7 == 5).alias("is_boilerplate"), text.alias("text"), (n % 50 == 7).alias("bbox_approximate"))


@query(f"WITH {L4} SELECT doc_id, n FROM l4")
def l4_split_sentences(spark, d):
    return E.split_sentences(_halves(spark, d))


@query(f"""WITH {L4}, c AS (SELECT doc_id, trim(text) AS t FROM h WHERE length(trim(text)) > 40 GROUP BY ALL HAVING count(DISTINCT page_num) > 1), g AS (SELECT doc_id, count(*) AS again FROM c GROUP BY doc_id),
  b AS (SELECT doc_id, count(*) FILTER (contains(text, 'monotheistsant') OR regexp_matches(text, '\\b[A-Z]\\s+ol\\b') OR regexp_matches(text, '\\b[A-Z]\\s+ork\\b')) AS errors, count(*) FILTER (bbox_approximate) AS boxes, count(*) FILTER (NOT is_boilerplate) AS content FROM h GROUP BY doc_id)
  SELECT doc_id, (doc_id % 4 = 1)::INT + (content = 0)::INT AS critical, (errors > 0)::INT + (coalesce(again, 0) > 0)::INT AS major, (n > 0)::INT + (boxes > 0)::INT AS minor FROM b LEFT JOIN g USING (doc_id) JOIN l4 USING (doc_id)""")
def l3_issues(spark, d):
    covered = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 1, 2).otherwise(0).alias("missing"))
    return E.issues(_halves(spark, d), covered)


@query(f"""WITH {BLOCKS_SQL}, f AS (SELECT doc_id, max(page_num) + doc_id % 2 AS pages, count(DISTINCT page_num) FILTER (WHERE page_num % 3 <> 0) AS found, count(DISTINCT page_num) FILTER (WHERE page_num % 3 <> 0 AND page_num <= 1000000) AS had FROM blocks GROUP BY doc_id)
  SELECT doc_id, round(100.0 * found / pages, 2) AS coverage, least(round(100.0 * found / pages, 2), 100.0) AS coverage_capped, pages - had AS missing FROM f""")
def l2_coverage(spark, d):
    b = blocks(table(spark, d, "documents"))
    expected = b.groupBy("doc_id").agg((F.max("page_num") + F.col("doc_id") % 2).alias("pages"))
    return E.coverage(b.where("page_num % 3 <> 0"), expected)


@query(f"WITH {AUDIT} SELECT rating, count(*) AS n, round(avg(score), 4) AS mean_score FROM scores GROUP BY rating")
def l5_roll_up(spark, d):
    return E.roll_up(_scores(spark, d))


RANK = "CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 13 END"
MEAN = "round(avg(CASE WHEN {0} THEN {1} ELSE 0.0 END), 6)"


@query(f"""WITH r AS (SELECT event_type AS model, {RANK} AS rank FROM events) SELECT model, count(*) AS n, {MEAN.format('rank > 0', '1 / nullif(rank, 0)')} AS mrr, {MEAN.format('rank BETWEEN 1 AND 5', '1 / log2(rank + 1)')} AS ndcg_5,
  {MEAN.format('rank BETWEEN 1 AND 1', '1.0')} AS recall_1, {MEAN.format('rank BETWEEN 1 AND 5', '1.0')} AS recall_5, {MEAN.format('rank BETWEEN 1 AND 10', '1.0')} AS recall_10 FROM r GROUP BY model""")
def l6_ranking_metrics(spark, d):
    r = table(spark, d, "events").select(F.col("event_type").alias("model"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("event_id") % 13).alias("rank"))
    return E.ranking_metrics(r, "model")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
  q AS (SELECT l_orderkey AS quiz, l_linenumber AS question, p % 4 AS correct, CASE WHEN s % 5 = 0 THEN NULL WHEN s % 7 = 0 THEN -1 ELSE p % 3 END AS selected FROM l),
  g AS (SELECT quiz, count(*) AS total, count(*) FILTER (WHERE selected >= 0 AND selected = correct) AS correct, count(*) FILTER (WHERE selected IS NULL OR selected < 0) AS unanswered FROM q GROUP BY quiz)
  SELECT *, total - correct - unanswered AS incorrect, round(100.0 * correct / total, 1) AS accuracy, CASE WHEN round(100.0 * correct / total, 1) >= 80 THEN 'strong' WHEN round(100.0 * correct / total, 1) >= 50 THEN 'fair' ELSE 'weak' END AS tier FROM g""")
def l7_quiz_scores(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("quiz"), F.col("l_linenumber").alias("question")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    q = li.select("quiz", "question", (F.col("p") % 4).alias("correct"))
    a = li.where("s % 5 <> 0").select("quiz", "question", F.when(F.col("s") % 7 == 0, -1).otherwise(F.col("p") % 3).alias("selected"))
    return E.quiz_scores(q, a)


@query("SELECT event_type AS stage, user_id % 5 AS mode, count(*) AS n, round(avg(value), 4) AS mean_ms, round(quantile_cont(value, 0.5), 4) AS p50_ms, round(quantile_cont(value, 0.95), 4) AS p95_ms, max(value) AS max_ms FROM events GROUP BY ALL")
def l11_latency(spark, d):
    return E.latency(table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 5).alias("mode"), F.col("value").alias("latency_ms")), ["stage", "mode"])


G = "ln(1.01::DOUBLE / 0.99::DOUBLE)"
SKETCH = f"k AS (SELECT event_type AS stage, user_id % 5 AS mode, CASE WHEN value > 0 THEN ceil(ln(value) / {G})::INT END AS bucket, count(*) AS n, sum(value) AS total, max(value) AS most FROM events WHERE value IS NOT NULL GROUP BY ALL)"


def _sketches(spark, d, *more):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), (F.col("user_id") % 5).alias("mode"), F.col("value").alias("latency_ms"), F.to_date("ts").alias("day"))
    return E.latency_sketch(e, ["stage", "mode", *more])


@query(f"WITH {SKETCH} SELECT stage, mode, bucket, n, round(total, 4) AS total, most FROM k")
def l11_merged_sketches(spark, d):
    """Sketches of days, added up."""
    m = E.merged_sketches(_sketches(spark, d, "day"), ["stage", "mode"])
    return m.withColumn("total", F.round("total", 4))


@query(f"""WITH {SKETCH}, u AS (SELECT *, sum(n) OVER (PARTITION BY stage, mode ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY stage, mode) AS of_all, coalesce(2 * exp(bucket * {G}) / (1 + exp({G})), 0) AS middle FROM k)
  SELECT stage, mode, sum(n)::BIGINT AS n, round(sum(total) / sum(n), 4) AS mean_ms, round(min(middle) FILTER (upto >= ceil(0.5::DOUBLE * of_all)), 4) AS p50_ms, round(min(middle) FILTER (upto >= ceil(0.95::DOUBLE * of_all)), 4) AS p95_ms, max(most) AS max_ms FROM u GROUP BY ALL""")
def l11_sketched_latency(spark, d):
    return E.sketch_latency(E.merged_sketches(_sketches(spark, d, "day"), ["stage", "mode"]), ["stage", "mode"])
