"""Queries of responses, questions, web results and messages. Responses are made of the given texts, in all the forms that parsing knows."""

from pyspark.sql import functions as F

from ..operators import answers as A
from ..operators import quiz
from ..sources.layout import BLOCKS_SQL, blocks
from .registry import query, table

PLAIN = "regexp_replace(text, '[^ -~]', ''{0})"
#: A line as an answer: JSON in a fence, JSON within other text, JSON that broke, plain text.
FORMS = """CASE seq % 4 WHEN 0 THEN '```json' || chr(10) || js || chr(10) || '```' WHEN 1 THEN 'Here you are: ' || js || ' Done.' WHEN 2 THEN '{"answer": "' || replace(t, '"', '\\"') || ' [chk_0' || seq || '] ", "answered": true, "citations": [}' ELSE t || ' see [chk_9], [chk_1]' END"""


def _told(spark, d):
    t = blocks(table(spark, d, "documents")).select("doc_id", "seq", F.regexp_replace("text", "[^ -~]", "").alias("t")).where("trim(t) <> ''")
    js = F.to_json(F.struct(F.col("t").alias("answer"), (F.col("seq") % 3 > 0).alias("answered"), F.array(F.lit("chk_1")).alias("citations")))
    broken = F.concat(F.lit('{"answer": "'), F.replace("t", F.lit('"'), F.lit('\\"')), F.lit(" [chk_0"), F.col("seq").cast("string"), F.lit('] ", "answered": true, "citations": [}'))
    k = F.col("seq") % 4
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), js, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here you are: "), js, F.lit(" Done."))).when(k == 2, broken).otherwise(F.concat("t", F.lit(" see [chk_9], [chk_1]")))
    return t.select("doc_id", "seq", raw.alias("raw"))


@query(f"""WITH {BLOCKS_SQL}, t AS (SELECT doc_id, seq, {PLAIN.format(", 'g'")} AS t FROM blocks), k AS (SELECT * FROM t WHERE trim(t) <> '')
  SELECT doc_id, seq, CASE seq % 4 WHEN 2 THEN trim(t || ' [chk_0' || seq || '] ') WHEN 3 THEN trim(t || ' see [chk_9], [chk_1]') ELSE t END AS answer, CASE WHEN seq % 4 < 2 THEN seq % 3 > 0 ELSE true END AS answered,
    CASE seq % 4 WHEN 2 THEN '[chk_0' || seq || ']' WHEN 3 THEN '[chk_1],[chk_9]' ELSE 'chk_1' END AS citations, seq % 4 + 1 AS tier FROM k WHERE NOT contains(t, '[chk')""")
def a11_parsed_answers(spark, d):
    a = _told(spark, d).select("doc_id", "seq", A.parse_answer(F.col("raw")).alias("a"))
    return a.select("doc_id", "seq", "a.answer", "a.answered", F.array_join("a.citations", ",").alias("citations"), "a.tier")


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT doc_id, page_num, row_number() OVER (PARTITION BY doc_id, page_num ORDER BY seq) - 1 AS "at", CASE seq % 5 WHEN 0 THEN 'HEADING' WHEN 1 THEN 'diagram' WHEN 2 THEN 'odd' WHEN 3 THEN NULL ELSE 'list_item' END AS type,
    CASE WHEN seq % 10 = 1 THEN 'graph TD; ' ELSE '' END || CASE WHEN seq % 7 = 3 THEN '' ELSE text END AS text, seq FROM blocks),
  k AS (SELECT doc_id, page_num, "at", CASE WHEN lower(coalesce(type, 'paragraph')) NOT IN ('heading', 'paragraph', 'list_item', 'diagram') OR (lower(type) = 'diagram' AND NOT (contains(lower(text), 'mermaid') OR contains(text, 'graph '))) THEN 'paragraph' ELSE lower(coalesce(type, 'paragraph')) END AS type,
    regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM b) SELECT doc_id, page_num, "at", type, CASE WHEN type = 'diagram' THEN text ELSE array_to_string(list_filter(list_transform(string_split(text, '/'), lambda w: regexp_replace(replace(w, ' ', ''), '^\\s+|\\s+$', '', 'g')), lambda w: w <> ''), ' ') END AS text FROM k WHERE text <> ''""")
def a10_parsed_blocks(spark, d):
    """Each page of blocks as one response: a list in a fence, or within other text."""
    n = F.col("seq")
    kind = F.when(n % 5 == 0, "HEADING").when(n % 5 == 1, "diagram").when(n % 5 == 2, "odd").when(n % 5 == 4, "list_item")
    text = F.concat(F.when(n % 10 == 1, "graph TD; ").otherwise(""), F.when(n % 7 == 3, "").otherwise(F.col("text")))
    b = blocks(table(spark, d, "documents")).select("doc_id", "page_num", "seq", F.struct(kind.alias("type"), text.alias("text")).alias("b"))
    js = F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("seq", "b"))), lambda x: x["b"]))
    raw = F.when(F.col("page_num") % 2 == 0, F.concat(F.lit("```JSON\n"), js, F.lit("\n```"))).otherwise(F.concat(F.lit("The blocks: "), js, F.lit(" as asked")))
    pages = b.groupBy("doc_id", "page_num").agg(raw.alias("raw")).withColumn("page", F.struct("doc_id", "page_num"))
    return A.parse_blocks(pages, "page", "raw").select("page.doc_id", "page.page_num", "at", "type", "text")


#: A line as a question: in a list, under a name, alone; with two to five options.
@query(f"""WITH {BLOCKS_SQL}, q AS (SELECT doc_id, seq, seq % 4 AS k, 2 + seq % 4 AS n, text FROM blocks WHERE text <> '')
  SELECT doc_id, seq, 0 AS id, CASE WHEN k = 3 THEN text WHEN seq % 5 = 0 THEN 'Question 1' ELSE text END AS question, array_to_string(list_transform(range(1, 5), lambda i: CASE WHEN i <= n THEN 'o' || i ELSE 'Option ' || chr(65 + n::INT) END), '|') AS options, (seq * 3 - 7 + 400) % 4 AS correct,
    'Refer to standard UPSC reference materials.' AS explanation FROM q""")
def l10_parsed_questions(spark, d):
    b = blocks(table(spark, d, "documents")).where("text <> ''").withColumns({"k": F.col("seq") % 4, "n": 2 + F.col("seq") % 4})
    options = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda i: F.concat(F.lit("o"), i.cast("string")))
    asked = F.when((F.col("seq") % 5 != 0) | (F.col("k") == 3), F.col("text"))
    q = F.struct(asked.alias("question"), options.alias("options"), (F.col("seq") * 3 - 7).alias("correct"))
    js = F.when(F.col("k") == 3, F.to_json(q)).when(F.col("k") == 2, F.to_json(F.struct(F.array(q).alias("mcqs")))).when(F.col("k") == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(q).alias("questions"))), F.lit("\n```"))).otherwise(F.to_json(F.array(q)))
    r = b.select(F.struct("doc_id", "seq").alias("key"), js.alias("raw"))
    return A.parse_questions(r, "key", "raw").select("key.doc_id", "key.seq", "id", "question", F.array_join("options", "|").alias("options"), F.col("correct").cast("long").alias("correct"), "explanation")


TOPICS = "CASE seq % 11 WHEN 0 THEN 'Polity and its Source ' WHEN 1 THEN 'a King ' WHEN 2 THEN 'Tax rolls ' WHEN 3 THEN 'Epic ' WHEN 4 THEN 'Svara or accent ' WHEN 5 THEN 'is divided into ' WHEN 6 THEN 'a heap ' WHEN 7 THEN 'Vedic, Epic and Puranic culture ' ELSE '' END"


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT 'chk_' || doc_id || '_' || seq AS chunk_id, doc_id * 1000000 + seq AS seq, {TOPICS} || text AS text FROM blocks),
  q AS (SELECT *, CASE WHEN contains(text, 'Polity') AND contains(text, 'Source') THEN 'What are the primary literary and epigraphic sources for reconstructing Ancient Indian Polity?'
    WHEN contains(text, 'Kingship') OR contains(lower(text), 'king') THEN 'How is the theory of the origin of kingship described in ancient Indian political thought?'
    WHEN contains(text, 'Taxation') OR contains(lower(text), 'tax') THEN 'What was the structure of the taxation system in Ancient and Early Medieval India?'
    WHEN contains(text, 'Epic') OR contains(text, 'Mahabharata') THEN 'How is statecraft and political philosophy depicted in the Indian Epics?'
    WHEN contains(text, 'Svara or accent') OR contains(text, 'Sanskrit language') THEN 'What are the rules regarding Svara and accents in Vaidika Sanskrit?'
    WHEN contains(text, 'Dichotomy of Veda') OR contains(text, 'divided into') THEN 'How are the Vedas divided into Samhita, Brahmana, Aranyaka and Upanishad?'
    WHEN contains(text, 'Vedavy') OR contains(text, 'heap') THEN 'Who organized the initial heap of Vedic texts into structured Vedas?'
    WHEN contains(text, 'Vedic, Epic and Puranic culture') THEN 'Overview of Vedic, Epic and Puranic culture of India' END AS query FROM c)
  SELECT query, arg_min(chunk_id, seq) AS expected_chunk_id FROM q WHERE query IS NOT NULL GROUP BY query""")
def l12_evaluation_set(spark, d):
    b = blocks(table(spark, d, "documents"))
    c = b.select(F.format_string("chk_%d_%d", "doc_id", "seq").alias("chunk_id"), (F.col("doc_id") * 1000000 + F.col("seq")).alias("seq"), F.concat(F.expr(TOPICS), "text").alias("text"))
    return A.evaluation_set(c)


FIXED = ["src3", "history", "src1"]


def _classes(spark, d):
    named = table(spark, d, "documents").select(F.col("source").alias("name"), F.col("doc_id").alias("no")).where("name IS NOT NULL")
    return A.active_classes(FIXED, named)


ACTIVE = """n AS (SELECT source AS label, min(doc_id) AS no FROM documents WHERE source IS NOT NULL AND source NOT IN ('src3', 'history', 'src1') GROUP BY source),
  active AS (SELECT label, row_number() OVER (ORDER BY no, label) + 2 AS place FROM n UNION ALL SELECT * FROM (VALUES ('src3', 0), ('history', 1), ('src1', 2)))"""


@query(f"WITH {ACTIVE} SELECT * FROM active")
def g8_active_classes(spark, d):
    return _classes(spark, d)


@query(f"""WITH {ACTIVE}, q AS (SELECT doc_id AS qid, CASE WHEN doc_id % 3 = 0 THEN 'unheard' ELSE source END AS winner, 0.5 + doc_id % 50 / 100.0 AS confidence FROM documents), k AS (SELECT count(*) AS n FROM active)
  SELECT qid, label, CASE WHEN label = winner THEN confidence ELSE round((1 - confidence) / greatest(n - 1, 1), 4) END::DOUBLE AS score FROM q, active, k WHERE winner IN (SELECT label FROM active)""")
def g6_rebuilt_scores(spark, d):
    q = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.when(F.col("doc_id") % 3 == 0, "unheard").otherwise(F.col("source")).alias("label"), (0.5 + F.col("doc_id") % 50 / 100).alias("confidence"))
    return A.rebuilt_scores(q, _classes(spark, d))


@query(f"WITH {ACTIVE}, k AS (SELECT count(*) AS n FROM active) SELECT item_id AS qid, 'src3' AS classification, label, round(1 / n, 4) AS score FROM benchmark, active, k")
def g7_uniform_scores(spark, d):
    return A.uniform_scores(table(spark, d, "benchmark").select(F.col("item_id").alias("qid")), _classes(spark, d))


@query("""WITH f AS (SELECT page_id // 30 AS qid, 'p' || page_id % 2 AS source, page_id AS "at", CASE WHEN page_id % 7 = 0 THEN ' ' ELSE url END AS url, ' T' || page_id || ' ' AS title, left(html, 40) AS snippet FROM pages)
  SELECT qid, source, row_number() OVER (PARTITION BY qid, source ORDER BY "at") - 1 AS rank, url, trim(title) AS title, trim(snippet) AS snippet FROM f WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY qid, source ORDER BY "at") <= 8""")
def a33_result_rows(spark, d):
    n = F.col("page_id")
    url = F.when(n % 7 == 0, " ").otherwise(F.col("url"))
    f = table(spark, d, "pages").select(F.floor(n / 30).alias("qid"), F.concat(F.lit("p"), (n % 2).cast("string")).alias("source"), n.alias("at"), url.alias("url"), F.format_string(" T%d ", n).alias("title"), F.substring("html", 1, 40).alias("snippet"))
    return A.result_rows(f)


@query()
def h9_web_chunks(spark, d):
    """Ten documents a question, as what its search found; every third one wasn't fetched."""
    n = F.col("doc_id")
    found = table(spark, d, "documents").select(F.floor(n / 10).alias("qid"), (n % 10).alias("rank"), F.format_string("doc/%d", n).alias("url"), F.col("source").alias("title"), F.col("lang").alias("snippet"), F.when(n % 3 != 0, F.col("text")).alias("text"))
    return A.web_chunks(found)


ROUTES = "CASE doc_id % 5 WHEN 0 THEN 'high_confidence' WHEN 1 THEN 'medium_confidence' WHEN 2 THEN 'current_affairs_local' WHEN 3 THEN 'current_affairs_web' ELSE 'all' END"


@query(f"""WITH q AS (SELECT doc_id, {ROUTES} AS r, source AS c, printf('%.1f', doc_id % 1000 / 7.0) AS p, (doc_id % 9)::VARCHAR AS n, (doc_id % 4)::VARCHAR AS m FROM documents WHERE source IS NOT NULL)
  SELECT doc_id, CASE r WHEN 'high_confidence' THEN 'Query routed strictly to ' || c || ' Database (' || p || '% confidence). ' || n || ' candidate chunks retrieved and reranked. Answer backed by ' || m || ' source(s). No other database was searched.'
    WHEN 'medium_confidence' THEN 'Query routed to top-2 databases (History + Anthropology). ' || n || ' candidate chunks merged and reranked. Answer backed by ' || m || ' source(s).'
    WHEN 'current_affairs_local' THEN 'Query answered directly from local Current Affairs Vector Cache (06:00 AM daily digest). ' || n || ' candidates retrieved and reranked. Answer backed by ' || m || ' verified source(s) with <1s latency.'
    WHEN 'current_affairs_web' THEN 'Current Affairs query routed to live parallel web search (trusted sources: a.org, b.org, c.org, d.org...). ' || n || ' web articles scraped and reranked. Answer backed by ' || m || ' source(s).'
    ELSE 'Routing: all | Confidence: ' || p || '% | Candidates: ' || n || ' | Citations: ' || m END
    || CASE WHEN doc_id % 7 = 0 THEN ' [GATED: Low relevance score]' WHEN doc_id % 7 = 1 THEN ' [GATED: too old]' WHEN doc_id % 2 = 0 THEN ' [Result: Insufficient information in knowledge base.]' ELSE ' [Result: Answer successfully generated.]' END AS message FROM q""")
def h14_messages(spark, d):
    n = F.col("doc_id")
    sites = F.array(*[F.lit(f"{x}.org") for x in "abcde"])
    m = A.routing_message(F.expr(ROUTES), F.col("source"), n % 1000 / 7, n % 9, n % 4, sites)
    return table(spark, d, "documents").where("source IS NOT NULL").select("doc_id", A.with_outcome(m, n % 7 < 2, F.when(n % 7 == 1, "too old"), n % 2 == 1).alias("message"))


@query("""WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'mains' WHEN 1 THEN 'prelims' WHEN 2 THEN 'current_affairs' ELSE 'else' END AS mode, CASE doc_id % 5 WHEN 0 THEN 'Mains' WHEN 1 THEN 'mcq' WHEN 2 THEN 'EXPLAIN' WHEN 3 THEN 'summary' ELSE 'other' END AS sub, CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS text FROM documents WHERE text IS NOT NULL),
  a AS (SELECT *, trim(lower(text)) AS t FROM q), k AS (SELECT *, CASE WHEN regexp_matches(t, '\\b(diff|difference|differentiate|compare|comparison|versus|vs|distinguish|distinction|tabular|table)\\b') THEN 'differentiate' WHEN regexp_matches(t, '\\b(summar|summary|brief|briefly|short|shortly|gist|nutshell|key points|takeaway|snapshot|overview)\\b') THEN 'summary'
    WHEN regexp_matches(t, '\\b(in detail|detailed|indetail|critically analyze|critically evaluate|examine|discuss in detail|comprehensive|elaborate|assess|evaluate)\\b') THEN 'indetail' WHEN regexp_matches(t, '\\b(timeline|evolution|chronolog|trace the history|historical development|phases of)\\b') THEN 'timeline'
    WHEN regexp_matches(t, '\\b(explain|what is|how does|what are|describe|concept of|meaning of|define)\\b') THEN 'explain' ELSE 'standard_mains' END AS kind FROM a)
  SELECT doc_id, CASE mode WHEN 'mains' THEN 'mains/' || kind WHEN 'prelims' THEN 'prelims' WHEN 'current_affairs' THEN CASE lower(sub) WHEN 'mains' THEN CASE WHEN text <> '' THEN 'mains/' || kind ELSE 'news/article' END WHEN 'mcq' THEN 'news/mcq' WHEN 'explain' THEN 'news/explain' ELSE 'news/summary' END END AS prompt FROM k""")
def d23_prompts(spark, d):
    from ..functions.text import intent

    n, text = F.col("doc_id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("text"))
    mode = F.when(n % 4 == 0, "mains").when(n % 4 == 1, "prelims").when(n % 4 == 2, "current_affairs").otherwise("else")
    sub = F.when(n % 5 == 0, "Mains").when(n % 5 == 1, "mcq").when(n % 5 == 2, "EXPLAIN").when(n % 5 == 3, "summary").otherwise("other")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", A.prompt_name(mode, sub, text, intent(text)["archetype"]).alias("prompt"))


#: The themes are the operator's own; all else of a question is written out here.
THEMES_SQL = "[" + ", ".join("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in t) + "]" for t in quiz.THEMES) + "]"
QUESTIONS = f"""r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'General Studies' ELSE source END AS subject, CASE WHEN doc_id % 3 = 0 THEN lang WHEN doc_id % 2 = 0 THEN 'file ' || doc_id || '.pdf' WHEN doc_id % 7 = 0 THEN 'General Studies' ELSE source END AS title, (doc_id % 23)::INT AS n_asked,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END, '\\s+', ' ', 'g'), '([.?!]) ', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: length(x) > 35 AND length(x) < 220 AND NOT regexp_matches(lower(x), '^(page|chapter|module|paper|figure|table)\\b')) AS said FROM documents),
  i AS (SELECT *, unnest(range(0, n_asked)) AS i, len(said) AS n FROM r),
  p AS (SELECT doc_id, i, n, subject, title, said[i * 3 % greatest(n, 1) + 1] AS s1, said[(i * 3 + 1) % greatest(n, 1) + 1] AS s2, said[(i * 3 + 2) % greatest(n, 1) + 1] AS s3, list_transform(({THEMES_SQL})[i % 20 + 1], lambda x: replace(x, '{{title}}', title)) AS t FROM i),
  w AS (SELECT *, array_to_string(string_split(s1, ' ')[1:3], ' ') AS w1, array_to_string(string_split(s2, ' ')[1:3], ' ') AS w2, array_to_string(string_split(s3, ' ')[1:3], ' ') AS w3 FROM p),
  q AS (SELECT doc_id, i AS id, CASE WHEN n >= 4 THEN CASE i % 4
      WHEN 0 THEN 'With reference to ' || title || ', consider the following statements:' || chr(10) || '1. ' || s1 || chr(10) || '2. ' || s2 || chr(10) || '3. ' || s3 || chr(10) || chr(10) || 'Which of the statements given above is/are correct?'
      WHEN 1 THEN 'Given below are two statements, one labelled as Assertion (A) and the other as Reason (R) in the context of ' || title || ':' || chr(10) || 'Assertion (A): ' || s1 || chr(10) || 'Reason (R): ' || s2 || chr(10) || chr(10) || 'In the light of the above statements, choose the correct answer from the options given below:'
      WHEN 2 THEN 'Consider the following pairs regarding ' || title || ':' || chr(10) || '1. ' || w1 || ' : ' || left(s1, 90) || '...' || chr(10) || '2. ' || w2 || ' : ' || left(s2, 90) || '...' || chr(10) || '3. ' || w3 || ' : ' || left(s3, 90) || '...' || chr(10) || chr(10) || 'How many of the above pairs is/are correctly matched?'
      ELSE 'With reference to ' || title || ', which one of the following statements best reflects the analytical findings?' END
    ELSE CASE i % 4
      WHEN 0 THEN 'Consider the following statements regarding ' || t[1] || ' in the context of ' || subject || ':' || chr(10) || '1. ' || t[2] || chr(10) || '2. ' || t[3] || chr(10) || '3. ' || t[4] || chr(10) || chr(10) || 'Which of the statements given above is/are correct?'
      WHEN 1 THEN 'Given below are two statements regarding ' || t[1] || ':' || chr(10) || 'Assertion (A): ' || t[2] || chr(10) || 'Reason (R): ' || t[3] || chr(10) || chr(10) || 'In the context of the statements above, which one of the following is correct?'
      WHEN 2 THEN 'Consider the following pairs regarding ' || t[1] || ':' || chr(10) || '1. Statutory Basis : ' || left(t[2], 80) || '...' || chr(10) || '2. Nodal Enforcement : ' || left(t[3], 80) || '...' || chr(10) || '3. Institutional Review : ' || left(t[4], 80) || '...' || chr(10) || chr(10) || 'How many of the above pairs is/are correctly matched?'
      ELSE 'Regarding ' || t[1] || ', which one of the following statements is correct in the context of ' || subject || '?' END END AS question,
    CASE i % 4 WHEN 0 THEN '1 and 2 only|2 and 3 only|1 and 3 only|1, 2, and 3'
      WHEN 1 THEN 'Both (A) and (R) are true and (R) is the correct explanation of (A)|Both (A) and (R) are true but (R) is NOT the correct explanation of (A)|(A) is true but (R) is false|(A) is false but (R) is true'
      WHEN 2 THEN 'Only one pair|Only two pairs|All three pairs|None of the pairs'
      ELSE CASE WHEN n >= 4 THEN left(s1, 125) || CASE WHEN length(s1) > 125 THEN '...' ELSE '' END || '|' || left(s2, 125) || CASE WHEN length(s2) > 125 THEN '...' ELSE '' END || '|The governing statutory framework expressly prohibits any empirical evaluation or audit.|None of the statements are consistent with standard reference parameters.'
        ELSE left(t[2], 125) || CASE WHEN length(t[2]) > 125 THEN '...' ELSE '' END || '|' || left(t[3], 125) || CASE WHEN length(t[3]) > 125 THEN '...' ELSE '' END || '|' || t[1] || ' operates exclusively without reference to standard constitutional safeguards.|None of the above statements are correct.' END END AS options,
    CASE WHEN n >= 4 THEN CASE i % 4 WHEN 0 THEN 'Statements 1 and 2 are directly substantiated by the document: ' || chr(39) || left(s1, 80) || '...' || chr(39) || ' and ' || chr(39) || left(s2, 80) || '...' || chr(39) || '.'
      WHEN 1 THEN 'Based on the analysis of ' || title || ', both Assertion and Reason represent valid propositions grounded in the reference text.' WHEN 2 THEN 'Pairs 1 and 2 are correctly matched with their standard reference definitions from the source text.' ELSE 'The statement ' || chr(39) || left(s1, 90) || '...' || chr(39) || ' represents the verified conceptual principle.' END
    ELSE CASE i % 4 WHEN 0 THEN 'Statements 1 and 3 are correct. Statement 2 contains standard distractor conditions.' WHEN 1 THEN 'Both (A) and (R) reflect established UPSC principles for ' || subject || '.'
      WHEN 2 THEN 'Two pairs are correctly matched according to standard UPSC reference texts.' ELSE 'Statement 1 accurately conveys the core statutory and institutional provisions of ' || t[1] || '.' END END AS explanation, ((i * 2 + 1) % 4)::BIGINT AS correct FROM w)"""


@query(f"WITH {QUESTIONS} SELECT * FROM q")
def l9_fallback_questions(spark, d):
    n = F.col("doc_id")
    r = table(spark, d, "documents").select(
        "doc_id",
        F.when(n % 7 == 0, "").otherwise(F.col("source")).alias("subject"),
        F.when(n % 3 == 0, F.col("lang")).alias("topic"),
        F.when(n % 2 == 0, F.format_string("file %d.pdf", n)).otherwise("").alias("pdf_name"),
        (n % 23).alias("count"),
        F.when(n % 5 == 0, "").otherwise(F.col("text")).alias("content"),
    )
    return quiz.fallback_questions(r, "doc_id").withColumn("options", F.array_join("options", "|"))


@query(f"WITH {QUESTIONS} SELECT id % 4 AS kind, correct, count(*) AS questions, count(DISTINCT doc_id) AS requests FROM q GROUP BY ALL")
def l9_question_kinds(spark, d):
    q = l9_fallback_questions(spark, d)
    return q.groupBy((F.col("id") % 4).alias("kind"), "correct").agg(F.count("*").alias("questions"), F.count_distinct("doc_id").alias("requests"))
