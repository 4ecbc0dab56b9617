"""Queries of vector search, classification, routing and context. ``embeddings`` are vector points; their label is class and collection; a point's number in its label is its chunk number."""

import uuid

from pyspark.sql import functions as F

from ..operators import routing as R
from ..operators import vector_index
from ..operators import vectors as V
from ..shared import shared_dir
from .registry import query, table

CHUNKS = "chunks AS (SELECT vec_id, embedding, label::BIGINT AS file, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS chunk_no FROM embeddings)"
DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
HITS = f"""hits AS (SELECT a.vec_id AS qid, b.label::BIGINT AS collection, b.vec_id AS id, round({DOT}, 6) AS score,
  row_number() OVER (PARTITION BY a.vec_id, b.label ORDER BY round({DOT}, 6) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 QUALIFY rank <= 15)"""


def _fresh(spark, name):
    """A folder of its own in the shared place."""
    return f"{shared_dir(spark)}/loomdoc-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _points(spark, d):
    return table(spark, d, "embeddings")


def _hits(spark, d):
    p = _points(spark, d)
    return V.top_k(p, p.where("vec_id % 50 = 0"), 15)


@query(f"WITH {HITS} SELECT qid, collection, id, score, rank FROM hits")
def g3_top_k(spark, d):
    return _hits(spark, d)


def _indexed_hits(spark, d):
    p = _points(spark, d)
    index = vector_index.build(p, _fresh(spark, "cells"), 15)
    return vector_index.search(index, p.where("vec_id % 50 = 0"), 15)


@query()
def g3_indexed_top_k(spark, d):
    return _indexed_hits(spark, d).select("qid", "collection", "id", "score", "rank")


@query()
def g3_index_recall(spark, d):
    return vector_index.recall(_indexed_hits(spark, d), _hits(spark, d))


BEST = f"{HITS}, one AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY qid, id ORDER BY collection, rank) = 1), best AS (SELECT qid, collection, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM one QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= 15)"


def _best(spark, d):
    return V.merge_collections(_hits(spark, d), F.col("collection"), ["id"], 15).select("qid", "collection", "id", "score", "rank")


@query(f"WITH {BEST} SELECT * FROM best")
def g4_merged_collections(spark, d):
    return _best(spark, d)


CLASSES = """m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
  n AS (SELECT label, i, x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-9) AS x FROM m),
  q AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS y, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 50 = 0),
  s AS (SELECT vec_id, label, sum(x * y) AS s FROM q JOIN n USING (i) GROUP BY ALL),
  e AS (SELECT *, exp(10 * (s - max(s) OVER (PARTITION BY vec_id))) AS e FROM s),
  p AS (SELECT vec_id AS qid, label, round(e / sum(e) OVER (PARTITION BY vec_id), 4) AS probability FROM e),
  classes AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY probability DESC, label) AS rank FROM p)"""


def _classes(spark, d):
    p = _points(spark, d)
    return V.classify(p.where("vec_id % 50 = 0"), V.centroids(p))


@query(f"WITH {CLASSES} SELECT * FROM classes")
def g5_centroid_classes(spark, d):
    return _classes(spark, d)


ROUTED = f"""{CLASSES}, best AS (SELECT *, max(probability) OVER (PARTITION BY qid) AS top FROM classes), cols AS (SELECT DISTINCT label, label::BIGINT AS collection FROM embeddings WHERE label <> 3),
  routes AS (SELECT qid, collection, CASE WHEN top >= 0.4 THEN 'single' ELSE 'dual' END AS how FROM best JOIN cols USING (label) WHERE (top >= 0.4 AND rank <= 1) OR (top < 0.4 AND top >= 0.2 AND rank <= 2)
  UNION ALL SELECT qid, collection, 'all' FROM best, (SELECT DISTINCT collection FROM cols) WHERE top < 0.2 AND rank = 1)"""


def _routes(spark, d):
    cols = _points(spark, d).where("label <> 3").select("label", F.col("label").cast("long").alias("collection")).distinct()
    return R.route(_classes(spark, d), cols, 0.4, 0.2)


@query(f"WITH {ROUTED} SELECT * FROM routes")
def h1_h2_routes(spark, d):
    return _routes(spark, d)


def _chunks(spark, d):
    return V.numbered(_points(spark, d).select("vec_id", F.col("label").cast("long").alias("file")), "file", "vec_id", "chunk_no").select("vec_id", "file", "chunk_no")


ANCHORS = f"{BEST}, {CHUNKS}, anchors AS (SELECT qid, file, chunk_no, score, rank FROM best JOIN chunks ON id = vec_id WHERE rank <= 5)"
SIBLINGS = f"""{ANCHORS}, a AS (SELECT *, unnest([-2, -1, 1, 2]) AS hop FROM anchors), j AS (SELECT a.qid, a.file, c.chunk_no AS no, a.score, a.hop, a.chunk_no AS anchor_no, a.rank FROM a JOIN chunks c ON c.file = a.file AND c.chunk_no = a.chunk_no + a.hop),
  f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY qid, file, no ORDER BY rank, hop) = 1),
  siblings AS (SELECT qid, file, no AS chunk_no, round(score * pow(0.9, abs(hop)), 6) AS score, hop::BIGINT AS hop, anchor_no FROM f WHERE NOT EXISTS (SELECT 1 FROM anchors x WHERE x.qid = f.qid AND x.file = f.file AND x.chunk_no = f.no))"""


def _anchors(spark, d, best=None, chunks=None):
    return (_best(spark, d) if best is None else best).where("rank <= 5").join((_chunks(spark, d) if chunks is None else chunks).withColumnRenamed("vec_id", "id"), "id").select("qid", "file", "chunk_no", "score", "rank")


@query(f"WITH {SIBLINGS} SELECT * FROM siblings")
def h7_siblings(spark, d):
    return R.siblings(_anchors(spark, d), _chunks(spark, d), 2)


@query(f"""WITH {SIBLINGS}, g AS (SELECT qid, max(score) AS best FROM best GROUP BY qid), w AS (SELECT qid, count(*) AS n_siblings FROM siblings GROUP BY qid), c AS (SELECT qid, label, probability FROM classes WHERE rank = 1)
  SELECT c.qid, c.label, c.probability, coalesce(n_siblings, 0) AS n_siblings, best, best IS NULL OR best < 0 AS gated FROM c LEFT JOIN g USING (qid) LEFT JOIN w USING (qid)""".replace(BEST + ",", BEST + ", " + CLASSES + ",", 1))
def retrieval(spark, d):
    """The flagship: classify, search, merge, expand by neighbours, gate."""
    # used three times: searched once
    where = f"{_fresh(spark, 'retrieval')}/"
    _best(spark, d).write.parquet(f"{where}best")
    _chunks(spark, d).write.parquet(f"{where}chunks")
    top, chunks = spark.read.parquet(f"{where}best"), spark.read.parquet(f"{where}chunks")
    near = R.siblings(_anchors(spark, d, top, chunks), chunks, 2).groupBy("qid").agg(F.count("*").alias("n_siblings"))
    c = _classes(spark, d).where("rank = 1").select("qid", "label", "probability")
    g = top.groupBy("qid").agg(F.max("score").alias("best"))
    asked = _points(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.lit("mains").alias("mode"))
    j = c.join(g, "qid", "left").join(near, "qid", "left").join(R.gate(asked, top), "qid")
    return j.select("qid", "label", "probability", F.coalesce("n_siblings", F.lit(0)).cast("long").alias("n_siblings"), "best", "gated")


W = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''))"


@query("""WITH d AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda t: t <> '') AS ts FROM documents), n AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
  tf AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS t FROM d) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
  q AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda t: t <> ''))) AS t FROM benchmark WHERE item_id % 50 = 0)
  SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN df USING (t) JOIN tf USING (t), n GROUP BY ALL""")
def g10_bm25(spark, d):
    return V.bm25(table(spark, d, "documents"), table(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("qid"), "text"))


CANDIDATES = 50
SEARCHED = f"""d AS (SELECT doc_id, list_filter(string_split(lower(text), ' '), lambda t: t <> '') AS ts FROM documents), n AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
  tf AS (SELECT doc_id, len, t, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS t FROM d) GROUP BY ALL), df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
  q AS (SELECT item_id AS qid, unnest(list_distinct(list_filter(string_split(lower(text), ' '), lambda t: t <> ''))) AS t FROM benchmark),
  found AS (SELECT qid, doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 6) AS score FROM q JOIN df USING (t) JOIN tf USING (t), n GROUP BY ALL),
  cand AS (SELECT qid, id, a.text AS query, b.text, score FROM found JOIN benchmark a ON a.item_id = qid JOIN documents b ON b.doc_id = id QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) <= {CANDIDATES}),
  s AS (SELECT qid, id, round(coalesce(len(list_intersect({W.format('query')}, {W.format('text')})) / nullif(len({W.format('query')}), 0), score), 6) AS rerank_score FROM cand),
  reranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, id) AS rank FROM s QUALIFY rank <= 8)"""


def _few(spark, d):
    return table(spark, d, "benchmark").count() * CANDIDATES <= 100_000


def _searched(spark, d):
    """The reranked hits of every benchmark item in a search over all documents."""
    docs, b = table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    hits = V.bm25_top(docs, b.select("qid", F.col("query").alias("text")), CANDIDATES).select("qid", "id", "score").join(b, "qid")
    c = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(hits) if _few(spark, d) else hits, "id")
    return V.rerank(c, V.overlap_scorer, 8)


@query(f"WITH {SEARCHED} SELECT * FROM reranked")
def g9_rerank(spark, d):
    return _searched(spark, d)


@query(f"WITH {SEARCHED} SELECT * FROM reranked")
def g9_reranked_search(spark, d):
    return _searched(spark, d)


@query()
def g1_hashed_embeddings(spark, d):
    return V.embed(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "embedding")


LOCAL, WEB = "l AS (SELECT user_id AS qid, max(value - 60) AS l FROM events WHERE event_id % 2 = 0 GROUP BY ALL)", "w AS (SELECT user_id AS qid, max(value - 50) AS w FROM events WHERE event_id % 2 = 1 GROUP BY ALL)"


def _scores(spark, d, part, less):
    return table(spark, d, "events").where(f"event_id % 2 = {part}").select(F.col("user_id").alias("qid"), (F.col("value") - less).alias("score"))


@query(f"WITH {LOCAL}, {WEB} SELECT qid, CASE WHEN l >= 0 THEN 'local' WHEN w IS NOT NULL AND (l IS NULL OR w > l) THEN 'web' ELSE 'local' END AS chosen FROM l FULL JOIN w USING (qid)")
def h3_arbitration(spark, d):
    return R.arbitrate(_scores(spark, d, 0, 60), _scores(spark, d, 1, 50))


@query(f"WITH {LOCAL}, {WEB} SELECT qid, l < 0 AND coalesce(w > l, false) AS replaced FROM l LEFT JOIN w USING (qid)")
def h4_fallback(spark, d):
    return R.fallback(_scores(spark, d, 0, 60), _scores(spark, d, 1, 50))


ROUTE = "CASE qid % 3 WHEN 0 THEN 'high_confidence' WHEN 1 THEN 'medium_confidence' ELSE 'all' END"


@query(f"""WITH {LOCAL}, {WEB}, r AS (SELECT qid, {ROUTE} AS how FROM l), f AS (SELECT r.qid, how, l < 0 AND coalesce(w > l, false) AND how <> 'all' AS replaced FROM r JOIN l USING (qid) LEFT JOIN w USING (qid)),
  c AS (SELECT user_id AS qid, 0 AS o, value - 60 AS score FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, 1, value - 50 FROM events WHERE event_id % 2 = 1)
  SELECT f.qid, CASE WHEN replaced THEN how || '_cross_collection_fallback' ELSE how END AS how, count(*) AS n, round(max(score), 6) AS best FROM f JOIN c ON c.qid = f.qid AND c.o = replaced::INT GROUP BY ALL""")
def h4_replaced_candidates(spark, d):
    own, others = _scores(spark, d, 0, 60), _scores(spark, d, 1, 50)
    kept, routes = R.fallen_back(own, others, own.select("qid").distinct().withColumn("how", F.expr(ROUTE)))
    return kept.join(routes, "qid").groupBy("qid", "how").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@query("SELECT user_id AS qid, CASE WHEN count(*) FILTER (WHERE value >= 90) >= 2 THEN 'local' ELSE 'web' END AS source FROM events GROUP BY ALL")
def h5_news_first(spark, d):
    return R.news_first(table(spark, d, "events").select(F.col("user_id").alias("qid"), F.col("value").alias("score")), 90.0)


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_id % 20 WHEN event_type = 'click' THEN 10 ELSE 8 END AS top_k FROM events")
def h6_top_k_of_mode(spark, d):
    mode = F.when(F.col("event_type") == "click", "prelims").otherwise("mains")
    return table(spark, d, "events").select("event_id", R.top_k_of_mode(mode, F.when(F.col("event_id") % 7 == 0, F.col("event_id") % 20)).alias("top_k"))


@query("""WITH r AS (SELECT page_id % 9 AS qid, page_id % 3 AS provider, page_id AS rank, regexp_extract(url, '^[a-z]+://[^/]+/[a-z]+/', 0) AS url FROM pages)
  SELECT * FROM r WHERE contains(url, 'example.net') QUALIFY row_number() OVER (PARTITION BY qid, url ORDER BY provider, rank) = 1""")
def h8_merged_providers(spark, d):
    r = table(spark, d, "pages").select((F.col("page_id") % 9).alias("qid"), (F.col("page_id") % 3).alias("provider"), F.col("page_id").alias("rank"), F.regexp_extract("url", "^[a-z]+://[^/]+/[a-z]+/", 0).alias("url"))
    return R.merge_providers(r, F.contains("url", F.lit("example.net")))


CONTEXTS = f"""WITH {SEARCHED}, c AS (SELECT qid, source AS file, 'chk_' || doc_id AS chunk_id, text, doc_id FROM reranked JOIN documents ON doc_id = id),
  placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY file, doc_id, chunk_id) AS place FROM c)
  SELECT qid, string_agg('[' || chunk_id || '] ' || text, chr(10) || '---' || chr(10) ORDER BY place) AS context FROM placed GROUP BY qid"""


@query(CONTEXTS)
def h10_h11_context(spark, d):
    return h10_h11_question_context(spark, d)


@query(CONTEXTS)
def h10_h11_question_context(spark, d):
    """A context for each question from its reranked hits, whole texts: a group is 8 hits at most."""
    hits = _searched(spark, d).select("qid", F.col("id").alias("doc_id"))
    c = table(spark, d, "documents").join(F.broadcast(hits) if _few(spark, d) else hits, "doc_id").select("qid", F.col("source").alias("file"), F.concat(F.lit("chk_"), F.col("doc_id").cast("string")).alias("chunk_id"), "text")
    return R.context_text(R.prompt_order(c))


@query("""WITH q AS (SELECT DISTINCT user_id AS qid, CASE WHEN user_id % 2 = 0 THEN 'current_affairs' ELSE 'mains' END AS mode FROM events), c AS (SELECT user_id AS qid, max(value - 100) AS best FROM events GROUP BY ALL)
  SELECT qid, best IS NULL OR best < CASE WHEN mode = 'current_affairs' THEN -5.0 ELSE 0.0 END AS gated FROM q LEFT JOIN c USING (qid)""")
def h12_gate(spark, d):
    e = table(spark, d, "events")
    q = e.select(F.col("user_id").alias("qid")).distinct().withColumn("mode", F.when(F.col("qid") % 2 == 0, "current_affairs").otherwise("mains"))
    return R.gate(q, e.select(F.col("user_id").alias("qid"), (F.col("value") - 100).alias("score")))


@query("""WITH cit AS (SELECT conv_id * 100 + turn AS qid, 'chk_' || (conv_id * 3 + turn) AS chunk_id FROM conversations), c AS (SELECT 'chk_' || doc_id AS chunk_id, source AS file_id, text FROM documents), f AS (SELECT DISTINCT source AS file_id, 'File ' || source AS original_filename FROM documents WHERE source <> 'src3')
  SELECT qid, chunk_id, coalesce(original_filename, file_id, 'unknown') AS name, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS preview FROM cit LEFT JOIN c USING (chunk_id) LEFT JOIN f USING (file_id)""")
def h13_citations(spark, d):
    docs = table(spark, d, "documents")
    cit = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("qid"), F.concat(F.lit("chk_"), (F.col("conv_id") * 3 + F.col("turn")).cast("string")).alias("chunk_id"))
    chunks = docs.select(F.concat(F.lit("chk_"), F.col("doc_id").cast("string")).alias("chunk_id"), F.col("source").alias("file_id"), "text")
    return R.cited(cit, chunks, docs.where("source <> 'src3'").select(F.col("source").alias("file_id"), F.concat(F.lit("File "), "source").alias("original_filename")).distinct())


@query("""WITH v AS (SELECT vec_id, label FROM embeddings), n AS (SELECT vec_id, label + 100 AS label, vec_id % 3 AS version FROM v WHERE vec_id % 4 = 0 UNION ALL SELECT vec_id, label + 200, 1 FROM v WHERE vec_id % 8 = 0)
  SELECT vec_id, label, -1::BIGINT AS version FROM v WHERE vec_id % 4 <> 0 UNION ALL SELECT vec_id, label, version FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY version * 1000 + label DESC) = 1""")
def a19_upsert(spark, d):
    v = _points(spark, d).select("vec_id", "label")
    n = v.where("vec_id % 4 = 0").selectExpr("vec_id", "label + 100 AS label", "vec_id % 3 AS version").unionByName(v.where("vec_id % 8 = 0").selectExpr("vec_id", "label + 200 AS label", "1L AS version"))
    n = n.withColumn("version", F.col("version") * 1000 + F.col("label"))
    out = V.upsert(v.withColumn("version", F.lit(-1).cast("long")), n, ["vec_id"])
    return out.withColumn("version", F.when(F.col("version") >= 0, F.floor(F.col("version") / 1000)).otherwise(F.col("version")))


@query("""WITH h AS (SELECT vec_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc:chk_' || vec_id)) AS h FROM embeddings)
  SELECT vec_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || lower(hex((('0x' || h[17:18])::INT & 63) | 128)) || h[19:20] || '-' || h[21:32] AS point_id FROM h""")
def a19_point_ids(spark, d):
    return _points(spark, d).select("vec_id", V.point_id(F.concat(F.lit("doc:chk_"), F.col("vec_id").cast("string"))).alias("point_id"))
