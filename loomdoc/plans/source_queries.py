"""Queries of the sources and the catalogue."""

from pyspark.sql import functions as F

from ..functions.text import simple_page
from ..operators import state as S
from ..sources import catalogue as C
from ..sources import web as W
from ..sources.layout import BLOCKS_SQL, blocks, pages_of
from .registry import query, table

PAGES = f"{BLOCKS_SQL}, pages_ AS (SELECT doc_id, page_num, sum(length(text)) AS chars, count(*) AS blocks, max(length(text)) AS longest FROM blocks GROUP BY ALL)"


def _blocks(spark, d):
    return blocks(table(spark, d, "documents"))


def _pages(spark, d):
    return _blocks(spark, d).groupBy("doc_id", "page_num").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("blocks"), F.max(F.length("text")).alias("longest"))


@query(f"""WITH {PAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS n, greatest(1, count(*) OVER (PARTITION BY doc_id) // 8) AS step FROM pages_),
  s AS (SELECT * FROM n WHERE n >= step // 2 AND (n - step // 2) % step = 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_num) <= 8) SELECT doc_id, avg(chars) < 150 AS scanned FROM s GROUP BY doc_id""")
def a2_scanned_documents(spark, d):
    return C.scanned(_pages(spark, d))


@query(f"""WITH {PAGES}, e AS (SELECT doc_id, unnest(range(1, max(page_num) + 2)) AS page_num FROM pages_ GROUP BY doc_id)
  SELECT doc_id, page_num, why FROM (SELECT e.doc_id, e.page_num, CASE WHEN chars IS NULL THEN 'missing' WHEN chars < 20 THEN 'low' WHEN blocks <= 3 AND longest > 400 THEN 'collapsed' END AS why FROM e LEFT JOIN pages_ USING (doc_id, page_num)) WHERE why IS NOT NULL""")
def a6_weak_pages(spark, d):
    p = _pages(spark, d)
    return C.weak_pages(p, p.groupBy("doc_id").agg((F.max("page_num") + 1).alias("pages")))


@query("""SELECT doc_id, text FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\\n+', chr(10), 'g'), ' +', ' ', 'g') AS text FROM documents) WHERE length(text) > 50""")
def a8_simple_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", simple_page(F.col("text")).alias("text")).where("text IS NOT NULL")


TEXTS = f"{BLOCKS_SQL}, t AS (SELECT doc_id, page_num, string_agg(text, ' ' ORDER BY seq) AS text FROM blocks GROUP BY ALL)"


@query(f"""WITH {TEXTS}, e AS (SELECT doc_id, unnest(range(1, max(page_num) + 1)) AS page_num FROM t GROUP BY doc_id), k AS (SELECT * FROM t WHERE page_num % 3 <> 2)
  SELECT doc_id, page_num, coalesce(text, '') AS text, text IS NULL AS is_blank FROM e LEFT JOIN k USING (doc_id, page_num)""")
def a12_filled_pages(spark, d):
    p = pages_of(_blocks(spark, d))
    return C.fill_pages(p.where("page_num % 3 <> 2"), p.groupBy("doc_id").agg(F.max("page_num").alias("pages")))


@query(f"""WITH {TEXTS}, b AS (SELECT doc_id, page_num, 1 AS batch_no, text FROM t UNION ALL SELECT doc_id, page_num, 2, 'again ' || text FROM t WHERE page_num % 2 = 0)
  SELECT doc_id, page_num, text FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, page_num ORDER BY batch_no DESC) = 1""")
def a14_merged_batches(spark, d):
    p = pages_of(_blocks(spark, d)).withColumn("batch_no", F.lit(1))
    again = p.where("page_num % 2 = 0").withColumns({"batch_no": F.lit(2), "text": F.concat(F.lit("again "), "text")})
    return C.merge_batches(p.unionByName(again)).select("doc_id", "page_num", "text")


@query(f"""WITH {TEXTS}, e AS (SELECT doc_id, unnest(range(1, max(page_num) + 2)) AS page_num FROM t GROUP BY doc_id) SELECT doc_id, page_num FROM e ANTI JOIN (SELECT * FROM t WHERE page_num % 3 <> 2) USING (doc_id, page_num)""")
def a14_missing_pages(spark, d):
    p = pages_of(_blocks(spark, d))
    return C.missing_pages(p.where("page_num % 3 <> 2"), p.groupBy("doc_id").agg((F.max("page_num") + 1).alias("pages")))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, count(*) AS n_blocks, count(*) FILTER (WHERE type = 'heading') AS n_headings, count(DISTINCT page_num) AS n_pages, sum(length(text))::BIGINT AS n_chars FROM blocks GROUP BY doc_id")
def a15_summaries(spark, d):
    return C.summary(_blocks(spark, d))


@query("SELECT doc_id AS id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def a25_cascade_delete(spark, d):
    return C.cascade_delete(table(spark, d, "documents"), table(spark, d, "labels").where("quality = 0"), "doc_id").select(F.col("doc_id").alias("id"), "source")


@query("SELECT DISTINCT p_type AS name, CASE WHEN regexp_matches(trim(p_type), '^[A-Za-z][A-Za-z0-9 ]*$') THEN lower(replace(p_type, ' ', '_')) || '_collection' END AS collection FROM part")
def a26_collection_names(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("name"), C.collection_name(F.col("p_type")).alias("collection")).distinct()


@query("""WITH a AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS said FROM documents) SELECT doc_id, CASE WHEN len(said) >= 3 THEN array_to_string(said, '|') END AS anchors FROM a""")
def a26_anchors(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(C.registrable(F.split("text", "\n")), "|").alias("anchors"))


@query("SELECT doc_id AS id, source, lang, doc_id % 97 AS created_at FROM documents WHERE source = 'src1' AND lang = 'en'")
def a23_listing(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "source", "lang", (F.col("doc_id") % 97).alias("created_at"))
    return C.listing(docs, source="src1", lang="en", status=None)


@query(f"""WITH {BLOCKS_SQL}, b AS (SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (type <> 'footer') AS content_blocks, count(*) FILTER (type = 'footer') AS boilerplate_blocks, count(*) FILTER (seq % 3 = 0) AS corrected_blocks, sum(seq % 4)::BIGINT AS total_ner_entities FROM blocks GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS table_count FROM blocks WHERE contains(text, '|') GROUP BY doc_id), i AS (SELECT doc_id, max(page_num) AS image_count FROM blocks GROUP BY doc_id)
  SELECT b.*, coalesce(table_count, 0) AS table_count, coalesce(image_count, 0) AS image_count FROM b LEFT JOIN t USING (doc_id) LEFT JOIN i USING (doc_id)""")
def a15_extraction_summaries(spark, d):
    b = _blocks(spark, d)
    marks = b.withColumns({"is_boilerplate": F.col("type") == "footer", "was_corrected": F.col("seq") % 3 == 0, "entities": F.array_repeat(F.lit("e"), (F.col("seq") % 4).cast("int"))})
    return C.extraction_summary(marks, b.where(F.contains("text", F.lit("|"))), b.select("doc_id", "page_num").distinct())


@query("SELECT conv_id, turn, replace(left(text, 80), chr(10), ' ') AS query, round(length(text) / 7.0, 2) AS latency_ms FROM conversations")
def a28_log_rows(spark, d):
    return S.log_rows(table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("query"), (F.length("text") / 7.0).alias("latency_ms")))


@query()
def a29_article_bodies(spark, d):
    return W.body_v1(W.articles(table(spark, d, "pages")))


@query()
def a30_article_bodies_with_titles(spark, d):
    return W.body_v2(W.articles(table(spark, d, "pages")))


@query()
def a31_filtered_article_bodies(spark, d):
    return W.body_v3(W.articles(table(spark, d, "pages")))


@query()
def a31_whole_article_bodies(spark, d):
    return W.body_v4(W.articles(table(spark, d, "pages")))


@query()
def a32_links(spark, d):
    return W.links(table(spark, d, "pages"))
