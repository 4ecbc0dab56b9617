"""Blocks with a page layout from plain texts: the shape in which extracted documents reach the block operators.

Every line is a block. Five lines are a page; types and boxes follow from a line's number and length by integer
arithmetic, so that a layout exists wherever only text does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINES_A_PAGE = 5

#: The same blocks in SQL, as a common table expression over ``documents``.
BLOCKS_SQL = """
blocks AS (
  SELECT doc_id, seq, seq // 5 + 1 AS page_num, text,
         CASE WHEN seq % 5 = 0 AND length(text) < 80 THEN 'heading'
              WHEN seq % 5 = 4 AND length(text) < 60 THEN 'footer'
              WHEN length(text) < 25 THEN 'caption' ELSE 'paragraph' END AS type,
         CASE WHEN seq % 2 = 0 THEN 50.0 ELSE 320.0 END::DOUBLE AS x0, (20 * (seq % 30))::DOUBLE AS y0,
         CASE WHEN seq % 7 = 0 THEN 560.0 WHEN seq % 2 = 0 THEN 290.0 ELSE 560.0 END::DOUBLE AS x1, (20 * (seq % 30) + 12 + length(text) // 40)::DOUBLE AS y1
  FROM (SELECT doc_id, unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::BIGINT AS seq
        FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)))"""


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, page_num, text, type, x0, y0, x1, y1); a null text has no blocks."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "text")).withColumn("seq", F.col("seq").cast("long"))
    n = F.length("text")
    kind = F.when((F.col("seq") % 5 == 0) & (n < 80), "heading").when((F.col("seq") % 5 == 4) & (n < 60), "footer").when(n < 25, "caption").otherwise("paragraph")
    even = F.col("seq") % 2 == 0
    y0 = (20 * (F.col("seq") % 30)).cast("double")
    return lines.select("doc_id", "seq", (F.floor(F.col("seq") / LINES_A_PAGE) + 1).alias("page_num"), "text", kind.alias("type"), F.when(even, 50.0).otherwise(320.0).alias("x0"), y0.alias("y0"), F.when(F.col("seq") % 7 == 0, 560.0).when(even, 290.0).otherwise(560.0).alias("x1"), (y0 + 12 + F.floor(n / 40)).cast("double").alias("y1"))


def pages_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, text): the text of each page, blocks in order."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    return blocks.groupBy("doc_id", "page_num").agg(F.array_join(ordered, " ").alias("text"))
