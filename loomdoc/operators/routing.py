"""Routing questions to collections and putting their context together. Candidates are rows (qid, ..., score); every choice of "first" has an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .classes import each, values


def route(classes: DataFrame, collections: DataFrame, high: float = 0.7, low: float = 0.5) -> DataFrame:
    """(qid, collection, how): one collection for a sure classification, two for a fair one, all of them else. Classes without a collection drop out after the choice."""
    best = F.max("probability").over(Window.partitionBy("qid"))
    how = F.when(best >= high, "single").when(best >= low, "dual").otherwise("all")
    c = classes.withColumn("how", how)
    named = c.where((F.col("how") == "single") & (F.col("rank") <= 1) | (F.col("how") == "dual") & (F.col("rank") <= 2)).join(collections, "label").select("qid", "collection", "how")
    kind = collections.schema["collection"].dataType.simpleString()
    every = c.where("how = 'all' AND rank = 1").select("qid", each(values(collections, "collection"), kind).alias("collection"), "how")
    return named.unionByName(every)


def top_k_of_mode(mode: Column, asked: Column | None = None) -> Column:
    table = F.when(mode == "prelims", 10).otherwise(8)
    return table if asked is None else F.coalesce(asked, table)


def arbitrate(local: DataFrame, web: DataFrame) -> DataFrame:
    """(qid, chosen): local candidates if their best isn't below 0 or the web's isn't strictly better."""
    best = lambda df, n: df.groupBy("qid").agg(F.max("score").alias(n))
    j = best(local, "l").join(best(web, "w"), "qid", "full")
    return j.select("qid", F.when(F.col("l") >= 0, "local").when(F.col("w").isNotNull() & (F.col("l").isNull() | (F.col("w") > F.col("l"))), "web").otherwise("local").alias("chosen"))


def fallback(searched: DataFrame, others: DataFrame) -> DataFrame:
    """(qid, replaced): whether the collections not searched first do strictly better, for questions whose best is below 0."""
    best = lambda df, n: df.groupBy("qid").agg(F.max("score").alias(n))
    j = best(searched, "s").join(best(others, "o"), "qid", "left")
    return j.select("qid", ((F.col("s") < 0) & F.coalesce(F.col("o") > F.col("s"), F.lit(False))).alias("replaced"))


def fallen_back(searched: DataFrame, others: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates that stand, and (qid, how): where a sure or fair route finds nothing good and the other collections do strictly better, theirs replace them and the route says so."""
    j = routes.join(fallback(searched, others), "qid", "left").withColumn("replaced", F.coalesce("replaced", F.lit(False)) & F.col("how").isin("high_confidence", "medium_confidence"))
    r = j.select("qid", F.when(F.col("replaced"), F.concat("how", F.lit("_cross_collection_fallback"))).otherwise(F.col("how")).alias("how"), "replaced")
    gone = r.where("replaced").select("qid")
    return searched.join(gone, "qid", "left_anti").unionByName(others.join(gone, "qid", "left_semi")), r.select("qid", "how")


def news_first(candidates: DataFrame, least: float = 0.4, many: int = 2) -> DataFrame:
    """(qid, source): local news if enough candidates are good, else the web."""
    return candidates.groupBy("qid").agg(F.when(F.count_if(F.col("score") >= least) >= many, "local").otherwise("web").alias("source"))


def siblings(anchors: DataFrame, chunks: DataFrame, radius: int = 1, decay: float = 0.1) -> DataFrame:
    """(qid, file, chunk_no, score, hop, anchor_no): neighbours of the anchors within ``radius`` in their file, scored down by distance.

    The first anchor that reaches a chunk has it, by rank and then offset; anchors themselves don't come again, nor numbers below 1.
    A band join as an equi-join on exploded offsets.
    """
    hops = F.explode(F.filter(F.sequence(F.lit(-radius), F.lit(radius)), lambda h: h != 0))
    a = anchors.withColumn("hop", hops).withColumn("no", F.col("chunk_no") + F.col("hop")).where("no >= 1")
    j = a.join(chunks.select("file", F.col("chunk_no").alias("no")), ["file", "no"])
    j = j.withColumn("n", F.row_number().over(Window.partitionBy("qid", "file", "no").orderBy("rank", "hop"))).where("n = 1")
    j = j.select("qid", "file", F.col("no").alias("chunk_no"), F.round(F.col("score") * F.pow(F.lit(1 - decay), F.abs("hop")), 6).alias("score"), F.col("hop").cast("long").alias("hop"), F.col("chunk_no").alias("anchor_no"))
    return j.join(anchors.select("qid", "file", "chunk_no"), ["qid", "file", "chunk_no"], "left_anti")


def merge_providers(results: DataFrame, trusted: Column) -> DataFrame:
    """The first result of each URL by provider and rank, trusted hosts only. results: (qid, provider, rank, url)."""
    first = F.row_number().over(Window.partitionBy("qid", "url").orderBy("provider", "rank"))
    return results.where(trusted).withColumn("n", first).where("n = 1").drop("n")


def prompt_order(chunks: DataFrame) -> DataFrame:
    """Adds place: by file and the number at the end of the chunk id, ids without one last."""
    no = F.coalesce(F.expr("try_cast(nullif(regexp_extract(chunk_id, '([0-9]+)$', 1), '') as int)"), F.lit(9999))
    return chunks.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("file", no, "chunk_id")).cast("long"))


def context_text(placed: DataFrame) -> DataFrame:
    """(qid, context): the chunks of a question in their places, as one text."""
    said = F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id", "text"))), lambda x: F.concat(F.lit("["), x["chunk_id"], F.lit("] "), x["text"]))
    return placed.groupBy("qid").agg(F.array_join(said, "\n---\n").alias("context"))


def gate(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(qid, gated): no candidates, or the best below 0 (-5 for news)."""
    best = candidates.groupBy("qid").agg(F.max("score").alias("best"))
    j = questions.join(best, "qid", "left")
    return j.select("qid", (F.col("best").isNull() | (F.col("best") < F.when(F.col("mode") == "current_affairs", -5.0).otherwise(0.0))).alias("gated"))


def cited(citations: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(qid, chunk_id, name, preview): citations with the document's name, or the chunk's file if it is unknown, and 150 characters."""
    j = citations.join(chunks, "chunk_id", "left").join(documents, "file_id", "left")
    preview = F.when(F.length("text") > 150, F.concat(F.substring("text", 1, 150), F.lit("..."))).otherwise(F.col("text"))
    return j.select("qid", "chunk_id", F.coalesce("original_filename", "file_id", F.lit("unknown")).alias("name"), preview.alias("preview"))
