"""The catalogue of documents: detection of scans and missing pages, merges of batches, listings, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scanned(pages: DataFrame, sample: int = 8, least: float = 150.0) -> DataFrame:
    """(doc_id, scanned): whether evenly spaced sample pages have few characters on average. pages: (doc_id, page_num, chars)."""
    w = Window.partitionBy("doc_id")
    p = pages.withColumns({"n": F.row_number().over(w.orderBy("page_num")) - 1, "of": F.count("*").over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("of") / sample))
    p = p.withColumn("step", step).where((F.col("n") >= F.floor(F.col("step") / 2)) & ((F.col("n") - F.floor(F.col("step") / 2)) % F.col("step") == 0))
    p = p.withColumn("k", F.row_number().over(w.orderBy("page_num"))).where(F.col("k") <= sample)
    return p.groupBy("doc_id").agg((F.avg("chars") < least).alias("scanned"))


def weak_pages(pages: DataFrame, counts: DataFrame, least: int = 20, blob: int = 400) -> DataFrame:
    """(doc_id, page_num, why): pages that are missing, low on text, or collapsed into few long blocks. pages: (doc_id, page_num, chars, blocks, longest); counts: (doc_id, pages)."""
    every = counts.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long"))).alias("page_num"))
    j = every.join(pages, ["doc_id", "page_num"], "left")
    why = F.when(F.col("chars").isNull(), "missing").when(F.col("chars") < least, "low").when((F.col("blocks") <= 3) & (F.col("longest") > blob), "collapsed")
    return j.select("doc_id", "page_num", why.alias("why")).where("why IS NOT NULL")


def merge_batches(batches: DataFrame) -> DataFrame:
    """The last batch's version of each page. batches: (doc_id, page_num, batch_no, text)."""
    last = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy(F.desc("batch_no")))
    return batches.withColumn("n", last).where("n = 1").drop("n")


def missing_pages(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, page_num) of the pages that no batch has. counts: (doc_id, pages)."""
    every = counts.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long"))).alias("page_num"))
    return every.join(pages.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_anti")


def fill_pages(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """All pages of each document, those that are missing as blank ones."""
    every = counts.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("pages").cast("long"))).alias("page_num"))
    j = every.join(pages, ["doc_id", "page_num"], "left")
    return j.select("doc_id", "page_num", F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("is_blank"))


def summary(blocks: DataFrame) -> DataFrame:
    """(doc_id, counts of blocks, headings and pages, characters) of the structured output."""
    return blocks.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("type") == "heading").alias("n_headings"), F.count_distinct("page_num").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))


def listing(documents: DataFrame, **equal) -> DataFrame:
    """Documents that match, the newest first."""
    for c, v in equal.items():
        if v is not None:
            documents = documents.where(F.col(c) == v)
    return documents.orderBy(F.desc("created_at"), "id")


def extraction_summary(blocks: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, total_blocks, content_blocks, boilerplate_blocks, corrected_blocks, table_count, image_count, total_ner_entities) from blocks with is_boilerplate, was_corrected and entities, and a row for each table and image."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    b = blocks.groupBy("doc_id").agg(F.count("*").alias("total_blocks"), F.count_if(~flag("is_boilerplate")).alias("content_blocks"), F.count_if(flag("is_boilerplate")).alias("boilerplate_blocks"), F.count_if(flag("was_corrected")).alias("corrected_blocks"), F.sum(F.coalesce(F.size("entities"), F.lit(0))).alias("total_ner_entities"))
    n = lambda df, c: df.groupBy("doc_id").agg(F.count("*").alias(c))
    j = b.join(n(tables, "table_count"), "doc_id", "left").join(n(images, "image_count"), "doc_id", "left")
    return j.fillna(0, ["table_count", "image_count"])


def cascade_delete(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


#: What is told of stores that didn't hold a document's file.
PDF_GONE = ("PDF file not found on disk (path: ", ") — skipped.")
JSON_GONE = {"extracted": "Extracted JSON not found on disk — skipped.", "preprocessed": "Preprocessed JSON not found on disk — skipped."}
STORES = {"pdf": "file_path", "extracted": "extracted_json_path", "preprocessed": "preprocessed_json_path"}


def cascade(documents: DataFrame, vectors: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """What stays in each store, and a report on each document that goes.

    documents: (id, file_path, extracted_json_path, preprocessed_json_path, ...); vectors: (file_id, ...); files: (path, ...); gone: (id). The report: (id, found,
    vectors_deleted, and for each kind of file whether it was deleted, warnings); of documents that aren't there only that they weren't found.
    """
    asked = gone.select("id").distinct()
    going = asked.join(documents.select("id", *STORES.values(), F.lit(True).alias("found")), "id", "left")
    counts = vectors.join(asked.withColumnRenamed("id", "file_id"), "file_id", "left_semi").groupBy(F.col("file_id").alias("id")).agg(F.count("*").alias("vectors_deleted"))
    paths = going.select("id", F.explode(F.create_map(*[x for k, c in STORES.items() for x in (F.lit(k), F.col(c))])).alias("kind", "path")).where("path IS NOT NULL")
    there = paths.join(files.select("path").distinct(), "path")
    held = there.groupBy("id").agg(F.collect_set("kind").alias("kinds"))
    j = going.join(counts, "id", "left").join(held, "id", "left")
    has = lambda k: F.coalesce(F.array_contains("kinds", k), F.lit(False))
    pdf = F.concat(F.lit(PDF_GONE[0]), F.coalesce("file_path", F.lit("None")), F.lit(PDF_GONE[1]))
    told = F.array_compact(F.array(F.when(~has("pdf"), pdf), *[F.when(~has(k), F.lit(t)) for k, t in JSON_GONE.items()]))
    found = F.coalesce("found", F.lit(False))
    report = j.select("id", found.alias("found"), F.coalesce("vectors_deleted", F.lit(0)).cast("long").alias("vectors_deleted"), found.alias("record_deleted"), *[has(k).alias(f"{k}_deleted") for k in STORES], F.when(found, told).otherwise(F.array().cast("array<string>")).alias("warnings"))
    known = going.where("found").select("id")
    kept = {
        "documents": documents.join(asked, "id", "left_anti"),
        "vectors": vectors.join(known.withColumnRenamed("id", "file_id"), "file_id", "left_anti"),
        "files": files.join(paths.select("path").distinct(), "path", "left_anti"),
    }
    return kept, report


def collection_name(name):
    """The collection of a classification; null for names that aren't letters, digits and blanks, or don't begin with a letter."""
    t = F.trim(name)
    return F.when(t.rlike("^[A-Za-z][A-Za-z0-9 ]*$"), F.concat(F.lower(F.replace(t, F.lit(" "), F.lit("_"))), F.lit("_collection")))


def registrable(anchors, least: int = 3):
    """The anchors that aren't blank, trimmed; null if they are too few to register a classification."""
    said = F.filter(F.transform(anchors, lambda a: F.trim(a)), lambda a: a != "")
    return F.when(F.size(said) >= least, said)


def write_chunks(chunks: DataFrame, out: str, key: str = "doc_id") -> None:
    """Chunks as JSON lines, a folder for each document: for as many documents as a folder should have folders."""
    chunks.repartition(key).write.partitionBy(key).mode("overwrite").json(out)


def write_chunk_buckets(chunks: DataFrame, out: str, key: str = "doc_id", buckets: int = 256) -> None:
    """Chunks as JSON lines in buckets of documents, a file for each bucket with a document's chunks side by side: as many folders whatever the number of documents."""
    b = chunks.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))
    b.repartition(buckets, "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").mode("overwrite").json(out)


def read_chunks(spark: SparkSession, out: str, schema: str, of: list | None = None, key: str = "doc_id", buckets: int = 256) -> DataFrame:
    """The chunks of a folder; of some documents, only their buckets are read."""
    c = spark.read.schema(f"{schema}, bucket int").json(out)
    if of is not None:
        places = spark.createDataFrame([(str(x),) for x in of], "k string").select(F.pmod(F.xxhash64("k"), F.lit(buckets)).cast("int").alias("b")).distinct()
        c = c.where(F.col("bucket").isin([r["b"] for r in places.collect()]) & F.col(key).cast("string").isin([str(x) for x in of]))  # as many as are named
    return c.drop("bucket")
