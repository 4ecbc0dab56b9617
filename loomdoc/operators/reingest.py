"""Re-ingest of what has changed: documents whose content differs from the stored one are chunked again, the others aren't touched.

A store is a folder with ``chunks`` and ``catalogue`` (doc_id, fingerprint, n_chunks), both in buckets of document ids. A run replaces the
buckets that hold changed, new or gone documents (dynamic partition overwrite), chunks first: a run that is stopped before the
catalogue is written does its work again. A bucket whose chunks aren't as many as the catalogue says, as a run that died while it was put in place leaves it,
is made anew from its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

BUCKETS = 64
CATALOGUE = "doc_id bigint, fingerprint string, n_chunks bigint, bucket int"


def bucket(doc_id, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(doc_id.cast("long")), F.lit(buckets)).cast("int")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, fingerprint): of all rows of a document, in any order. Rows without an id are left out."""
    h = [F.sum(F.xxhash64(F.lit(seed), text).cast("decimal(38,0)")) for seed in (1, 2)]
    return docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.concat_ws(":", *[x.cast("string") for x in h], F.count("*").cast("string")).alias("fingerprint"))


def _read(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A table of the store, empty before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], schema)


def changes(docs: DataFrame, catalogue: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, change): new, changed, gone or kept, by fingerprint."""
    now = fingerprints(docs, text)
    j = now.alias("n").join(catalogue.select("doc_id", "fingerprint").alias("c"), "doc_id", "full")
    change = F.when(F.col("c.fingerprint").isNull(), "new").when(F.col("n.fingerprint").isNull(), "gone").when(F.col("n.fingerprint") != F.col("c.fingerprint"), "changed").otherwise("kept")
    return j.select("doc_id", F.col("n.fingerprint").alias("fingerprint"), change.alias("change"))


def reingest(docs: DataFrame, out: str, chunker: Callable[[DataFrame], DataFrame], text: str = "text", buckets: int = BUCKETS) -> dict[str, int]:
    """Brings the store up to docs and tells how many documents are new, changed, gone and kept, and how many buckets were written.

    chunker: docs -> (doc_id, ...), the chunks of each document, which depend on that document alone.
    """
    spark = docs.sparkSession
    made = chunker(docs)
    schema = StructType([*made.schema.fields]).add("bucket", IntegerType())
    chunks, catalogue = _read(spark, f"{out}/chunks", schema), _read(spark, f"{out}/catalogue", CATALOGUE)
    there = chunks.where("doc_id IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))
    catalogue = catalogue.where("doc_id IS NOT NULL")
    said = catalogue.groupBy("bucket").agg(F.sum("n_chunks").alias("said"))
    broken = said.join(there, "bucket", "full").where(F.coalesce("n", F.lit(0)) != F.coalesce("said", F.lit(0))).select("bucket", F.lit(True).alias("broken"))
    told = changes(docs, catalogue, text).withColumn("bucket", bucket(F.col("doc_id"), buckets)).join(F.broadcast(broken), "bucket", "left")  # a row a bucket
    told = told.withColumn("change", F.when((F.col("change") == "kept") & F.col("broken"), "changed").otherwise(F.col("change"))).drop("broken")
    folder = f"{out}/runs"
    told.write.mode("overwrite").parquet(folder)
    told = spark.read.schema(told.schema).parquet(folder)
    report = {c: 0 for c in ("new", "changed", "gone", "kept")} | {r["change"]: r["n"] for r in told.groupBy("change").agg(F.count("*").alias("n")).collect()}
    moved = told.where("change <> 'kept'")
    touched = F.broadcast(moved.select("bucket").distinct())  # a row a bucket
    report["buckets"] = moved.select("bucket").distinct().count()
    if not report["buckets"]:
        return report
    fresh = docs.join(moved.where("change <> 'gone'").select("doc_id"), "doc_id", "left_semi")
    old = chunks.where("doc_id IS NOT NULL").join(touched, "bucket", "left_semi").join(moved.select("doc_id"), "doc_id", "left_anti")
    new = old.select(*schema.names).unionByName(chunker(fresh).withColumn("bucket", bucket(F.col("doc_id"), buckets)).select(*schema.names))
    _put(new, touched, f"{out}/chunks", buckets)
    n = spark.read.schema(schema).parquet(f"{out}/chunks").where("doc_id IS NOT NULL").join(touched, "bucket", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    kept = told.join(touched, "bucket", "left_semi").where("change <> 'gone'").join(catalogue.select("doc_id", F.col("fingerprint").alias("old")), "doc_id", "left")
    rows = kept.join(n, "doc_id", "left").select("doc_id", F.coalesce("fingerprint", "old").alias("fingerprint"), F.coalesce("n_chunks", F.lit(0).cast("long")).alias("n_chunks"), "bucket")
    _put(rows, touched, f"{out}/catalogue", buckets)
    return report


def _put(rows: DataFrame, touched: DataFrame, path: str, buckets: int) -> None:
    """The buckets of rows in place of the stored ones; a bucket that has lost all its rows stays as one row without a document, which ``stored`` leaves out."""
    empty = touched.join(rows.select("bucket").distinct(), "bucket", "left_anti").select(*[F.col("bucket") if c == "bucket" else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
    every = rows.unionByName(empty)
    every.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stored(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of a store."""
    return spark.read.parquet(f"{out}/chunks").where("doc_id IS NOT NULL").drop("bucket")
