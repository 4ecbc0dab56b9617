"""Collections of points as tables in buckets of files, the folder of uploads, and what lies in a folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed columns of a point beside its vector.
POINT = "point_id string, file_id bigint, chunk_id string, classification string, text string, vector array<float>"
BUCKETS = 16


def ensure(spark: SparkSession, names: list[str], where: str, buckets: int = BUCKETS) -> list[str]:
    """Makes the collections that aren't there, empty, in buckets of file_id and in folders below where; gives those that it made."""
    made = [n for n in names if not spark.catalog.tableExists(n)]
    for n in made:
        spark.sql(f"CREATE TABLE IF NOT EXISTS {n} ({POINT}) USING parquet CLUSTERED BY (file_id) INTO {int(buckets)} BUCKETS LOCATION '{where}/{n}'")
    return made


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """stored with new's points in place of those with the same file and point_id.

    The ids of a file's new points are one row, and the join is by file: a stored table in buckets of files is read as it lies.
    """
    ids = new.groupBy("file_id").agg(F.collect_set("point_id").alias("ids"))
    kept = stored.join(ids, "file_id", "left").where(~F.coalesce(F.array_contains("ids", F.col("point_id")), F.lit(False)))
    return kept.select(*stored.columns).unionByName(new.select(*stored.columns))


def removed(stored: DataFrame, gone: DataFrame) -> DataFrame:
    """stored without the points of the files in gone (file_id)."""
    return stored.join(gone.select("file_id").distinct(), "file_id", "left_anti").select(*stored.columns)


def put(df: DataFrame, name: str, where: str, buckets: int = BUCKETS) -> None:
    """Replaces a collection by df, which may read it: the rows are written beside it, in buckets as well, and then the name is given to them.

    Points are dealt by the hash that buckets go by, so that a bucket is one file. The files of what was there before stay until where is cleaned.
    """
    spark, fresh = df.sparkSession, f"{name}__new"
    spark.sql(f"DROP TABLE IF EXISTS {fresh}")
    df.repartition(buckets, "file_id").write.bucketBy(buckets, "file_id").option("path", f"{where}/{name}-{uuid.uuid4().hex}").saveAsTable(fresh, format="parquet")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")


def upload(files: DataFrame, out: str) -> None:
    """Adds files (file_id, classification, content) to the uploads: a partition for each classification in lower case, with the path that each file goes by."""
    folder = F.lower("classification")
    f = files.select("file_id", F.concat(folder, F.lit("/"), F.col("file_id").cast("string"), F.lit(".pdf")).alias("path"), "content", folder.alias("folder"))
    f.write.mode("append").partitionBy("folder").parquet(out)


def uploads(spark: SparkSession, out: str) -> DataFrame:
    """(file_id, path, folder, content) of the uploads; one folder is one partition."""
    return spark.read.parquet(out)


def folder_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, name, modified, length, content) of all files below a folder whose names fit the pattern; content is read only where it is asked for. Spark lists no empty files."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return f.select("path", F.substring_index("path", "/", -1).alias("name"), F.col("modificationTime").alias("modified"), "length", "content")
