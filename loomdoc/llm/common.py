"""What the operators of this subpackage share: word arrays, row keys, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, as regular expression and as plain characters.
WS_CLASS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where all run in one process, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and spark.sparkContext.master.startswith("local"):
        where = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-loomdoc-"))
    if not where:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return where.rstrip("/")


_OWN: dict[str, str] = {}


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: its lineage ends there, and its size is known.

    Unlike a cache it outlives lost executors. The folders of one application lie together, so that they can be dropped when it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomdoc-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """White-space separated words, unchanged; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{WS_CLASS}]+"), "")


def row_key(id_col: Column, text: Column) -> Column:
    """A non-null key of a row that holds for repeated ids with different texts as well."""
    return F.concat_ws("-", id_col.cast("string"), F.hex(F.xxhash64(text)))


def hashed(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def joined_hashes(a: Column, step: int) -> Column:
    """Hashes of runs: element i stands for a[i] followed by a[i + step]; the array gets shorter by step."""
    n = F.size(a) - step
    return F.when(n > 0, F.zip_with(F.slice(a, 1, n), F.slice(a, 1 + step, n), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


#: Rows of keys that a broadcast may hold, and bytes of rows that are not of one width.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS, width: Column | None = None) -> DataFrame:
    """df, to be broadcast if it has so few rows and, by their width, bytes; beyond that Spark joins it as it finds best. df should be a written table."""
    n, size = df.agg(F.count("*"), F.sum(F.lit(0) if width is None else width)).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df
