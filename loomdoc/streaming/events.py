"""Streaming extensions (the reference has none): latency windows, expiring de-duplication of articles. Sources are file streams of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    """A file stream over one table of a folder; ts becomes a timestamp, as watermarks ask for."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def latency_windows(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Count and mean value of each kind of event in tumbling windows."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: list[str], late: str = "60 days") -> DataFrame:
    """Each key once, as long as its state lives."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def run_once(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Works off what is there into Parquet files."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
