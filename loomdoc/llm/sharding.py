"""Sharding by a permutation-filled lookup table (operator 8; DataFrame functions only).

Every shard has a preference order over the slots of a prime-sized table: offset, offset + skip, ... modulo the
prime, from hashes of its name. Shards take turns claiming their next free slot until the table is full; shares
differ by one slot at most, and removing a shard moves little else. The table has ``slots`` rows whatever the data,
so it is broadcast, and a row is placed by one hash and one lookup.

Defined cases: a null id is placed as the empty string; repeated ids meet in one shard; an empty table gives an empty
result; columns ``slot`` and ``shard`` of the input are replaced, all others pass through.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARDS = 32
SLOTS = 4099


def fill_table(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot."""
    if shards < 1 or slots < shards or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime and no less than shards")
    h = lambda salt, i: int(hashlib.md5(f"{salt}-{i}".encode()).hexdigest()[:8], 16)
    at = [h("offset", i) % slots for i in range(shards)]
    skip = [h("skip", i) % (slots - 1) + 1 for i in range(shards)]
    table = [-1] * slots
    for turn in range(slots):
        i = turn % shards
        while table[at[i]] >= 0:
            at[i] = (at[i] + skip[i]) % slots
        table[at[i]] = i
    return table


def lookup(spark: SparkSession, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard): the filled table, ``slots`` rows."""
    return spark.range(1).select(F.posexplode(F.split(F.lit(",".join(map(str, fill_table(shards, slots)))), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """df with columns slot and shard (int)."""
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    out = [*[c for c in df.columns if c not in ("slot", "shard")], "slot", "shard"]
    return placed.join(F.broadcast(lookup(df.sparkSession, shards, slots)), "slot", "left").select(*out)


def write_shards(df: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """One folder for each shard; a shard's rows come from many tasks, so none gathers a whole shard."""
    df.write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)
