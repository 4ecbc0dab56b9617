"""Approximate search: an inverted-file index of vectors in cells, probed in order and rescored exactly.

The cells' centres are fitted by k-means on a bounded sample of the vectors (``SAMPLE`` rows, by a hash of their ids); every vector is
assigned to the cell of its largest dot product. A query looks into the cells nearest to it, and what lies there is scored exactly.
How many cells that are is found on a second sample (``TRIALS`` queries against the fitted sample), as the least number that
reaches the recall asked for there; the exact search, ``vectors.top_k``, stays for whoever needs all.

A cell is packed into blocks, and a cell of many blocks is dealt over several keys (``SPREAD`` blocks each), which its queries
are repeated for, so that no task gets a whole large cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .vectors import best

#: Rows that the centres are fitted on, queries that the number of probes is found with, and cells, at most.
SAMPLE, TRIALS, CELLS = 20_000, 500, 4096
ROUNDS = 12
BLOCK, SPREAD = 1024, 32
#: Above the recall that is asked for, as the sample's recall is an estimate.
MARGIN = 0.02
#: Bytes of queries, for all their probes, that are broadcast.
SMALL = 64 << 20
ROWS = "array<struct<id:bigint,v:array<double>>>"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _sample(df: DataFrame, n: int, salt: int, id_col: str, vector: str, collection: str) -> tuple[np.ndarray, list]:
    """n vectors at most, drawn by a hash of their ids, and their collections."""
    rows = df.where(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(salt), id_col).alias("h"), id_col, F.col(vector).cast("array<double>").alias("v"), F.col(collection).alias("c")).orderBy("h", id_col).limit(n).collect()
    return np.array([r["v"] for r in rows]), [r["c"] for r in rows]


def _fit(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centres of unit length by k-means of directions, begun with spread rows of the sample; empty cells keep their centres."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(ROUNDS):
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        filled = np.bincount(own, minlength=cells) > 0
        centres[filled] = sums[filled]
    return centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)


def _probes(centres: np.ndarray, sample: np.ndarray, collections: list, trials: np.ndarray, k: int, recall: float) -> int:
    """The least number of probes whose recall of the k best of each collection, among the sample, is high enough."""
    own = (sample @ centres.T).argmax(axis=1)
    order = (-(trials @ centres.T)).argsort(axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(len(centres)), order.shape), axis=1)
    score, needed, whose = trials @ sample.T, [], np.array([str(c) for c in collections])
    for c in np.unique(whose):
        rows = np.flatnonzero(whose == c)
        best = rows[(-score[:, rows]).argsort(axis=1)[:, :k]]
        needed.append(np.take_along_axis(rank, own[best], axis=1).ravel())
    at = np.sort(np.concatenate(needed))
    return int(at[min(len(at) - 1, int(np.ceil(min(1.0, recall + MARGIN) * len(at))) - 1)]) + 1


class Index:
    """Centres, probes, and a folder with the packed blocks (cell, slot, collection, vs), a partition for each cell."""

    def __init__(self, spark: SparkSession, path: str):
        model = spark.read.parquet(f"{path}/model").first()  # one row
        self.path, self.probes = path, model["probes"]
        self.centres = np.array(model["centres"])
        self.blocks = spark.read.schema(f"slot bigint, collection bigint, vs {ROWS}, cell int").parquet(f"{path}/blocks")
        self.slots = spark.read.schema("cell int, last bigint").parquet(f"{path}/slots")


def _nearest(df: DataFrame, centres: np.ndarray, n: int, ddl: str) -> DataFrame:
    """df (..., v) with cells, the n nearest of each row's vector; the centres are at most CELLS rows."""
    shared = df.sparkSession.sparkContext.broadcast(centres)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = -(_matrix(batch.column(batch.num_columns - 1)) @ shared.value.T)
            some = np.sort(score.argpartition(n - 1, axis=1)[:, :n], axis=1) if n < score.shape[1] else np.broadcast_to(np.arange(score.shape[1]), score.shape)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, some.size + 1, some.shape[1], dtype=np.int32)), pa.array(some.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "cells"])

    return df.mapInArrow(find, f"{ddl}, cells array<int>")


def build(vectors: DataFrame, path: str, k: int, recall: float = 0.95, cells: int | None = None, id_col: str = "vec_id", vector: str = "embedding", collection: str = "label") -> Index | None:
    """Writes the index of vectors (id, vector, collection) for searches of the k best of each collection.

    Null vectors aren't in it; a null collection is -1. None without vectors.
    """
    spark = vectors.sparkSession
    sample, whose = _sample(vectors, SAMPLE, 1, id_col, vector, collection)
    if not len(sample):
        return None
    centres = _fit(sample, cells or min(CELLS, max(1, int(len(sample) ** 0.5))))
    trials, _ = _sample(vectors, TRIALS, 2, id_col, vector, collection)
    probes = _probes(centres, sample, whose, trials, k, recall)
    spark.createDataFrame([(probes, centres.tolist())], "probes int, centres array<array<double>>").write.mode("overwrite").parquet(f"{path}/model")
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(collection).cast("long"), F.lit(-1)).alias("collection"), F.col(vector).cast("array<double>").alias("v"))
    assigned = _nearest(rows, centres, 1, "id bigint, collection bigint, v array<double>").select(F.get("cells", F.lit(0)).alias("cell"), "collection", "id", "v")
    assigned.write.mode("overwrite").parquet(f"{path}/assigned")
    assigned = spark.read.parquet(f"{path}/assigned")
    sizes = assigned.groupBy("cell", "collection").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    sizes.groupBy("cell").agg(F.max(F.floor((F.col("blocks") - 1) / SPREAD)).alias("last")).write.mode("overwrite").parquet(f"{path}/slots")
    r = assigned.join(sizes, ["cell", "collection"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    packed = r.groupBy("cell", "collection", "block").agg(F.collect_list(F.struct("id", "v")).alias("vs"))
    packed = packed.select("cell", F.floor(F.col("block") / SPREAD).alias("slot"), "collection", "vs")
    packed.repartition("cell", "slot").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/blocks")
    return Index(spark, path)


def search(index: Index, queries: DataFrame, k: int, probes: int | None = None, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, collection, id, score, rank) as ``vectors.top_k`` gives them, of the cells that are probed; scores are exact, equal ones go by id."""
    n, probes = queries.count(), min(probes or index.probes, len(index.centres))
    q = queries.where(F.col(vector).isNotNull()).select(F.col(id_col).cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("v"))
    q = _nearest(q, index.centres, probes, "qid bigint, v array<double>")
    asked = q.select("qid", "v", F.explode("cells").alias("cell")).withColumn("part", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-n // BLOCK)))))
    asked = asked.groupBy("cell", "part").agg(F.collect_list(F.struct(F.col("qid").alias("id"), "v")).alias("qs")).join(F.broadcast(index.slots), "cell")  # a row a cell
    asked = asked.select("cell", "qs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("slot"))
    small = n * probes * index.centres.shape[1] * 8 <= SMALL
    schema = pa.schema([("qid", pa.int64()), ("collection", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def cut(cell) -> tuple[np.ndarray, np.ndarray]:
        return np.asarray(cell.values.field("id")), _matrix(cell.values.field("v"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (ids, m), (qids, qs) = cut(batch.column(1)[i]), cut(batch.column(2)[i])
                s = np.round(qs @ m.T, 6) + 0.0
                at, of = best(s, ids, k)
                whose = np.full(len(at), batch.column(0)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(qids[at]), pa.array(whose), pa.array(ids[of]), pa.array(s[at, of])], schema=schema)

    found = index.blocks.join(F.broadcast(asked) if small else asked, ["cell", "slot"]).select("collection", "vs", "qs").mapInArrow(score, "qid bigint, collection bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("qid", "collection").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(hits, wanted, recall) of a search against the exact one."""
    key = ["qid", "collection", "id"]
    got = exact.select(*key).join(found.select(*key, F.lit(1).alias("hit")), key, "left")
    return got.agg(F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.count("*").alias("wanted")).withColumn("recall", F.col("hits") / F.greatest(F.col("wanted"), F.lit(1)))
