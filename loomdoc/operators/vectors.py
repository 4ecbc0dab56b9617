"""Vectors: embedding stand-ins, exact top-k search in blocks, centroid classification, keyed merges."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shared_dir

BLOCK = 2048


def embed(df: DataFrame, text: str = "text", dims: int = 64) -> DataFrame:
    """df with embedding: the offline stand-in of a model. Words are hashed to dimensions, counted and brought to unit length; zeros for no words.

    Words are hashed in Spark; what goes to the workers is the small number of each word's dimension, which they count.
    """
    slots = F.transform(F.array_remove(F.split(F.lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dims)).cast("byte" if dims <= 128 else "int"))

    @F.arrow_udf("array<double>")
    def unit(slots: pa.Array) -> pa.Array:
        out = np.zeros((len(slots), dims))
        for lo in range(0, len(slots), BLOCK):
            own = slots.slice(lo, BLOCK)
            at = np.repeat(np.arange(len(own)) * dims, pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False))
            counts = np.bincount(at + own.flatten().to_numpy(zero_copy_only=False), minlength=len(own) * dims).reshape(-1, dims)
            norm = np.sqrt((counts * counts).sum(1, dtype=float))[:, None]
            np.divide(counts, norm, out=out[lo : lo + BLOCK], where=norm > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1, dtype=np.int32) * dims), pa.array(out.ravel()))

    return df.withColumn("embedding", unit(slots))


def best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest scores of each row, equal ones by id: all that reach the k-th score, and the least ids among these."""
    n = min(k, score.shape[1])
    least = -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
    row, at = np.nonzero(score >= least)
    order = np.lexsort((ids[at], -score[row, at], row))
    row, at = row[order], at[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < n
    return row[kept], at[kept]


def top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", collection: str = "label", block: int = BLOCK) -> DataFrame:
    """(qid, collection, id, score): each query's k nearest of each collection by dot product, exact; equal scores by id. Scores are rounded to 6 places.

    Vectors and queries are packed into blocks; each pair of blocks is one matrix product that keeps its k best, so what is shuffled is k rows a query and block.
    """
    v = vectors.withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-vectors.count() // block)))))
    left = v.groupBy("part", F.col(collection).alias("collection")).agg(F.collect_list(F.struct(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias("vs")).drop("part")
    n = queries.count()
    q = queries.withColumn("part", F.pmod(F.xxhash64(id_col), F.lit(max(1, -(-n // block)))))
    right = q.groupBy("part").agg(F.collect_list(F.struct(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))).alias("qs"))
    schema = pa.schema([("qid", pa.int64()), ("collection", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def matrix(cell) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(cell.values.field("id"))
        return ids, np.asarray(cell.values.field("v").flatten()).reshape(len(ids), -1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, m = matrix(batch.column(1)[i])
                qids, q = matrix(batch.column(2)[i])
                score = np.round(q @ m.T, 6) + 0.0
                row, at = best(score, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qids[row]), pa.array(np.full(len(row), batch.column(0)[i].as_py())), pa.array(ids[at]), pa.array(score[row, at])], schema=schema)

    # every block meets every query block: the queries are a stated share of the rows, and a pair is one matrix product
    parts = max(1, -(-n // block))
    dealt = left.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    pairs = dealt.join(F.broadcast(right) if n <= 4 * block else right, "part")
    found = pairs.select(F.col("collection").cast("long").alias("collection"), "vs", "qs").mapInArrow(search, "qid bigint, collection bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("qid", "collection").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def merge_collections(hits: DataFrame, order: Column, key: list[str], k: int) -> DataFrame:
    """The k best hits of each query over all collections; a key that several collections return counts once, from the first of them."""
    first = F.row_number().over(Window.partitionBy("qid", *key).orderBy(order, "rank"))
    one = hits.withColumn("n", first).where("n = 1").drop("n", "rank")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), *key)).cast("long")).where(F.col("rank") <= k)


def centroids(anchors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, centre): the mean of each class's vectors, brought back to unit length."""
    m = anchors.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("x"))
    c = m.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x)) + 1e-9
    return c.select(F.col(label).alias("label"), F.transform("c", lambda x: x / norm).alias("centre"))


def classify(queries: DataFrame, centres: DataFrame, temperature: float = 10.0, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(qid, label, probability, rank): softmax over the dot products with the class centres, four places; the classes come as one row, a few hundred at most."""
    one = centres.agg(F.sort_array(F.collect_list(F.struct("label", "centre"))).alias("cs"))
    q = queries.select(F.col(id_col).alias("qid"), F.col(vector).cast("array<double>").alias("v")).join(F.broadcast(one))
    dot = lambda c: F.aggregate(F.zip_with("v", c, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    s = q.select("qid", F.explode(F.transform("cs", lambda c: F.struct(c["label"].alias("label"), dot(c["centre"]).alias("s")))).alias("x")).select("qid", "x.label", "x.s")
    w = Window.partitionBy("qid")
    e = s.withColumn("e", F.exp(temperature * (F.col("s") - F.max("s").over(w))))
    p = e.withColumn("probability", F.round(F.col("e") / F.sum("e").over(w), 4))
    return p.withColumn("rank", F.row_number().over(w.orderBy(F.desc("probability"), "label")).cast("long")).select("qid", "label", "probability", "rank")


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """(qid, id, rerank_score, rank): the k best by a scorer of (query text, text), six places; where it gives null the search score counts."""
    s = F.coalesce(F.round(scorer(F.col("query"), F.col("text")), 6), F.col("score"))
    c = candidates.withColumn("rerank_score", s)
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rerank_score"), "id")).cast("long")).where(F.col("rank") <= k).select("qid", "id", "rerank_score", "rank")


def overlap_scorer(query: Column, text: Column) -> Column:
    """Offline stand-in of a cross-encoder: the share of the query's words that the text holds."""
    ws = lambda c: F.array_distinct(F.array_remove(F.split(F.lower(c), "[^a-z0-9]+"), ""))
    return F.when(F.size(ws(query)) > 0, F.size(F.array_intersect(ws(query), ws(text))) / F.size(ws(query)))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(qid, doc_id, score) for docs (doc_id, text) and queries (qid, text), tokens split at blanks, six places. An extension: scores over the index that the reference only builds."""
    tokens = lambda c: F.array_remove(F.split(F.lower(c), " "), "")
    d = docs.select("doc_id", tokens(F.col("text")).alias("ts"))
    n, mean = d.agg(F.count("*"), F.avg(F.size("ts"))).first()
    tf = d.select("doc_id", F.size("ts").alias("len"), F.explode("ts").alias("t")).groupBy("doc_id", "len", "t").agg(F.count("*").alias("tf"))
    q = queries.select("qid", F.explode(F.array_distinct(tokens(F.col("text")))).alias("t"))
    df = tf.groupBy("t").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(float(mean or 1))))
    return q.join(df, "t").join(tf, "t").groupBy("qid", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_top(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, block: int = 512, most: int = 20_000) -> DataFrame:
    """(qid, id, score, rank): each query's k best of all documents by ``bm25``; equal scores by id.

    The driver holds the terms of ``most`` queries at once. More are searched for in lots, by a hash of their ids, and the hits of a lot are written before the next one.
    """
    lots = -(-queries.count() // most)
    if lots <= 1:
        return _bm25_lot(docs, queries, k, k1, b, block)
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/loomdoc-{spark.sparkContext.applicationId}/bm25-{uuid.uuid4().hex}"
    for lot in range(lots):
        own = queries.where(F.pmod(F.xxhash64(F.col("qid").cast("long")), F.lit(lots)) == lot)
        _bm25_lot(docs, own, k, k1, b, block).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def _bm25_lot(docs: DataFrame, queries: DataFrame, k: int, k1: float, b: float, block: int) -> DataFrame:
    """The search for queries whose terms the driver holds.

    Terms of the queries and their weights go to the workers in blocks of queries; a block of documents meets a block of queries in one matrix product, and a task keeps k rows a query.
    """
    tokens = lambda c: F.array_remove(F.split(F.lower(c), " "), "")
    d = docs.select(F.col("doc_id").cast("long").alias("id"), tokens(F.col("text")).alias("ts"))
    n, mean = d.agg(F.count("*"), F.avg(F.size("ts"))).first()
    asked = queries.select(F.col("qid").cast("long"), F.array_sort(F.array_distinct(tokens(F.col("text")))).alias("ts")).where(F.size("ts") > 0).orderBy("qid").collect()
    every = sorted({t for q in asked for t in q["ts"]})
    terms = docs.sparkSession.createDataFrame([(t,) for t in every], "t string")
    idf = {r["t"]: float(np.log(1 + (n - r["df"] + 0.5) / (r["df"] + 0.5))) for r in d.select(F.explode(F.array_distinct("ts")).alias("t")).join(F.broadcast(terms), "t").groupBy("t").agg(F.count("*").alias("df")).collect()}
    parts = []
    for i in range(0, len(asked), block):
        own = asked[i : i + block]
        place = {t: j for j, t in enumerate(sorted({t for q in own for t in q["ts"] if t in idf}))}
        parts.append(([q["qid"] for q in own], list(place), [(place[t], j, idf[t]) for j, q in enumerate(own) for t in q["ts"] if t in idf]))
    mean = float(mean or 1)
    schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
    none = np.iinfo(np.int64).max

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = []
        for qids, own, cells in parts:
            m = np.zeros((len(own), len(qids)))
            for t, j, x in cells:
                m[t, j] = x
            state.append((pa.array(own, pa.string()), m, np.full((len(qids), k), none), np.zeros((len(qids), k))))
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                ids = batch.column(0).slice(lo, block).to_numpy()
                ts = batch.column(1).slice(lo, block)
                size = pc.fill_null(pc.list_value_length(ts), 0).to_numpy()
                flat, row = ts.flatten(), np.repeat(np.arange(len(ids)), size)
                for s, (own, m, best_ids, best) in enumerate(state):
                    at = pc.fill_null(pc.index_in(flat, value_set=own), -1).to_numpy()
                    hit = at >= 0
                    tf = np.bincount(row[hit] * len(own) + at[hit], minlength=len(ids) * len(own)).reshape(len(ids), len(own))
                    w = tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean)[:, None])
                    score = np.concatenate([best, np.round(w @ m, 6).T], axis=1)
                    whose = np.concatenate([best_ids, np.broadcast_to(ids, (len(best), len(ids)))], axis=1)
                    first = np.lexsort((whose, -score), axis=1)[:, :k]
                    state[s] = (own, m, np.take_along_axis(whose, first, 1), np.take_along_axis(score, first, 1))
        for (qids, _, _), (_, _, best_ids, best) in zip(parts, state, strict=True):
            q, found = np.repeat(np.asarray(qids, np.int64), k), best.ravel() > 0
            yield pa.RecordBatch.from_arrays([pa.array(q[found]), pa.array(best_ids.ravel()[found]), pa.array(best.ravel()[found])], schema=schema)

    found = d.mapInArrow(search, "qid bigint, id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def numbered(df: DataFrame, by: str, order: str, name: str, block: int = 1 << 16) -> DataFrame:
    """df with each row's number, from 1, among those of its ``by``, in the order of a whole number: numbers within blocks of it, and the rows of the blocks before.

    So a group with a third of all rows is dealt over as many tasks as it has blocks.
    """
    b = df.withColumn("__block", F.floor(F.col(order) / block))
    sizes = b.groupBy(by, "__block").agg(F.count("*").alias("__n"))
    ahead = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    sizes = sizes.select(by, "__block", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    within = F.row_number().over(Window.partitionBy(by, "__block").orderBy(order))
    return b.withColumn("__within", within).join(sizes, [by, "__block"]).withColumn(name, (F.col("__within") + F.col("__ahead")).cast("long")).drop("__block", "__within", "__ahead")


def upsert(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """stored with new's rows in place of those with the same key; of new's own duplicates the largest ``version`` wins."""
    last = new.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("version")))).where("n = 1").drop("n")
    return stored.join(new.select(*key).distinct(), key, "left_anti").unionByName(last)


def point_id(name: Column, namespace: str = "6ba7b8109dad11d180b400c04fd430c8") -> Column:
    """A version-5 UUID, by default in the namespace of domain names: SHA-1 of namespace and name with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80))), -2, 2)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))
