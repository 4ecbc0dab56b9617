"""Token ids as compressed binary files for short-document access (operator 5).

Documents are put in ascending id order by ranges, encoded, and packed into shards of about ``SHARD_IDS`` ids. Each
document is its own zstandard frame over its little-endian id array, compressed with one dictionary that is trained on
the id arrays of a bounded sample (``SAMPLE_DOCS`` documents, their first ``SAMPLE_CHARS`` characters; for the
dictionary alone: every document is encoded whole). A shard holds the dictionary's SHA-256, an index of (doc id, frame
offset, ids) and the frames; any document is read with one index lookup and one frame (``read_some``). Shards are rows of a Parquet
table, so they go wherever Spark writes, and lost tasks are simply written again.

Encoding a text is encoding its space-separated pieces one after the other: the tokenizer drops white space and never
joins across it, so pieces are encoded once per batch and gathered by index.

Defined cases: null text is empty, and every document gets the end id; documents with a null id come first; repeated
ids are separate documents, in no fixed order among themselves; an empty table writes no shards and reads no rows;
further columns are not written.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written
from .hashing import byte_offsets

SHARD_IDS = 1 << 20
SAMPLE_DOCS = 1000
SAMPLE_CHARS = 8192
DICT_BYTES = 64 << 10
LEVEL = 3
#: Text encoded at once.
BYTES_AT_ONCE = 8 << 20
#: Pieces that a worker remembers.
CACHE = 1_000_000
SHARD_SCHEMA = "first_id bigint, seq bigint, n_docs bigint, n_ids bigint, dict_sha256 string, width int, ids_index binary, offset_index binary, count_index binary, frames binary"


class Encoder:
    """Ids of whole texts; pieces between spaces are encoded once and remembered, the first CACHE of them for as long as the worker lives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.known = pa.array([], pa.large_string())
        self.begin, self.ids, self.used = np.zeros(1 << 12, np.int64), np.empty(1 << 14, np.uint32), 0

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and where each piece's begin (one more than pieces): many in one text, told apart by their offsets."""
        ids, counts = [], []
        for i in range(0, len(pieces), 20_000):
            some = [pieces[j : j + 50] for j in range(i, min(i + 20_000, len(pieces)), 50)]
            for part, e in zip(some, self.tok.encode_batch([" ".join(p) for p in some], add_special_tokens=False), strict=True):
                ends = np.cumsum([len(x) + 1 for x in part])
                at = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.offsets))
                counts.append(np.bincount(np.searchsorted(ends, at, "right"), minlength=len(part)))
                ids.append(np.array(e.ids, np.uint32))
        if not pieces:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def _remember(self, pieces: pa.Array, ids: np.ndarray, at: np.ndarray) -> None:
        n = len(self.known)
        while len(self.begin) < n + len(pieces) + 1:
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        while len(self.ids) < self.used + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[n + 1 : n + 1 + len(pieces)] = self.used + at[1:]
        self.known = pa.concat_arrays([self.known, pieces])
        self.used += len(ids)

    def __call__(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (one more than texts)."""
        lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        pieces = lists.flatten().dictionary_encode()
        which, names = np.asarray(pieces.indices), pieces.dictionary
        where = np.asarray(pc.fill_null(pc.index_in(names, value_set=self.known), -1)).astype(np.int64)
        out = np.flatnonzero(where < 0)
        fresh = names.take(pa.array(out))
        new = fresh.to_pylist()
        more, at = self._encoded(new)
        if len(new) <= CACHE - len(self.known):
            where[out] = len(self.known) + np.arange(len(new))
            self._remember(fresh, more, at)
            new = []
        begin, end = self.begin[where], self.begin[where + 1]
        ids = self.ids[: self.used]
        if new:  # beyond what is remembered
            begin[out], end[out] = self.used + at[:-1], self.used + at[1:]
            ids = np.concatenate([ids, more])
        size = end - begin
        n = size[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = ids[np.repeat(begin[which] - (ends - n), n) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        if end_id is not None:
            ids = np.insert(ids, bounds[1:], end_id)
            bounds = bounds + np.arange(len(bounds))
        return ids, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _codec(trained: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(trained) if trained else None


def _trained(docs: DataFrame, id_col: str, text: str, path: str, end_id: int | None) -> bytes:
    """The dictionary; empty if the sample is too small to train one."""
    some = docs.select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i")).orderBy("h", "i").limit(SAMPLE_DOCS).select("i").distinct()
    rows = docs.join(F.broadcast(some), docs[id_col].eqNullSafe(some["i"])).select(F.substring(F.col(text), 1, SAMPLE_CHARS).alias("t")).limit(SAMPLE_DOCS).collect()  # noqa: E501  bounded by the two parameters
    if not rows:
        return b""
    enc = encoder(path)
    ids, at = enc(pa.array([r["t"] for r in rows], pa.string()), end_id)
    dtype = f"<u{enc.width}"
    try:
        return zstandard.train_dictionary(DICT_BYTES, [ids[a:b].astype(dtype).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_ids(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text: str = "text") -> None:
    """Writes out/dictionary and out/shards."""
    spark = docs.sparkSession
    trained = _trained(docs, id_col, text, tokenizer, end_id)
    sha = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(sha, bytearray(trained))], "dict_sha256 string, bytes binary").write.parquet(f"{out}/dictionary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        z, dtype = zstandard.ZstdCompressor(level=LEVEL, dict_data=_codec(trained), write_content_size=True), f"<u{enc.width}"
        ids_of, counts, frames, total, seq = [], [], [], 0, 0
        schema = pa.schema([("first_id", pa.int64()), ("seq", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("dict_sha256", pa.string()), ("width", pa.int32()), ("ids_index", pa.binary()), ("offset_index", pa.binary()), ("count_index", pa.binary()), ("frames", pa.binary())])

        def shard() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)]).astype("<u8")
            named = pa.array(ids_of, pa.int64())
            row = [ids_of[0], seq, len(ids_of), total, sha, enc.width, _packed_ids(named), offsets.tobytes(), np.array(counts, "<u4").tobytes(), b"".join(frames)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for i, j in _slices(batch.column(1)):
                part = batch.slice(i, j - i)
                ids, at = enc(part.column(1), end_id)
                for name, a, b in zip(part.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids_of.append(name)
                    counts.append(b - a)
                    frames.append(z.compress(ids[a:b].astype(dtype).tobytes()))
                    total += b - a
                    if total >= SHARD_IDS:
                        yield shard()
                        ids_of, counts, frames, total, seq = [], [], [], 0, seq + 1
        if ids_of:
            yield shard()

    ordered = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("t")).repartitionByRange("i").sortWithinPartitions("i")
    ordered.mapInArrow(pack, SHARD_SCHEMA).write.parquet(f"{out}/shards")


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(begin, end) of rows to be encoded at once: the more, the fewer pieces are looked up again; one text may be longer than BYTES_AT_ONCE."""
    off, at = byte_offsets(texts)[0], 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + BYTES_AT_ONCE, "right")) - 1)
        yield at, min(to, len(texts))
        at = min(to, len(texts))


def _packed_ids(named: pa.Array) -> bytes:
    """Doc ids as a validity byte and eight bytes each."""
    return np.asarray(named.is_valid()).astype("u1").tobytes() + np.asarray(named.fill_null(0)).astype("<i8").tobytes()


def _bases(shards: DataFrame) -> DataFrame:
    """(f, s, base): the ids before each shard, by sums of ranges of shards and sums within a range."""
    ranged = shards.select(F.col("first_id").alias("f"), F.col("seq").alias("s"), "n_ids").repartitionByRange("f", "s")
    ranged = written(ranged.withColumn("range", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = ranged.groupBy("range").agg(F.sum("n_ids").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    within = Window.partitionBy("range").orderBy("f", "s").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    return inside.join(F.broadcast(totals.select("range", "before")), "range").select("f", "s", (F.col("before") + F.col("inside")).alias("base"))


def read_some(spark: SparkSession, out: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents whose ids are in wanted: the index tells the shards, and only their own frames are decompressed.

    Every document of a repeated id is returned; ids that aren't there, and null, give no row.
    """
    shards = spark.read.parquet(f"{out}/shards")
    trained = bytes(spark.read.parquet(f"{out}/dictionary").first()["bytes"])  # at most DICT_BYTES
    index_schema = pa.schema([("first_id", pa.int64()), ("seq", pa.int64()), ("place", pa.int32()), ("doc_id", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids_index"]) // 9
                valid, names = np.frombuffer(row["ids_index"][:n], "u1") == 0, np.frombuffer(row["ids_index"][n:], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([row["first_id"]] * n, pa.int64()), pa.array([row["seq"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), pa.array(names, mask=valid)], schema=index_schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor(dict_data=_codec(trained))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != hashlib.sha256(trained).hexdigest():
                    raise ValueError("the shard was written with another dictionary")
                off = np.frombuffer(row["offset_index"], "<u8").tolist()
                n = len(off) - 1
                names = np.frombuffer(row["ids_index"][n:], "<i8")
                got = [np.frombuffer(z.decompress(row["frames"][off[i] : off[i + 1]]), f"<u{row['width']}").astype(np.int64) if off[i + 1] > off[i] else [] for i in row["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(names[row["places"]]), pa.array(got, schema.field("ids").type)], schema=schema)

    places = shards.select("first_id", "seq", "ids_index").mapInArrow(index, "first_id bigint, seq bigint, place int, doc_id bigint")
    ids = wanted.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    at = places.join(ids, "doc_id").groupBy(F.col("first_id").alias("f"), F.col("seq").alias("s")).agg(F.sort_array(F.collect_list("place")).alias("places"))
    need = shards.join(at, shards["first_id"].eqNullSafe(at["f"]) & (shards["seq"] == at["s"])).select("places", "dict_sha256", "width", "ids_index", "offset_index", "frames")
    return need.mapInArrow(unpack, "doc_id bigint, ids array<bigint>")


def read_ids(spark: SparkSession, out: str, digest_only: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document, from the files; start: ids of all documents before it."""
    shards = spark.read.parquet(f"{out}/shards")
    trained = bytes(spark.read.parquet(f"{out}/dictionary").first()["bytes"])  # at most DICT_BYTES
    sha = hashlib.sha256(trained).hexdigest()
    starts = _bases(shards)
    whole = shards.join(starts, shards["first_id"].eqNullSafe(starts["f"]) & (shards["seq"] == starts["s"])).select("base", "dict_sha256", "width", "ids_index", "offset_index", "count_index", "frames")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), *([] if digest_only else [("ids", pa.list_(pa.int64()))])])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor(dict_data=_codec(trained))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError("the shard was written with another dictionary")
                counts, off = np.frombuffer(row["count_index"], "<u4").astype(np.int64), np.frombuffer(row["offset_index"], "<u8").tolist()
                n = len(counts)
                valid, names = np.frombuffer(row["ids_index"][:n], "u1") == 0, np.frombuffer(row["ids_index"][n:], "<i8")
                ids = [np.frombuffer(z.decompress(row["frames"][a:b]) if b > a else b"", f"<u{row['width']}").astype("<u4") for a, b in zip(off[:-1], off[1:], strict=True)]
                if any(len(x) != c for x, c in zip(ids, counts.tolist(), strict=True)):
                    raise ValueError("a frame does not hold what its index says")
                cols = [pa.array(names, mask=valid), pa.array(row["base"] + np.cumsum(counts) - counts), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                for i in range(0, n, 500):
                    yield pa.RecordBatch.from_arrays([c.slice(i, 500) for c in cols] + ([] if digest_only else [pa.array([x.astype(np.int64) for x in ids[i : i + 500]], pa.list_(pa.int64()))]), schema=schema)

    return whole.mapInArrow(unpack, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ("" if digest_only else ", ids array<bigint>"))
