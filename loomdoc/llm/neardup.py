"""Near-duplicate documents by improved consistent weighted sampling (operator 1).

A text is a weighted set of its runs of five words: weight = tf * idf, idf = 1 + log(N / df) / log(RARE), between 1 and 2, where df is the
number of documents that hold the run. The counts cover all documents. They come from a count sketch of fixed size
(``cws.DEPTH`` rows of 2 ** ``cws.WIDTH_BITS`` counters, merged by counter block), as exact ones would need a shuffle of every run of the corpus:
a run in less than N / RARE documents counts as one in N / RARE, which is where the sketch's own noise lies at any size of the corpus.

``BANDS * ROWS`` samples of each set agree with the probability of the weighted Jaccard similarity. Documents that agree in all
samples of a band share a bucket. The member with the largest buckets leads a bucket, and each other member is verified against it with its exact
weighted Jaccard similarity: as many comparisons as members. A bucket whose members are then of one class is done. Of the others, one with at most
``SMALL`` members has each of its pairs of different classes verified. Of a larger one the ``LEADERS`` members most like the rest meet the others and leave it; what is left is split by
further samples, several times over (``trees``), and each part is worked on in the same way and split again, until no bucket with two classes is left or a split joins next to nothing (``WORTH``). A pair of similarity s stays together in a split by one sample with probability s;
the number of trees grows with the bucket to the power of 0.4, so that a pair at 0.8 meets in one of them with a probability of some 0.95 where the other
pairs of the bucket lie at some 0.57, and comparisons grow as the bucket to the power of 1.4. Pairs of larger buckets are held against one bit of each of ``POOL``
samples first and verified only if these agree as often as four standard deviations below the threshold.
Splits only join what they find, cheaply; what they may have missed is found exactly (``between_classes``): of the texts whose larger buckets still hold two classes, all pairs of
different classes that can reach the threshold by the weights of the runs that they share are verified, so that no link of a bucket is lost, however large it is.
Classes are the connected components of the verified links, by alternating large and small stars over the leaders.

Defined cases: exact copies, of any length, are one class; texts of fewer than five words are one run;
null and wordless texts are in no group, each its own class; repeated rows are copies; a null id is larger than all
others, and class_id is null only if all its ids are; an empty table gives an empty result; further columns are ignored
by ``classes`` and pass through ``deduplicate``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import cws
from .common import if_small, row_key, written
from .hashing import U, scrambled

THRESHOLD = 0.8
BANDS, ROWS = 10, 3
RARE = 1024
#: A bucket of so many members is worked off pair by pair; a larger one, and each part of it, has so many leaders.
SMALL = LEADERS = 8
#: Samples by which larger buckets are split, and how many of them make the first split, a further one, and how many further ones there are.
POOL, STEPS = 256, (6, 4, 8, 16, 32)
#: Splits go on while one joins so many classes for each of its buckets; each is some forty jobs, whose traces the driver holds, and the exact pass finds what is left.
WORTH = 0.01
#: Members verified against one copy of their leader's text; buckets above HOT rows are joined by broadcast.
GROUP, HOT = 256, 1000
#: Rows of keys, of 100 bytes at most, that are broadcast.
KEYS = 300_000

PAIR = pa.schema([("lead", pa.binary()), ("node", pa.binary()), ("sim", pa.float64())])


def shingle_weights(texts: DataFrame) -> np.ndarray:
    """The idf of each counter of the sketch, (DEPTH, width). texts: (t)."""
    width, piece = 1 << cws.WIDTH_BITS, 1 << 12
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size, docs = np.zeros((cws.DEPTH, width), np.int64), [], 0, 0

        def count() -> None:
            for d in range(cws.DEPTH):
                counts[d] += np.bincount(cws.slots(np.concatenate(held), d), minlength=width)

        for batch in batches:
            for at, to in cws.slices(batch.column(0)):
                row, s, _ = cws.shingles(batch.column(0).slice(at, to - at))
                docs += len(np.unique(row))
                held.append(s)
                size += len(s)
                if size >= 1 << 19:
                    count()
                    held, size = [], 0
        if size:
            count()
        if docs:
            blocks = counts.reshape(-1, piece)
            rows = [(-1, np.array([docs]).tobytes()), *((i, b.tobytes()) for i, b in enumerate(blocks))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(b, np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([b.tobytes() for b in sums.values()], pa.binary())], schema=schema)

    t = texts.mapInArrow(tally, "block int, counts binary").repartition("block").mapInArrow(merged, "block int, counts binary").toArrow()
    blocks = {i: np.frombuffer(b, np.int64) for i, b in zip(t.column("block").to_pylist(), t.column("counts").to_pylist(), strict=True)}
    if not blocks:
        return np.full((cws.DEPTH, width), 2, np.float32)
    total = int(blocks.pop(-1)[0])
    counts = np.concatenate([blocks[i] for i in range(len(blocks))]).reshape(cws.DEPTH, width).astype(np.float64)
    others = counts.sum(axis=1, keepdims=True) / width  # what a counter holds of other runs, on average
    df = np.clip(counts - np.floor(others), max(1, total / RARE), total)
    return (1 + np.log(total / df) / math.log(RARE)).astype(np.float32)


def _sets(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, weight)."""
    row, s, times = cws.shingles(texts)
    return row, s, cws.weights(s, times, idf)


def _bands(d: DataFrame, idf: Broadcast) -> DataFrame:
    """(key, id, node, bands) for d: (key, id, node, t); bands is null for a text without words."""
    schema = pa.schema([("key", pa.string()), ("id", pa.int64()), ("node", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = cws.Sampler(BANDS * ROWS)
        for big in batches:
            for at, to in cws.slices(big.column(3)):
                batch = big.slice(at, to - at)
                row, s, w = _sets(batch.column(3), idf.value)
                out = [None] * batch.num_rows
                if len(row):
                    ids, begin = np.unique(row, return_index=True)
                    got = sample(s, w, begin)
                    b = np.zeros((len(ids), BANDS), U) + np.arange(1, BANDS + 1, dtype=U)
                    for k in range(ROWS):
                        b = scrambled(b * cws.GOLDEN + got[:, k::ROWS])
                    for r, x in zip(ids.tolist(), b.view(np.int64), strict=True):
                        out[r] = x
                yield pa.RecordBatch.from_arrays([*(batch.column(k).cast(f.type) for k, f in zip(range(3), schema, strict=False)), pa.array(out, schema.field("bands").type)], schema=schema)

    return d.mapInArrow(find, "key string, id bigint, node binary, bands array<bigint>")


def _pools(texts: DataFrame, idf: Broadcast) -> DataFrame:
    """(node, names, bits): POOL samples of each text, and the lowest bit of each in 64-bit integers. texts: (node, t)."""
    schema = pa.schema([("node", pa.binary()), ("names", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = cws.Sampler(POOL)
        for big in batches:
            for at, to in cws.slices(big.column(1)):
                batch = big.slice(at, to - at)
                row, s, w = _sets(batch.column(1), idf.value)
                got = sample(s, w, np.unique(row, return_index=True)[1]).astype(np.uint32)
                bits = np.packbits((got & 1).astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(list(got.view(np.int32)), schema.field("names").type), pa.array(list(bits), schema.field("bits").type)], schema=schema)

    return texts.mapInArrow(find, "node binary, names array<int>, bits array<bigint>")


def met(left: DataFrame, right: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """left joined to right, a written table with one row for each key and the number n of left's rows with it.

    No task gathers a hot key: a small right side is broadcast, beyond that at least its hot keys are. rows: those of right, where they are known.
    """
    if (right.count() if rows is None else rows) <= KEYS:
        return left.join(F.broadcast(right), key)
    hot = right.where(F.col("n") > HOT)
    if hot.count() > KEYS:
        return left.join(right, key)  # hot keys everywhere: Spark splits partitions that are too large
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.where(F.col("n") <= HOT), key)
    return left.join(F.broadcast(hot), key).unionByName(cold)


#: Brings the texts of (lead, salt, role, node) rows: -> (lead, salt, role, t, node).
Fetch = Callable[[DataFrame], DataFrame]


def verified(pairs: DataFrame, fetch: Fetch, idf: Broadcast) -> DataFrame:
    """(lead, node, sim): the exact weighted Jaccard similarity of each pair; pairs: (lead, node), a written table.

    A text leaves its place once for each leader it meets, a leader's once for GROUP of its members; they meet sorted, leader first.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lead, held, total = None, None, None, 0.0
        for big in batches:
            for begin, to in cws.slices(big.column(4)):
                batch = big.slice(begin, to - begin)
                group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
                role = batch.column(2).to_pylist()
                row, s, w = _sets(batch.column(4), idf.value)
                cut = np.searchsorted(row, np.arange(batch.num_rows + 1))
                sums = np.concatenate([[0.0], np.cumsum(w, dtype=np.float64)])
                out = []
                i = 0
                while i < batch.num_rows:
                    if role[i] == 0:
                        at, (lead, held) = group[i], (s[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]])
                        total = float(held.sum(dtype=np.float64))
                        i += 1
                        continue
                    j = i
                    while j < batch.num_rows and role[j] == 1 and group[j] == at:
                        j += 1
                    q, x = s[cut[i] : cut[j]], w[cut[i] : cut[j]]
                    where = np.minimum(np.searchsorted(lead, q), len(lead) - 1)
                    both = np.where(lead[where] == q, np.minimum(held[where], x), 0)
                    both = np.bincount(row[cut[i] : cut[j]] - i, both, j - i)
                    own = sums[cut[i + 1 : j + 1]] - sums[cut[i:j]]
                    out += zip([at[0]] * (j - i), batch.column(3).slice(i, j - i).to_pylist(), (both / np.maximum(total + own - both, 1e-12)).tolist(), strict=True)
                    i = j
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PAIR, strict=True)], schema=PAIR)

    n = pairs.groupBy("lead").agg(F.count("*").alias("n"))
    leaders = written(n.select("lead", F.ceil(F.col("n") / GROUP).cast("int").alias("parts")), "leaders")
    salted = pairs.join(if_small(leaders.where("parts > 1"), KEYS), "lead", "left").select("lead", F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0)).cast("int").alias("salt"), F.lit(1).alias("role"), "node")
    heads = leaders.select("lead", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("lead").alias("node"))
    rows = fetch(written(salted.unionByName(heads), "meetings")).select("lead", "salt", "role", "node", "t")
    return rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "role").mapInArrow(compare, "lead binary, node binary, sim double")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the connected components of links (a, b); root is the least node."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = met(both, written(least, "least"), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(small, "small")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def rooted(links: DataFrame) -> DataFrame:
    """(node, root) of the links (lead, node): the components of the leaders alone, as every node has one."""
    ends = links.select("lead", "node").unionByName(links.select("lead", F.col("lead").alias("node")).distinct())
    first = written(ends.groupBy("node").agg(F.min("lead").alias("first"), F.collect_set("lead").alias("all")), "first")  # a node has as many leaders as bands, at most
    edges = first.where(F.size("all") > 1).select(F.col("first").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()
    edges = written(edges, "leader_links")
    if edges.isEmpty():
        return first.select("node", F.col("first").alias("root"))
    comp = written(components(edges), "leader_roots").select(F.col("node").alias("first"), "root")
    return first.join(if_small(comp, KEYS), "first", "left").select("node", F.coalesce("root", "first").alias("root"))


def _mixed(rows: DataFrame, key: str) -> DataFrame:
    """(key, n, lead) of the buckets that hold two classes or more. rows: (key, node, c, root)."""
    found = rows.groupBy(key).agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max(F.struct("c", "node")).alias("x")).where("lo <> hi")
    return written(found.select(key, "n", F.col("x.node").alias("lead")), "mixed")


def trees(n: Column) -> Column:
    """How many times a bucket of n members is split; a pair at 0.8 shares five of ten bands."""
    return F.greatest(F.lit(1), F.round(0.6 * F.pow(n / LEADERS, F.lit(0.4)))).cast("int")


def _small_pairs(rows: DataFrame, key: str) -> DataFrame:
    """(lead, node) of different classes in buckets of at most SMALL members."""
    one = rows.select(key, F.col("node").alias("lead"), F.col("root").alias("lead_root"))
    return rows.join(one, key).where((F.col("node") > F.col("lead")) & (F.col("root") != F.col("lead_root"))).select("lead", "node")


def _same(a: Column, b: Column) -> Column:
    """In how many bits two texts agree."""
    return sum((F.bit_count(F.bitwise_not(a[i].bitwiseXOR(b[i]))) for i in range(POOL // 64)), F.lit(0))


def _likely(threshold: float) -> Column:
    """Whether two texts may reach the threshold: their samples agree in the lowest bit with probability p = (1 + similarity) / 2."""
    p = (1 + threshold) / 2
    return _same(F.col("bits"), F.col("lead_bits")) >= POOL * p - 4 * math.sqrt(POOL * p * (1 - p))


def links_of(signed: DataFrame, fetch: Fetch, idf: Broadcast, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of the texts that are linked to another one. signed: (node, bands) of different texts."""
    enough = threshold - 1e-12
    b = signed.select("node", F.explode("bands").alias("band"))
    big = written(b.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "big")
    # whoever is in large buckets leads: a text that many others are variants of
    ranked = written(met(b, big, "band").groupBy("node").agg(F.sum("n").alias("c"), F.collect_list("band").alias("bands")), "ranked")
    cur = ranked.select(F.explode("bands").alias("band"), "node", "c")
    leads = cur.groupBy("band").agg(F.max(F.struct("c", "node")).alias("x"), F.count("*").alias("n"))
    leads = written(leads.select("band", "n", F.col("x.node").alias("lead")), "leads")
    pairs = written(met(cur, leads, "band").where("node <> lead").select("lead", "node").distinct(), "pairs")
    known = written(verified(pairs, fetch, idf).distinct(), "verified")
    comp = written(rooted(known.where(F.col("sim") >= enough)), "roots")

    left = ranked.join(comp, "node", "left").select(F.explode("bands").alias("band"), "node", "c", F.coalesce("root", "node").alias("root"))
    mixed = _mixed(left, "band")
    left = written(met(left, mixed, "band").where("n > 2 AND node <> lead").select("band", "n", "node", "c", "root"), "left")
    few, many = left.where(F.col("n") <= SMALL), left.where(F.col("n") > SMALL)
    more = [written(verified(written(unknown(_small_pairs(few, "band"), known), "few_pairs"), fetch, idf).distinct(), "few_tested")]
    if not many.isEmpty():
        alone = many.select("node").distinct().select(F.col("node").alias("lead"), F.lit(0).alias("salt"), F.lit(0).alias("role"), "node")
        texts = written(fetch(written(alone, "alone")).select("node", "t").dropDuplicates(["node"]), "texts")
        more += split_up(many, known, texts, idf, threshold)
        known = reduce(DataFrame.unionByName, more, known)
    comp = joined_up(comp, more, enough)
    if many.isEmpty():
        return comp
    now = many.select("band", "node", "c").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = written(met(now, _mixed(now, "band").select("band", "n"), "band").select("node", "root").distinct(), "still")
    if still.isEmpty():
        return comp
    return joined_up(comp, [between_classes(still, known, texts, fetch_from(texts), idf, threshold)], enough)


def joined_up(comp: DataFrame, tested: list[DataFrame], enough: float) -> DataFrame:
    """comp (node, root) and the links among tested (lead, node, sim), between its classes or others: (node, root) of both."""
    extra = reduce(DataFrame.unionByName, tested).where(F.col("sim") >= enough)
    root = comp.withColumnRenamed("root", "r")  # components of the roots alone
    over = extra.join(root.withColumnRenamed("node", "lead"), "lead", "left").select(F.coalesce("r", "lead").alias("a"), "node").join(root, "node", "left").select("a", F.coalesce("r", "node").alias("b")).where("a <> b").distinct()
    over = written(over, "over")
    if over.isEmpty():
        return comp
    again = written(components(over), "again").select(F.col("node").alias("old"), F.col("root").alias("new"))
    lone = again.select(F.col("old").alias("node"), F.col("new").alias("root")).join(comp.select("node"), "node", "left_anti")
    return written(comp.join(if_small(again, KEYS), F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")).unionByName(lone), "joined_up")


def unknown(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """pairs (lead, node, ...), each once, but for those that known has either way round."""
    either = known.select("lead", "node").unionByName(known.select(F.col("node").alias("lead"), F.col("lead").alias("node")))
    return pairs.distinct().join(either, ["lead", "node"], "left_anti")


def fetch_from(texts: DataFrame) -> Fetch:
    """Brings texts from (node, t)."""
    return lambda wanted: wanted.join(texts, "node")


def _weighted(texts: DataFrame, idf: Broadcast) -> DataFrame:
    """(node, root, s, w, total): each run of each text with its weight and that of the whole text. texts: (node, root, t)."""
    schema = pa.schema([("node", pa.binary()), ("root", pa.binary()), ("s", pa.int64()), ("w", pa.float64()), ("total", pa.float64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at, to in cws.slices(big.column(2)):
                batch = big.slice(at, to - at)
                row, s, w = _sets(batch.column(2), idf.value)
                w = w.astype(np.float64)
                who = pa.array(row)
                columns = [batch.column(0).cast(pa.binary()).take(who), batch.column(1).cast(pa.binary()).take(who), s.view(np.int64), w, np.bincount(row, w, batch.num_rows)[row]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return texts.select("node", "root", "t").mapInArrow(find, "node binary, root binary, s bigint, w double, total double")


def between_classes(rows: DataFrame, known: DataFrame, texts: DataFrame, fetch: Fetch, idf: Broadcast, threshold: float) -> DataFrame:
    """(lead, node, sim) of all pairs of different classes at the threshold, and of some others; those of known are left out. rows: (node, root).

    Runs that only one class holds are in no such pair. The others are ordered, rare ones first. Two texts of weights a and b are at the threshold t if they share t / (1 + t) * (a + b) or more, so much of both
    comes after the first run that they share, that run included. So only the runs of a text that t of its weight, at least, does not come before are joined on. A run's largest class does not meet
    itself: at most four times as many pairs are looked at as lie between classes.
    """
    slack = 1 - 1e-9  # sums in another order
    sets = written(_weighted(texts.join(rows, "node"), idf), "sets")
    held = sets.groupBy("s").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s", "n")
    after = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("s")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = met(sets, written(held, "held"), "s").withColumn("rest", F.sum("w").over(after)).where(F.col("rest") >= threshold * slack * F.col("total"))
    heads = written(heads.select("s", "node", "root", "total", "rest"), "heads")
    of = heads.groupBy("s", "root").agg(F.count("*").alias("m")).groupBy("s").agg(F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("x"), F.count("*").alias("roots"))
    of = written(of.where("roots > 1").select("s", "n", (F.col("n") - F.col("x.m")).alias("others"), F.col("x.root").alias("top")), "runs")
    meet = written(met(heads, of, "s"), "meet")

    # a hot run is dealt in cells of at most some HOT by HOT texts
    def parts(n: str) -> Column:
        return F.ceil(F.col(n) / HOT).cast("int")

    def own(n: str) -> Column:
        return F.pmod(F.xxhash64("node"), parts(n)).cast("int")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), parts(n) - 1))

    a = meet.where("root <> top").select("s", own("others").alias("i"), every("n").alias("j"), F.col("node").alias("lead"), F.col("root").alias("lead_root"), F.col("total").alias("lead_total"), F.col("rest").alias("lead_rest"))
    b = meet.select("s", every("others").alias("i"), own("n").alias("j"), "node", "root", "top", "total", "rest")
    least = threshold / (1 + threshold) * slack * (F.col("total") + F.col("lead_total"))
    pairs = a.join(b, ["s", "i", "j"]).where((F.col("root") != F.col("lead_root")) & ((F.col("root") == F.col("top")) | (F.col("node") > F.col("lead"))) & (F.least("rest", "lead_rest") >= least))
    pairs = written(unknown(pairs.select(F.least("lead", "node").alias("lead"), F.greatest("lead", "node").alias("node")), known), "between")
    return written(verified(pairs, fetch, idf).distinct(), "between_tested")


def split_up(rows: DataFrame, known: DataFrame, texts: DataFrame, idf: Broadcast, threshold: float) -> list[DataFrame]:
    """Pairs (lead, node, sim) tested by splitting large buckets; rows: (band, n, node, c, root), texts: (node, t). It may miss some, which ``between_classes`` finds afterwards."""
    near = fetch_from(texts)
    pool = written(_pools(texts, idf), "pool")
    size = sum(STEPS)
    # the samples of a tree are drawn from the pool by the tree's name
    draw = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.col("names")[F.pmod(F.xxhash64("bucket", j), F.lit(POOL)).cast("int")])
    cur = written(rows.join(pool.select("node", "bits"), "node").select(F.col("band").alias("bucket"), "node", "c", "root", "bits"), "whole")
    tested, at = [], 0
    first = F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("c"), F.desc("node")))
    for i, step in enumerate(chain((0,), STEPS, repeat(0))):  # buckets as they are, then split; after the last split, leaders go on to leave them
        if i == 1:
            tree = cur.withColumn("tree", F.explode(F.sequence(F.lit(1), trees(F.col("n"))))).withColumn("bucket", F.xxhash64("bucket", "tree"))
            cur = written(tree.join(pool.select("node", "names"), "node").select("bucket", "node", "c", "root", "bits", draw.alias("path")), "trees")
        if step:
            cur = cur.withColumn("bucket", F.xxhash64("bucket", *[F.col("path")[at + j] for j in range(step)]))
        at += step
        mixed = _mixed(cur, "bucket")
        if not (rows_left := mixed.count()):
            break
        cur = written(met(cur.drop("n"), mixed.select("bucket", "n"), "bucket", rows_left), f"part_{at}")
        heads = cur.withColumn("place", first).where(F.col("place") <= LEADERS)
        if i == 0:  # who is like these first leaders is at the centre of its bucket, and leads from here on
            some = written(heads.groupBy("bucket").agg(F.collect_list("bits").alias("some"), F.first("n").alias("n")), "some")
            like = F.aggregate("some", F.lit(0), lambda a, x: a + _same(F.col("bits"), x))
            cur = written(met(cur.drop("n"), some, "bucket", rows_left).withColumn("c", like.cast("long")).drop("some"), "central")
            heads = cur.withColumn("place", first).where(F.col("place") <= LEADERS)
        heads = written(heads.select("bucket", "n", F.col("c").alias("lead_c"), F.col("node").alias("lead"), F.col("root").alias("lead_root"), F.col("bits").alias("lead_bits")), f"heads_{at}")
        after = (F.col("c") < F.col("lead_c")) | (F.col("c") == F.col("lead_c")) & (F.col("node") < F.col("lead"))
        pairs = met(cur.drop("n"), heads, "bucket").where(after & (F.col("root") != F.col("lead_root")) & _likely(threshold))
        both = written(unknown(pairs.select("lead", "node", "lead_root", "root"), known), "likely")
        cur = cur.where(F.col("n") > LEADERS).join(heads.select("bucket", F.col("lead").alias("node")), ["bucket", "node"], "left_anti")
        joins = 0
        if not both.isEmpty():
            new = written(verified(both.select("lead", "node"), near, idf).distinct(), "tested")
            known = known.unionByName(new)
            found = new.where(F.col("sim") >= threshold - 1e-12)
            tested.append(new)
            # linked classes are one from here on: the larger root gives way to the least that it is linked to
            lo, hi = F.least("root", "lead_root"), F.greatest("root", "lead_root")
            joined = written(both.join(found, ["lead", "node"]).groupBy(hi.alias("root")).agg(F.min(lo).alias("of")), "joined")
            joins = joined.count()
            cur = cur.join(F.broadcast(joined) if joins <= KEYS else joined, "root", "left").withColumn("root", F.coalesce("of", "root"))
        if i and joins < WORTH * rows_left:
            break
        cur = written(cur.select("bucket", "node", "c", "root", "bits", *(["path"] if i else ["n"])), f"rest_{at}")
    return tested


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(key, id, node, class_id, kept) for each row; class_id: the least id of the class; kept: the row's key is the class's first."""
    d = docs.select(row_key(F.col(id_col), F.col(text)).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text).alias("t"))
    idf = docs.sparkSession.sparkContext.broadcast(shingle_weights(d.select("t")))
    signed = written(_bands(d.select("key", "id", F.unhex(F.md5("t")).alias("node"), "t"), idf), "signed")
    order = F.struct(F.coalesce("id", F.lit((1 << 63) - 1)).alias("i"), F.col("key"), F.col("id"))
    alone = signed.where("bands IS NULL").select("key", "id", "node", F.col("id").alias("class_id"), F.lit(True).alias("kept"))
    some = signed.where("bands IS NOT NULL")
    nodes = written(some.groupBy("node").agg(F.min(order).alias("best"), F.first("bands").alias("bands"), F.count("*").alias("n")), "nodes")
    twice = written(some.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "twice")  # rows that repeat an id and its text
    no_repeats = twice.isEmpty()

    def fetch(wanted: DataFrame) -> DataFrame:
        keys = written(wanted.join(nodes.select("node", F.col("best.key").alias("key")), "node"), "wanted")
        got = d.select("key", "t").join(if_small(keys, KEYS), "key")
        if no_repeats:
            return got
        mark = if_small(twice, KEYS)
        once = got.join(mark, "key", "left_semi").groupBy("lead", "salt", "role", "node").agg(F.first("t").alias("t"))
        return got.join(mark, "key", "left_anti").select(once.columns).unionByName(once)

    comp = links_of(nodes.select("node", "bands"), fetch, idf, threshold)
    root = written(nodes.select("node", "best", "n").join(comp, "node", "left").select("node", "best", "n", F.coalesce("root", "node").alias("root")), "rooted")
    first = written(root.groupBy("root").agg(F.min("best").alias("first"), F.count("*").alias("n")), "firsts")
    named = written(met(root.drop("n"), first, "root").select("node", F.col("first.id").alias("class_id"), F.col("first.key").alias("first_key")).join(nodes.select("node", "n"), "node"), "named")
    return alone.unionByName(met(some, named, "node").select("key", "id", "node", "class_id", (F.col("key") == F.col("first_key")).alias("kept")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the least id; all columns of docs."""
    c = written(classes(docs, id_col, text, threshold), "classes")
    gone = written(c.where("NOT kept").select(F.col("key").alias("__gone")).distinct(), "gone")
    left = docs.withColumn("__key", row_key(F.col(id_col), F.col(text))).join(if_small(gone), F.col("__key") == F.col("__gone"), "left_anti")
    again = written(c.where("kept").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("__again")), "again")
    if again.isEmpty():
        return left.select(*docs.columns)
    again = if_small(again)
    once = left.join(again, F.col("__key") == F.col("__again"), "left_anti")
    of_many = left.join(again, F.col("__key") == F.col("__again"), "left_semi").where(F.col(text).rlike(r"[^\x20\x09-\x0D]")).dropDuplicates(["__key"])
    blank = left.join(again, F.col("__key") == F.col("__again"), "left_semi").where(~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return once.unionByName(of_many).unionByName(blank).select(*docs.columns)
