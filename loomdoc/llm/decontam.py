"""Benchmark decontamination by a prefix-filtered set join (operator 10; DataFrame functions only).

An item's windows are its runs of ``window`` words (a shorter item is one window). A window is a set of shingles of up
to three words; containing the window means containing all of them, so the prefix that must match is its one rarest
shingle, by frequency over the whole corpus. Documents are joined on these rarest shingles only. A hit fixes where the
item would lie in the document; positional and length bounds drop impossible placements, and each remaining
placement is verified by comparing item-sized windows word by word.

Defined cases: null or wordless texts and items have no words and match nothing; repeated items count once per
item_id and a null item_id is never listed, yet its words count as hit; repeated documents are each judged; an empty
benchmark leaves all documents clean; further columns pass through ``decontaminate`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed, if_small, joined_hashes, row_key, written

WINDOW = 13
SHINGLE = 3
#: Documents with placements that a broadcast may hold, with their items' words: some 50 MB.
BROADCAST_CANDIDATES = 20_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """A-Z lower-cased, then runs of letters a-z, digits and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), "")


def _shingles(df: DataFrame, ws: str, size: int) -> DataFrame:
    """df with array column __g: the hash of the shingle that starts at each word."""
    df = df.withColumn("__g", hashed(F.col(ws)))
    if size >= 2:
        df = df.withColumn("__g2", joined_hashes(F.col("__g"), 1))
        if size == 3:
            n = F.size("__g2") - 1
            df = df.withColumn("__g2", F.when(n > 0, F.zip_with(F.slice("__g2", 1, n), F.slice("__g", 3, n), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
        df = df.withColumn("__g", F.col("__g2")).drop("__g2")
    return df


def items_of(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """(item, ids, iw, n, len, size): the different word sequences of the benchmark with the ids that have them."""
    b = benchmark.select(F.col(item_id).cast("string").alias("id"), item_words(F.col(text)).alias("iw")).where(F.size("iw") > 0)
    n = F.size("iw")
    return b.withColumn("item", F.sha2(F.array_join("iw", " "), 256)).groupBy("item").agg(F.collect_set("id").alias("ids"), F.first("iw").alias("iw")).withColumns({"n": n, "len": F.least(n, F.lit(window)), "size": F.least(n, F.lit(SHINGLE))})


def probes_of(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """(g, item, off): of each window of the items with shingles of this size, the rarest shingle in docs (dw) and where it stands in the item."""
    own = _shingles(items.where(F.col("size") == size), "iw", size).select("item", "n", "len", F.posexplode("__g").alias("off", "g"))
    own = written(own, f"item_shingles_{size}")
    # outer, as a filter for empty arrays would be pushed down with a copy of all that makes the array
    counts = _shingles(docs, "dw", size).select(F.explode_outer("__g").alias("g")).join(own.select("g").distinct(), "g").groupBy("g").agg(F.count("*").alias("freq"))
    ranked = own.join(written(counts, f"frequency_{size}"), "g", "left").withColumn("rank", F.struct(F.coalesce("freq", F.lit(0)).alias("f"), "g", "off"))
    starts = ranked.withColumn("start", F.explode(F.sequence(F.greatest(F.lit(0), F.col("off") + size - F.col("len")), F.least(F.col("off"), F.col("n") - F.col("len")))))
    best = starts.groupBy("item", "start").agg(F.min("rank").alias("r")).where("r.f > 0")  # a shingle that no document has rules its window out
    return written(best.select("item", F.col("r.g").alias("g"), F.col("r.off").alias("off")).distinct(), f"probes_{size}")


def placements(docs: DataFrame, items: DataFrame) -> DataFrame | None:
    """(key, item, at): where an item's rarest shingles let it lie; at may be negative. docs: (key, dw). The texts stay behind."""
    sizes = [r["size"] for r in items.select("size").distinct().orderBy("size").collect()]  # three values at most
    out = None
    for size in sizes:
        probes = probes_of(docs, items, size)
        spread = _shingles(docs, "dw", size).select("key", F.posexplode_outer("__g").alias("pos", "g"))
        found = spread.join(probes, "g").select("key", "item", (F.col("pos") - F.col("off")).alias("at")).distinct()
        out = found if out is None else out.unionByName(found)
    return out


def judge(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_rows: int = BROADCAST_CANDIDATES) -> DataFrame:
    """(key, doc_id, n_words, n_hit, items, contaminated) for each row of docs; items: sorted ids of items with a window in it."""
    d = docs.select(row_key(F.col(id_col), F.col(text)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    items = written(items_of(benchmark, item_id, item_text, window), "items")
    at = placements(d.select("key", item_words(F.col("t")).alias("dw")), items)
    if at is None:
        return d.select("key", "doc_id", F.size(item_words(F.col("t"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    at = at.groupBy("key", "item").agg(F.collect_set("at").alias("ats"))  # an item's words come once for each document
    cands = at.join(items, "item").groupBy("key").agg(F.collect_list(F.struct("ids", "iw", "len", "ats")).alias("c"))
    width = F.lit(64) + F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + 16 * F.size(x["iw"]) + 8 * F.size(x["ats"]) + 32 * F.size(x["ids"]))
    j = d.join(if_small(written(cands, "candidates"), broadcast_rows, width), "key", "left").select("key", "doc_id", "c", item_words(F.col("t")).alias("dw"))
    n = F.size("dw")

    def verified(c: Column) -> Column:
        """The item's windows that lie there word by word, as spans of the document."""

        def placed(at: Column) -> Column:
            first, last = F.greatest(F.lit(0), -at), F.least(F.size(c["iw"]), n - at) - c["len"]
            offsets = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            fits = F.filter(offsets, lambda o: F.slice("dw", at + o + 1, c["len"]) == F.slice(c["iw"], o + 1, c["len"]))
            return F.transform(fits, lambda o: F.struct((at + o).alias("from"), (at + o + c["len"]).alias("to")))

        return F.struct(c["ids"].alias("ids"), F.flatten(F.transform(c["ats"], placed)).alias("spans"))

    j = j.select("key", "doc_id", n.cast("long").alias("n_words"), F.transform("c", verified).alias("v"))
    j = j.withColumn("v", F.filter("v", lambda x: F.size(x["spans"]) > 0))
    spans = F.sort_array(F.array_distinct(F.flatten(F.transform("v", lambda x: x["spans"]))))
    hit = F.aggregate(spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["to"] - F.greatest(a["end"], s["from"]))).alias("n"), F.greatest(a["end"], s["to"]).alias("end")), lambda a: a["n"])
    ids = F.sort_array(F.array_distinct(F.flatten(F.transform("v", lambda x: x["ids"]))))
    out = j.select("key", "doc_id", "n_words", F.coalesce(hit, F.lit(0)).cast("long").alias("n_hit"), F.coalesce(ids, F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of docs that are not contaminated, with all columns of docs."""
    bad = written(judge(docs, benchmark, id_col, text, **kw).where("contaminated").select(F.col("key").alias("__bad")).distinct(), "contaminated")
    return docs.join(if_small(bad), row_key(docs[id_col], docs[text]) == F.col("__bad"), "left_anti")
