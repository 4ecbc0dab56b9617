"""Substring dedup by seeds and extension (operator 3).

Seeds: from each text's hashes of ``SEED_WORDS`` words, winnowing keeps the least of every ``span`` - ``SEED_WORDS`` + 1
in a row, so each stretch of ``span`` words has exactly one anchor, and equal stretches have equal anchors. Documents are
joined on the anchors that occur in more than one. Around a shared anchor, the stretches that hold it (one for each way to share
``span`` words to its left and right) tell each occurrence the smallest document that goes on like it, by 64-bit hashes; so no two
occurrences have to be paired that share the anchor alone. Extension: the matches of a document with
another one that follow on one another, over all anchors, join to maximal repeats (``maximal``), all of ``span`` words or more, and the words
of both documents are compared by SHA-256 over the whole repeat: what isn't equal word for word stays. A word is removed if a
repeat covers it that also starts in a document with a smaller id.

A hash alone never removes a word. Of n different stretches around one anchor, n^2 / 2^65 pairs are expected to have one
hash; a repeat that such a pair hides from the comparison would be kept (3e-8 for a million stretches).

An anchor with at most ``HOT`` records is worked on beside the others of its hash partition. A hotter one is not gathered: its
records are dealt over one task for each ``HOT`` of them; its stretches are reduced to (hash, smallest document) on the map side
and then joined under salted keys. Both ways give the same rows. Texts are hashed and winnowed twice, since what the first pass makes is twice as large
as they are.

Defined cases: null text has no words; texts shorter than ``span`` keep all; a null id is larger than all others; rows that
repeat an id are copies of one document, so they never remove each other, and are each given; texts of any length have records of at most
``MOST`` stretches; an empty table gives an empty result; further columns are ignored by ``digest`` and pass through ``deduplicate``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed, if_small, words, written
from .hashing import flat, inner, least, runs

SPAN = 50
SEED_WORDS = 20
HOT = 2000
#: Stretches in one record: as many as bits in use.
MOST = 32
#: Bits in use of a stretch's hash; fewer in tests alone.
BITS = 64
LAST = (1 << 63) - 1
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A row: its id, and a hash of its text.
ROW = ["doc", "h"]


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, h, t) of each row."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))


def _anchored(d: DataFrame, span: int, whole: bool) -> DataFrame:
    """A record for each run of at most MOST stretches with one anchor: doc, anchor; if whole, also h, at, and the stretches' hashes."""
    out = pa.schema([("doc", pa.int64()), ("anchor", pa.int64())] + ([("h", pa.int64()), ("at", pa.int32()), ("wide", pa.list_(pa.int64()))] if whole else []))
    drop = np.uint64(64 - BITS)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                h, lengths = flat(batch.column(2))
                where = inner(lengths, span)
                if not len(where):
                    continue
                m = least(runs(h, SEED_WORDS), span - SEED_WORDS + 1)[where]
                row = np.repeat(np.arange(len(lengths)), np.maximum(lengths - span + 1, 0))
                start = where - (np.cumsum(lengths) - lengths)[row]
                new = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (row[1:] != row[:-1])]))
                # runs longer than MOST, as in periodic texts, are cut
                size = np.diff(np.append(new, len(m)))
                parts = -(-size // MOST)
                new = np.repeat(new, parts) + MOST * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                cols = [pa.array(np.asarray(batch.column(0))[row[new]]), pa.array(m[new].view(np.int64))]
                if whole:
                    wide = (runs(h, span)[where] >> drop).view(np.int64)
                    cols += [pa.array(np.asarray(batch.column(1))[row[new]]), pa.array(start[new].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(new, len(m)).astype(np.int32)), pa.array(wide))]
                yield pa.RecordBatch.from_arrays(cols, schema=out)

    return d.select("doc", "h", hashed(words(F.col("t"))).alias("hashes")).mapInArrow(find, "doc bigint, anchor bigint" + (", h bigint, at int, wide array<bigint>" if whole else ""))


def matches(d: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc, h, at, mask, first, first_h, shift): from word ``at`` on, bit i of mask says that the stretch at word at + i stands in the smaller document (first, first_h), shift words before. d: (doc, h, t)."""
    seeds = _anchored(d, span, False).groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where(F.col("first") < F.col("last"))
    # a salt for each HOT records of a hot anchor, none for the others
    seeds = written(seeds.select("anchor", F.when(F.col("n") > HOT, F.ceil(F.col("n") / max(HOT, 1)).cast("int")).otherwise(0).alias("salts")), "seeds")
    hot = written(seeds.where("salts > 0"), "hot")
    every = _anchored(d, span, True).join(if_small(hot), "anchor", "left")
    every = every.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc", "h", "at"), F.col("salts")).cast("int") + 1, F.lit(0))).drop("salts")
    dealt = seeds.select("anchor", F.explode(F.when(F.col("salts") > 0, F.sequence(F.lit(1), F.col("salts"))).otherwise(F.array(F.lit(0)))).alias("salt"))
    joined = every.join(dealt, ["anchor", "salt"])
    here = F.struct("doc", "h", (F.col("at") + F.col("i")).alias("pos"))
    record = ["doc", "h", "at", F.col("first.doc").alias("first"), F.col("first.h").alias("first_h"), (F.col("at") + F.col("i") - F.col("first.pos")).alias("shift")]

    def masks(found: DataFrame, *by: str) -> DataFrame:
        m = found.where(F.col("first.doc") < F.col("doc")).select(*by, "i", *record)
        m = m.groupBy(*by, "doc", "h", "at", "first", "first_h", "shift").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))
        return m.select("doc", "h", "at", "mask", "first", "first_h", "shift")

    # usual anchors: the join has put an anchor's records side by side
    side = joined.where("salt = 0").select("anchor", "salt", "doc", "h", "at", F.posexplode("wide").alias("i", "w"))
    side = masks(side.withColumn("first", F.min(here).over(Window.partitionBy("anchor", "salt", "w"))), "anchor", "salt")
    # hot anchors: reduced before they meet
    flat_hot = joined.where("salt > 0").select("anchor", "salt", "doc", "h", "at", F.posexplode("wide").alias("i", "w"))
    firsts = flat_hot.groupBy("anchor", "w").agg(F.min(here).alias("first"), F.max("doc").alias("last")).where(F.col("first.doc") < F.col("last"))
    firsts = firsts.select("anchor", "w", "first").join(if_small(hot), "anchor").select("anchor", "w", "first", F.explode(F.sequence(F.lit(1), F.col("salts"))).alias("salt"))
    return side.unionByName(masks(flat_hot.join(firsts, ["anchor", "w", "salt"]), "anchor", "salt"))


def maximal(marks: list[dict], span: int) -> list[tuple[int, int, int, int, int]]:
    """(first, first_h, begin, shift, words) of the maximal repeats of a text with each smaller document: stretches that start one word after the other, at one shift, are one repeat."""
    starts: dict[tuple, set] = {}
    for m in marks or []:
        starts.setdefault((m["first"], m["first_h"], m["shift"]), set()).update(m["at"] + i for i in range(MOST) if m["mask"] >> i & 1)
    out = []
    for (first, first_h, shift), at in starts.items():
        begin = None
        for s in sorted(at):
            if begin is None or s != last + 1:  # noqa: F821
                if begin is not None:
                    out.append((first, first_h, begin, shift, last - begin + span))  # noqa: F821
                begin = s
            last = s
        out.append((first, first_h, begin, shift, last - begin + span))
    return out


def repeats(d: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc, h, repeats): of each row, (at, words, sha) of its maximal repeats, sha of the words in the smaller document. d: (doc, h, t)."""
    marks = matches(d, span).groupBy(*ROW).agg(F.collect_set(F.struct("at", "mask", "first", "first_h", "shift")).alias("marks"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "h", "at", "n", "first", "first_h", "begin"]
        for batch in batches:
            rows = [(doc, h, at, n, first, first_h, at - shift) for doc, h, marks in zip(*(c.to_pylist() for c in batch.columns), strict=True) for first, first_h, at, shift, n in maximal(marks, span)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names=names)

    found = written(marks.mapInArrow(extend, "doc bigint, h bigint, at bigint, n bigint, first bigint, first_h bigint, begin bigint"), "repeats")
    passage = ["first", "first_h", "begin", "n"]
    asked = written(found.groupBy(*passage).agg(F.count("*").alias("rows")).select(*passage, F.ceil(F.col("rows") / max(HOT, 1)).cast("int").alias("salts")), "asked")
    per_row = written(asked.groupBy("first", "first_h").agg(F.collect_list(F.struct("begin", "n", "salts")).alias("asked")), "passages")
    texts = d.withColumnsRenamed({"doc": "first", "h": "first_h"})

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.string()]
        for batch in batches:
            rows = []
            for first, first_h, t, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ws = WORD.findall(t or "")
                rows += [(first, first_h, a["begin"], a["n"], a["salts"], _sha(ws[a["begin"] : a["begin"] + a["n"]])) for a in asked]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names=[*passage, "salts", "sha"])

    said = texts.join(if_small(per_row, width=F.size("asked") * 20), ["first", "first_h"]).select("first", "first_h", "t", "asked")
    # repeated rows are asked more than once
    said = written(said.mapInArrow(digests, "first bigint, first_h bigint, begin bigint, n bigint, salts int, sha string").distinct(), "digests")
    hot = written(said.where("salts > 1").select(*passage, "salts"), "hot-passages")
    dealt = said.select(*passage, "sha", F.explode(F.sequence(F.lit(1), F.col("salts"))).alias("salt"))
    every = found.join(if_small(hot), passage, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc", "h", "at"), F.col("salts")).cast("int") + 1, F.lit(1)))
    told = every.join(if_small(dealt), [*passage, "salt"])
    return written(told.groupBy(*ROW).agg(F.collect_list(F.struct("at", "n", "sha")).alias("repeats")), "marks")


def _sha(ws: list[str]) -> str:
    return hashlib.sha256(" ".join(ws).encode()).hexdigest()


def _cut(ws: list[str], found: list[dict]) -> list[str]:
    """The words outside the repeats that are equal, word for word, to those of the smaller document."""
    gone = bytearray(len(ws))
    for r in found or []:
        if _sha(ws[r["at"] : r["at"] + r["n"]]) == r["sha"]:
            gone[r["at"] : r["at"] + r["n"]] = b"\x01" * r["n"]
    return [w for w, g in zip(ws, gone, strict=True) if not g]


def _marked(docs: DataFrame, id_col: str, text: str, span: int) -> DataFrame:
    """docs with __repeats, those of each row."""
    found = repeats(_rows(docs, id_col, text), span).select(F.col("doc").alias("__doc"), F.col("h").alias("__h"), F.col("repeats").alias("__repeats"))
    key = {"__doc": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "__h": F.xxhash64(F.col(text))}
    return docs.withColumns(key).join(found, ["__doc", "__h"], "left")


def digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, t, found in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ws = WORD.findall(t or "")
                kept = _cut(ws, found) if found else ws
                rows.append((i, len(ws), len(ws) - len(kept), _sha(kept)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

    m = _marked(docs, id_col, text, span)
    return m.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("t"), "__repeats").mapInArrow(cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """docs with the repeats cut out of the texts that have any; what is left of such a text is joined by single spaces."""

    @F.pandas_udf("string")
    def cut(texts, found):
        import pandas as pd

        return pd.Series([" ".join(_cut(WORD.findall(t or ""), list(f))) for t, f in zip(texts, found, strict=True)])

    m = _marked(docs, id_col, text, span)
    changed = m.where("__repeats IS NOT NULL").withColumn(text, cut(F.col(text), F.col("__repeats")))
    return changed.unionByName(m.where("__repeats IS NULL")).select(*docs.columns)
