"""Chunking of documents: windows over words, folds over pages and sentences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions.text import S, bound, repair_ellipsis, sentences


def sampled_paragraphs(docs: DataFrame, sep: str = "\n", min_chars: int = 30, most: int = 12, cap: int = 14_000) -> DataFrame:
    """(doc_id, place, text): evenly spaced paragraphs until their lengths would pass the cap."""
    p = docs.select("doc_id", F.posexplode(F.split("text", sep)).alias("at", "text")).where(F.length(F.trim("text")) > min_chars)
    w = Window.partitionBy("doc_id")
    p = p.withColumns({"place": (F.row_number().over(w.orderBy("at")) - 1).cast("long"), "n": F.count("*").over(w)}).where(F.col("place") % F.greatest(F.lit(1), F.floor(F.col("n") / most)) == 0)
    upto = F.sum(F.length("text")).over(w.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return p.withColumn("upto", upto).where(F.col("upto") <= cap).select("doc_id", "place", "text")


def word_windows(articles: DataFrame, size: int = 250, step: int = 200, least: int = 30) -> DataFrame:
    """(url, chunk_id, n_words, text) for (url, title, text): overlapping windows of words; short tails are left out, ids count what is kept."""
    ws = F.array_remove(F.split("text", f"{S}+"), "")
    a = articles.select("url", "title", ws.alias("ws")).where(F.size("ws") > 0)
    a = a.select("url", "title", F.posexplode(F.transform(F.sequence(F.lit(0), F.size("ws") - 1, F.lit(step)), lambda i: F.slice("ws", i + 1, size))).alias("i", "w")).where(F.size("w") >= least)
    n = F.row_number().over(Window.partitionBy("url").orderBy("i")) - 1
    return a.select("url", F.format_string("ca_%s_%03d", F.substring(F.sha2("url", 256), 1, 8), n).alias("chunk_id"), F.size("w").cast("long").alias("n_words"), F.concat(F.lit("Title: "), F.col("title"), F.lit("\n\n"), F.array_join("w", " ")).alias("text"))


def article_chunks(articles: DataFrame, size: int = 250, overlap: int = 50, least: int = 30) -> DataFrame:
    """articles (url, body, ...) with chunk_id and text: the whole body of up to size words as one chunk, else overlapping windows; short tails are left out; ids count from 1."""
    ws, own = F.split("body", f"{S}+"), [F.col(c) for c in articles.columns if c != "body"]
    n = F.size("ws")
    starts = F.sequence(F.lit(0), n - 1, F.lit(size - overlap))
    windows = F.filter(F.transform(starts, lambda i: F.slice("ws", i + 1, size)), lambda w: F.size(w) >= least)
    texts = F.when(n <= size, F.array("body")).otherwise(F.transform(windows, lambda w: F.array_join(w, " ")))
    c = articles.withColumn("ws", F.array_remove(ws, "")).select(*own, F.posexplode(texts).alias("i", "text"))
    return c.withColumn("chunk_id", F.format_string("ca_%s_%03d", F.substring(F.sha2("url", 256), 1, 8), F.col("i") + 1)).drop("i")


def sentence_chunks(text: Column, most: int = 180) -> Column:
    """Chunks of whole sentences of at most ``most`` words; a chunk starts with the last sentence of the one before, if that had more. A fold over the sentences."""
    clean = repair_ellipsis(text)
    count = lambda s: F.size(F.array_remove(F.split(s, f"{S}+"), ""))
    counted = F.transform(sentences(clean), lambda s: F.struct(s.alias("s"), count(s).alias("n")))
    empty = F.array().cast("array<struct<s:string,n:int>>")
    start = F.struct(F.array().cast("array<string>").alias("done"), empty.alias("cur"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y["n"])
    said = lambda a: F.array_join(F.transform(a, lambda x: x["s"]), " ")
    full = lambda acc, x: (total(acc["cur"]) + x["n"] > most) & (F.size(acc["cur"]) > 0)
    rest = lambda acc: F.when(F.size(acc["cur"]) > 1, F.slice(acc["cur"], -1, 1)).otherwise(empty)
    step = lambda acc, x: F.struct(F.when(full(acc, x), F.array_append(acc["done"], said(acc["cur"]))).otherwise(acc["done"]).alias("done"), F.array_append(F.when(full(acc, x), rest(acc)).otherwise(acc["cur"]), x).alias("cur"))
    return F.when(count(clean) <= most, F.array(clean)).otherwise(F.aggregate(counted, start, step, lambda acc: F.when(F.size(acc["cur"]) > 0, F.array_append(acc["done"], said(acc["cur"]))).otherwise(acc["done"])))


def _pack(texts: list[str], ids: list[int], most: int) -> Iterator[tuple[str, list[int]]]:
    """Texts in order, joined by spaces up to ``most`` characters; a longer one is split at words, of which a longer one stays whole."""
    held, named, size = [], [], 0
    for text, i in zip(texts, ids, strict=True):
        words = [text] if len(text) <= most else text.split()
        if len(words) > 1 and held:
            yield " ".join(held), named
            held, named, size = [], [], 0
        for w in words:
            if held and size + 1 + len(w) > most:
                yield " ".join(held), named
                held, named, size = [], [], 0
            size += len(w) + (1 if held else 0)
            held.append(w)
            if named[-1:] != [i]:
                named.append(i)
        if len(words) > 1 and held:
            yield " ".join(held), named
            held, named, size = [], [], 0
    if held:
        yield " ".join(held), named


def page_chunks(blocks: DataFrame, most: int = 1000, least: int = 300) -> DataFrame:
    """(doc_id, chunk_id, page_numbers, block_seqs, character_count, sub_chunk_index, total_sub_chunks, text) of each document.

    Pages below ``least`` characters are carried to the next; what is gathered is one chunk if its blocks have ``most``
    characters at most, else it is packed block by block, and all its parts name all its pages. A pass over the sorted blocks holds what is carried, never a document.
    """
    types = {"doc_id": pa.int64(), "chunk_id": pa.string(), "page_numbers": pa.list_(pa.int64()), "block_seqs": pa.list_(pa.int64()), "character_count": pa.int64(), "sub_chunk_index": pa.int64(), "total_sub_chunks": pa.int64(), "text": pa.string()}
    schema = pa.schema(list(types.items()))

    def cut(doc: int, held: list[tuple[str, int, int]], done: int) -> list[tuple]:
        """The chunks of what is gathered; held: (text, seq, page)."""
        pages = sorted({p for _, _, p in held})
        if sum(len(t) for t, _, _ in held) <= most:
            return [(doc, f"chk_{done + 1:04d}", pages, [s for _, s, _ in held], len(x := " ".join(t for t, _, _ in held)), None, None, x)]
        got = list(_pack([t for t, _, _ in held], [s for _, s, _ in held], most))
        return [(doc, f"chk_{done + i:04d}", pages, seqs, len(x), i, len(got), x) for i, (x, seqs) in enumerate(got, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, page, held, done = None, None, [], 0
        for batch in batches:
            out = []
            for d, p, s, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if d != doc:
                    out += cut(doc, held, done) if held else []
                    doc, held, done = d, [], 0
                elif p != page and sum(len(x) for x, _, _ in held) >= least:
                    out += cut(doc, held, done)
                    held, done = [], int(out[-1][1][4:])
                page = p
                held.append((t, s, p))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*cut(doc, held, done), strict=True), schema, strict=True)], schema=schema)

    t = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    b = blocks.select("doc_id", F.col("page_num").cast("long").alias("page_num"), F.col("seq").cast("long").alias("seq"), t.alias("text")).where("text <> ''")
    ddl = "doc_id bigint, chunk_id string, page_numbers array<bigint>, block_seqs array<bigint>, character_count bigint, sub_chunk_index bigint, total_sub_chunks bigint, text string"
    return b.repartition("doc_id").sortWithinPartitions("doc_id", "page_num", "seq").mapInArrow(run, ddl)


def sampled_content(text: Column, cap: int = 14_000, min_chars: int = 30, most: int = 12) -> Column:
    """A text up to the cap: whole if it fits, else evenly spaced paragraphs until one would pass it; few or no paragraphs give the text's beginning."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"\A\s+|\s+\z", "")), lambda p: F.length(p) > min_chars)

    def chosen(ps: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.size(ps) / most))
        spaced = F.filter(ps, lambda p, i: i % step == 0)
        start = F.struct(F.array().cast("array<string>").alias("got"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        take = lambda a, p: F.when(a["full"] | (a["n"] + F.length(p) > cap), F.struct(a["got"].alias("got"), a["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct(F.array_append(a["got"], p).alias("got"), (a["n"] + F.length(p)).alias("n"), F.lit(False).alias("full")))
        got = F.aggregate(spaced, start, take, lambda a: a["got"])
        return F.when((F.size(ps) > 6) & (F.size(got) > 0), F.array_join(got, "\n\n")).otherwise(F.substring(text, 1, cap))

    return F.when(F.length(text) <= cap, text).otherwise(bound(paragraphs, chosen))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    n = F.col("character_count")
    return chunks.agg(F.count("*").alias("chunks"), F.avg(n).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def _recursive(text: str, most: int, overlap: int, separators: list[str]) -> list[str]:
    """Pieces of a text at the first separator that it holds, each led by it, packed up to ``most`` characters with the last ones, up to ``overlap``, once more; a longer piece is parted at the next separators."""
    at = next(i for i, s in enumerate(separators) if s == "" or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    pieces = list(text) if sep == "" else [x for x in (p if i == 0 else sep + p for i, p in enumerate(text.split(sep))) if x]
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if (said := "".join(held).strip()):
            out.append(said)

    for piece in pieces:
        if len(piece) >= most and rest:
            flush()
            held.clear()
            out += _recursive(piece, most, overlap, rest)
            continue
        size = sum(map(len, held))
        if held and size + len(piece) > most:
            flush()
            while held and (size > overlap or size + len(piece) > most):
                size -= len(held.pop(0))
        held.append(piece)
    flush()
    return out


def recursive_chunks(docs: DataFrame, most: int = 1000, overlap: int = 200, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> DataFrame:
    """(doc_id, chunk_index, text): texts parted at the coarsest separators that give chunks of at most ``most`` characters; blank texts have none."""

    @F.pandas_udf(ArrayType(StringType()))
    def parted(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _recursive(t, most, overlap, list(separators)) if t and t.strip() else [])

    return docs.select("doc_id", F.posexplode(parted("text")).alias("chunk_index", "text"))
