"""Cleaning and ordering of page blocks. Blocks are rows (doc_id, page_num, seq, type, text, x0, y0, x1, y1); seq is the original order and every tie-break.

Operators that look at one block are column expressions; those that look at a page or a document are windows or joins
on (doc_id, page_num), so a document never has to fit in one task unless an operator says so.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Icon names that text recognition takes for words.
GARBAGE = ["headright", "boxshadowdwn", "boxshadow"]
#: Boxes that stand for "the whole page".
FULL_PAGE = [(0.0, 0.0, 595.0, 842.0), (0.0, 0.0, 595.2755737304688, 841.8897705078125), (0.0, 0.0, 612.0, 792.0)]
WS = r"[ \t\n\x0b\f\r]+"


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, WS), "")


def drop_junk(blocks: DataFrame) -> DataFrame:
    """Drops empty blocks that mark no blank page, garbage tokens, watermarks and bare URLs."""
    t = F.trim("text")
    junk = (t == "") & (F.col("type") != "blank_page") | F.lower(t).isin(GARBAGE) | (t.rlike("^[0-9\\-–]$") & F.col("type").isin("paragraph", "footer")) | t.rlike("(?i)^2019[-–]200?$") | t.rlike(r"(?i)^\(?https?://\S+\)?$")
    return blocks.where(~junk)


def duplicate_pages(pages: DataFrame, look_back: int = 4, least: float = 0.8, min_chars: int = 60, least_told: float = 0.5, telling: tuple[str, ...] = ("cave architecture", "gandhara")) -> DataFrame:
    """(doc_id, page_num) of pages whose word set nearly equals that of one of the previous ``look_back`` pages; dropped pages stay comparable. For pages with a telling phrase ``least_told`` is enough.

    One pass over a document's pages in order: each looks at a frame of those before it.
    """
    t = F.lower(F.trim(F.regexp_replace("text", WS, " ")))
    rank = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("page_num"))
    told = F.exists(F.array(*map(F.lit, telling)), lambda x: F.contains("t", x))
    p = pages.select("doc_id", "page_num", rank.alias("r"), t.alias("t")).where(F.length("t") >= min_chars)
    p = p.select("doc_id", "page_num", "r", F.array_distinct(split_words(F.col("t"))).alias("w"), F.when(told, least_told).otherwise(least).alias("enough"))
    before = Window.partitionBy("doc_id").orderBy("r").rangeBetween(-look_back, -1)
    p = p.withColumn("back", F.collect_list("w").over(before))
    sizes = F.transform("back", lambda v: F.struct(F.size(F.array_intersect("w", v)).alias("both"), F.size(v).alias("n")))
    near = F.exists(sizes, lambda x: x["both"] >= F.col("enough") * (F.size("w") + x["n"] - x["both"]))
    return p.where(near).select("doc_id", "page_num").distinct()


def drop_duplicate_pages(blocks: DataFrame, **kw) -> DataFrame:
    body = blocks.where(~F.col("type").isin("header", "footer"))
    pages = body.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))
    return blocks.join(duplicate_pages(pages, **kw), ["doc_id", "page_num"], "left_anti")


def drop_repeated_headings(blocks: DataFrame) -> DataFrame:
    """Drops a heading that equals the one right before it on its page, whatever the case. In a run of equals only the first stays, so the row before decides."""
    before = Window.partitionBy("doc_id").orderBy("seq")
    same = lambda c: F.lag(c).over(before) == c
    again = (F.col("type") == "heading") & same(F.col("type")) & same(F.col("page_num")) & same(F.lower(F.trim("text")))
    return blocks.withColumn("again", F.coalesce(again, F.lit(False))).where("NOT again").drop("again")


def blank_pages(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, type, text): a marker for each page without real content."""
    content = blocks.where(~F.col("type").isin("footer", "header", "toc_page_number") & (F.trim("text") != "")).select("doc_id", "page_num").distinct()
    return blocks.select("doc_id", "page_num").distinct().join(content, ["doc_id", "page_num"], "left_anti").select("doc_id", "page_num", F.lit("blank_page").alias("type"), F.lit("").alias("text"))


def block_ids(blocks: DataFrame) -> DataFrame:
    """Sequential ids blk_0001 ... of each document; longer than four digits from 10,000 on."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "seq"))
    return blocks.withColumn("block_id", F.format_string("blk_%04d", n))


def retype_by_position(blocks: DataFrame) -> DataFrame:
    """Types by height on the page: the upper 15 % are headers (but for short labels), the lowest 15 % footers, and a long header is a paragraph."""
    top = F.max("y0").over(Window.partitionBy("doc_id", "page_num"))
    ratio = F.when(top > 0, F.col("y0") / top)
    label = (F.col("type") == "paragraph") & (F.size(split_words(F.col("text"))) <= 4)
    movable = F.col("type").isin("header", "footer", "paragraph", "heading")
    new = F.when(movable & (ratio >= 0.85) & (F.col("type") != "header") & ~label, "header").when(movable & (ratio <= 0.15) & (F.col("type") != "footer"), "footer").otherwise(F.col("type"))
    return blocks.withColumn("type", new).withColumn("type", F.when((F.col("type") == "header") & (F.length(F.trim("text")) > 150), "paragraph").otherwise(F.col("type")))


def footers_to_headings(blocks: DataFrame) -> DataFrame:
    """A short footer that reads like a numbered section title is a heading."""
    title = F.col("text").rlike(r"^[0-9]+(\.[0-9]+)*[ \t]+[A-Z]") & (F.length("text") < 80)
    return blocks.withColumn("type", F.when((F.col("type") == "footer") & title, "heading").otherwise(F.col("type")))


def odd_share(text: Column, fine: str) -> Column:
    """Share of characters outside a class; 0 for an empty text."""
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, f"[{fine}]", "")) / n).otherwise(0.0)


def flag_mojibake(blocks: DataFrame, most: float = 0.4) -> DataFrame:
    """Adds encoding_error: more than the share is neither printable ASCII, Latin nor Devanagari."""
    return blocks.withColumn("encoding_error", odd_share(F.col("text"), r"\x20-\x7E\u00A0-\u024F\u0900-\u097F") > most)


def flag_boilerplate_mojibake(blocks: DataFrame, least: float = 0.3) -> DataFrame:
    """Adds encoding_error to boilerplate: at least the share is no printable ASCII (line ends and tabs are none)."""
    odd = odd_share(F.col("text"), r"\x20-\x7E") >= least
    return blocks.withColumn("encoding_error", F.col("is_boilerplate") & (F.col("text") != "") & odd)


def column_gap(blocks: DataFrame, width: float = 612.0, least: float = 15.0) -> DataFrame:
    """(doc_id, page_num, middle): where a page's two columns part: the widest gap between rounded left edges in the middle 40 %, if it is wide enough; blocks over 70 % of the width don't count."""
    xs = blocks.where(F.col("x1") - F.col("x0") <= 0.7 * width).select("doc_id", "page_num", F.round("x0").alias("x")).distinct()
    w = Window.partitionBy("doc_id", "page_num").orderBy("x")
    g = xs.withColumns({"next": F.lead("x").over(w)}).where("next IS NOT NULL").withColumns({"gap": F.col("next") - F.col("x"), "middle": (F.col("next") + F.col("x")) / 2})
    g = g.where((F.col("gap") >= least) & F.col("middle").between(0.3 * width, 0.7 * width))
    return g.groupBy("doc_id", "page_num").agg(F.min_by("middle", F.struct(-F.col("gap"), "x")).alias("middle"))


def column_order(blocks: DataFrame, width: float = 612.0) -> DataFrame:
    """Adds read_order: downwards; full-width blocks part the page into sections, in which the left column comes before the right one."""
    page = Window.partitionBy("doc_id", "page_num")
    j = blocks.join(column_gap(blocks, width), ["doc_id", "page_num"], "left")
    full = (F.col("x1") - F.col("x0") > 0.7 * width).cast("int")
    j = j.withColumn("anchor", full).withColumn("above", F.sum("anchor").over(page.orderBy("y0", "seq").rowsBetween(Window.unboundedPreceding, 0)))
    j = j.withColumns({"section": 2 * F.col("above") - F.col("anchor"), "side": F.when(F.col("anchor") == 1, 0).when(F.col("x0") >= F.col("middle"), 1).otherwise(0)})
    return j.withColumn("read_order", F.row_number().over(page.orderBy("section", "side", "y0", "seq")).cast("long")).drop("anchor", "above", "section", "side", "middle")


def callout_boxes(blocks: DataFrame, colour: str = "colour") -> DataFrame:
    """Adds box: runs of neighbouring blocks of one colour on a page are one numbered box; null colours are in none."""
    doc = Window.partitionBy("doc_id", "page_num").orderBy("seq")
    new = F.when(F.col(colour).isNotNull() & ~F.coalesce(F.lag(colour).over(doc) == F.col(colour), F.lit(False)), 1).otherwise(0)
    b = blocks.withColumn("new", new).withColumn("n", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    return b.withColumn("box", F.when(F.col(colour).isNotNull(), F.format_string("box_p%d_%03d", F.col("page_num"), F.col("n")))).drop("new", "n")


def covered_blocks(blocks: DataFrame, rects: DataFrame, least: float = 0.85) -> DataFrame:
    """Drops blocks that a rectangle (rx0, ry0, rx1, ry1) of their page hides; a join on the page, with the overlap as condition."""
    w = F.least("x1", "rx1") - F.greatest("x0", "rx0")
    h = F.least("y1", "ry1") - F.greatest("y0", "ry0")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    hidden = blocks.join(rects, ["doc_id", "page_num"]).where((w > 0) & (h > 0) & (area > 0) & (w * h > least * area)).select("doc_id", "seq").distinct()
    return blocks.join(hidden, ["doc_id", "seq"], "left_anti")


def page_audit(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, page_num, verdict) from characters of each page in the source and in the extract: (doc_id, page_num, chars)."""
    e, f = expected.select("doc_id", "page_num", F.col("chars").alias("e")), found.select("doc_id", "page_num", F.col("chars").alias("f"))
    j = e.join(f, ["doc_id", "page_num"], "full").withColumns({"e": F.coalesce("e", F.lit(0)), "f": F.coalesce("f", F.lit(0))})
    verdict = F.when(F.col("e") < 30, "BLANK_IN_PDF").when(F.col("f") == 0, "MISSED").when((F.col("f") < 30) & (F.col("e") > 60), "PARTIAL").otherwise("OK")
    return j.select("doc_id", "page_num", verdict.alias("verdict"))


def patch_pages(blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """blocks, with every page that patches has replaced by that of patches."""
    return blocks.join(patches.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_anti").unionByName(patches)


#: What a list item begins with.
LIST_STARTS = ["•", "-", "*", "1.", "2.", "3.", "4.", "5.", "(a)", "(b)", "(i)"]


def reextracted(found: DataFrame) -> DataFrame:
    """(doc_id, page_num, block_id, type, text, y0) of raw blocks (doc_id, page_num, b_idx, text, y0) of pages that are extracted again; blank ones are left out."""
    text = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    line = ~F.col("text").rlike(r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]") & (F.length("text") < 80) & ~F.col("text").endswith(".")
    item = F.exists(F.array(*map(F.lit, LIST_STARTS)), lambda p: F.startswith(F.col("text"), p))
    f = found.withColumn("text", text).where("text <> ''")
    return f.select("doc_id", "page_num", F.format_string("blk_re_p%d_%04d", F.col("page_num").cast("int"), F.col("b_idx").cast("int")).alias("block_id"), F.when(line, "heading").when(item, "list_item").otherwise("paragraph").alias("type"), "text", "y0")


def with_reextracted(blocks: DataFrame, found: DataFrame, partial: DataFrame) -> DataFrame:
    """blocks (doc_id, seq, page_num, block_id, type, text, y0) with the pages that were extracted again, and each block's place in its document by page and height.

    partial: (doc_id, page_num) of pages whose old blocks go; a document for which nothing new is found stays as it is. Of blocks at one height the old ones come first, in their order.
    """
    new = reextracted(found)
    gone = partial.select("doc_id", "page_num").distinct().join(new.select("doc_id").distinct(), "doc_id", "left_semi")
    columns = ["doc_id", "page_num", "block_id", "type", "text", "y0"]
    kept = blocks.join(gone, ["doc_id", "page_num"], "left_anti").select(*columns, F.lit(0).alias("kind"), F.format_string("%020d", "seq").alias("at"))
    every = kept.unionByName(new.select(*columns, F.lit(1).alias("kind"), F.col("block_id").alias("at")))
    order = Window.partitionBy("doc_id").orderBy("page_num", F.coalesce("y0", F.lit(0.0)), "kind", "at")
    return every.withColumn("place", F.row_number().over(order).cast("long")).drop("kind", "at")


def approximate_boxes(blocks: DataFrame) -> DataFrame:
    """Flags boxes that only stand for the whole page."""
    box = F.array("x0", "y0", "x1", "y1")
    return blocks.withColumn("bbox_approximate", F.array_contains(F.array(*[F.array(*map(F.lit, b)) for b in FULL_PAGE]), box))


def rejoin_captions(blocks: DataFrame) -> DataFrame:
    """Joins a caption with the next one on its page if it doesn't end a sentence; the second is used up, so it can't start a pair.

    Pairs alternate within a chain of captions that could each be joined to the next: odd places of the chain start pairs.
    """
    doc = Window.partitionBy("doc_id").orderBy("seq")
    nxt = lambda c: F.lead(c).over(doc)
    joins = (F.col("type") == "caption") & (nxt("type") == "caption") & (nxt("page_num") == F.col("page_num")) & ~F.col("text").rlike(r"[.?!]$")
    b = blocks.withColumns({"joins": F.coalesce(joins, F.lit(False)), "after": nxt("text")})
    b = b.withColumn("chain", F.sum(F.when(F.coalesce(F.lag("joins").over(doc), F.lit(False)), 0).otherwise(1)).over(doc))
    b = b.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("seq")))
    used = F.col("place") % 2 == 0
    text = F.when(F.col("joins") & ~used, F.concat_ws(" ", "text", "after")).otherwise(F.col("text"))
    return b.where(~used).withColumn("text", text).drop("joins", "after", "chain", "place")


def merge_split_sentences(blocks: DataFrame) -> DataFrame:
    """Joins a paragraph without an end with the next block that is no boilerplate, if that is a paragraph of the next page that doesn't start in upper case; a joined one starts no new pair."""
    doc = Window.partitionBy("doc_id").orderBy("seq")
    body = blocks.where("NOT is_boilerplate")
    nxt = lambda c: F.lead(c).over(doc)
    ends = F.col("text").rlike("[.!?:\u2019\"'\u201d]\\s*$")
    after = F.regexp_replace(nxt("text"), r"\A\s+", "")
    joins = (F.col("type") == "paragraph") & (nxt("type") == "paragraph") & (nxt("page_num") == F.col("page_num") + 1) & (F.trim("text") != "") & ~ends & (after != "") & ~after.rlike("^[A-Z\u2018\u201c]")
    b = body.withColumns({"joins": F.coalesce(joins, F.lit(False)), "after": after})
    b = b.withColumn("chain", F.sum(F.when(F.coalesce(F.lag("joins").over(doc), F.lit(False)), 0).otherwise(1)).over(doc))
    b = b.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "chain").orderBy("seq")))
    used = F.col("place") % 2 == 0
    text = F.when(F.col("joins") & ~used, F.concat(F.regexp_replace("text", r"\s+\z", ""), F.lit(" "), F.col("after"))).otherwise(F.col("text"))
    return b.where(~used).withColumn("text", text).drop("joins", "after", "chain", "place").unionByName(blocks.where("is_boilerplate"))


def near_duplicate_blocks(blocks: DataFrame, least: float = 0.85, min_words: int = 8) -> DataFrame:
    """Drops the shorter of two near-equal blocks of a page (the later one of equals): word sets with a Jaccard similarity of ``least``, lengths within half of the longer one.

    Blocks are tried in order; each takes its first match that isn't dropped yet, and a dropped one drops no other: a fold over the page's similar pairs.
    """
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("text"), r"[\x21-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7E]", ""), WS, " "))
    b = blocks.select("doc_id", "page_num", "seq", F.length("text").alias("n"), norm.alias("t")).withColumns({"w": F.array_distinct(split_words(F.col("t"))), "k": F.size(split_words(F.col("t"))), "m": F.length("t")})
    one = b.where(F.col("k") >= min_words)
    two = b.select("doc_id", "page_num", F.col("seq").alias("seq2"), F.col("n").alias("n2"), F.col("w").alias("v"), F.col("m").alias("m2"))
    both = F.size(F.array_intersect("w", "v"))
    union = F.size("w") + F.size("v") - both
    pairs = one.join(two, ["doc_id", "page_num"]).where((F.col("seq") < F.col("seq2")) & (F.abs(F.col("m") - F.col("m2")) <= 0.5 * F.greatest("m", "m2")) & (both >= least * union))
    listed = pairs.groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("seq", "seq2", (F.col("n") >= F.col("n2")).alias("first")))).alias("ps"))
    none = F.array().cast("array<bigint>")

    def step(a: Column, p: Column) -> Column:
        skip = F.array_contains(a["gone"], p["seq"]) | F.array_contains(a["done"], p["seq"]) | F.array_contains(a["gone"], p["seq2"])
        shorter = F.when(p["first"], p["seq2"]).otherwise(p["seq"])
        return F.when(skip, a).otherwise(F.struct(F.array_append(a["gone"], shorter).alias("gone"), F.array_append(a["done"], p["seq"]).alias("done")))

    gone = listed.select("doc_id", F.explode(F.aggregate("ps", F.struct(none.alias("gone"), none.alias("done")), step, lambda a: a["gone"])).alias("seq"))
    return blocks.join(gone, ["doc_id", "seq"], "left_anti")


#: Fixed value: headings that aren't cells of a broken table.
NO_CELL = r"(?i)^(anthropology|formation of new population and species|[0-9]{1,3})$"


def shredded_tables(blocks: DataFrame, least: int = 15) -> DataFrame:
    """(doc_id, page_num, text): pages with ``least`` headings, one of them numbered, are broken tables: their headings in one text, from the top down, without running headers."""
    h = blocks.where("type = 'heading'").withColumn("t", F.trim("text"))
    cells = F.collect_list(F.when((F.col("t") != "") & ~F.col("t").rlike(NO_CELL), F.struct((-F.col("y0")).alias("up"), "x0", "seq", "t")))
    order = F.transform(F.sort_array(cells), lambda x: x["t"])
    return h.groupBy("doc_id", "page_num").agg(F.count("*").alias("n"), F.bool_or(F.col("t").rlike(r"^[0-9]+\.\s")).alias("numbered"), F.array_join(order, "\n").alias("text")).where((F.col("n") >= least) & F.col("numbered")).drop("n", "numbered")


def merge_shredded(blocks: DataFrame, **kw) -> DataFrame:
    """(doc_id, page_num, place, type, text): blocks with the headings of broken tables replaced by one fragment, before all else on its page."""
    t = shredded_tables(blocks, **kw)
    gone = t.select("doc_id", "page_num").withColumn("type", F.lit("heading"))
    left = blocks.join(gone, ["doc_id", "page_num", "type"], "left_anti").select("doc_id", "page_num", F.lit(1).alias("kind"), "seq", "type", "text")
    both = left.unionByName(t.select("doc_id", "page_num", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), F.lit("table_fragment").alias("type"), "text"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "kind", "seq"))
    return both.select("doc_id", "page_num", place.cast("long").alias("place"), "type", "text")


def highlight(r: Column, g: Column, b: Column, white: int = 230) -> Column:
    """The callout that a background colour stands for; null for white and for other colours."""
    return (
        F.when((r >= white) & (g >= white) & (b >= white), None)
        .when((r > 200) & (b > 150) & (r - g > 20) & (b - g > 10), "pink_callout")
        .when((r > 200) & (g > 180) & (b < 150) & (r - b > 60), "yellow_callout")
        .when((b > 180) & (b - r > 30) & (b - g > 20), "blue_callout")
    )


#: Lines of a collapsed page that are its header.
HEADER_PHRASES = [
    "social science - part i",
    "social science - part 1",
    "social science part 1",
    "social science part i",
    "india's struggle for independence",
    "the heritage of india",
]
#: Lines of a collapsed page that are headings.
HEADINGS = [
    r"(?i)^\s*chapter\s+\d+",
    r"(?i)^\s*exercises\s*$",
    r"(?i)^\s*things\s+to\s+know\b",
    r"(?i)^\s*india['’]?s\s+struggle\s+for\s+independence\b",
    r"(?i)^\s*revolt\s+of\s+1857\b",
    r"(?i)^\s*rise\s+of\s+indian\s+nationalism\b",
    r"(?i)^\s*indian\s+national\s+congress\b",
    r"(?i)^\s*boycott\s+and\s+swadeshi\b",
    r"(?i)^\s*morley[- ]minto\b",
    r"(?i)^\s*khilafat\b",
    r"(?i)^\s*non[- ]cooperation\b",
    r"(?i)^\s*civil\s+disobedience\b",
    r"(?i)^\s*quit\s+india\b",
    r"(?i)^\s*the\s+medieval\s+period\b",
    r"(?i)^\s*languages?\s+and\s+literature\b",
    r"(?i)^\s*architecture\b",
    r"(?i)^\s*cave\s*architecture\b",
    r"(?i)^\s*the\s+heritage\s+of\s+india\b",
]
LIST_ITEM = r"(?i)^\s*(\d+[\.\)]|[a-z][\.\)]|[•\-➢])\s+"
#: Handwritten headings that recognition breaks, and what they say.
STYLISED = [
    (r"(?i)\bLet['’]s\s+recal\s*l\b", "Let's recall"),
    (r"(?i)\bLet['’]s\s+imagin\s*e\b", "Let's imagine"),
    (r"(?i)\bLet['’]s\s+(?:discus\s*s|di\s*scus\s*s)\b", "Let's discuss"),
    (r"(?i)\bLet['’]s\s+d\s*o\b", "Let's do"),
]
#: Fixed value: how exam questions begin.
QUESTION = r"(?i)^(Q[.\t\s]|PREVIOUS YEAR QUESTION|With reference|Consider the following|Which (of|one|among)|How many|What (is|are|was|were)|\([a-d]\)\s)"


def split_collapsed(blocks: DataFrame, most: int = 400) -> DataFrame:
    """Parts paragraphs of more than ``most`` characters with line ends: headers, page numbers, headings and list items each become a block, in order, and then all other lines one paragraph. Adds part, the place within the old block."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    kind = lambda x: F.when(F.lower(x).isin(HEADER_PHRASES), "header").when(x.rlike(r"^[0-9]{1,3}$"), "footer").when(x.rlike("|".join(f"(?:{p})" for p in HEADINGS)), "heading").when(x.rlike(LIST_ITEM), "list_item")
    typed = F.transform(lines, lambda x: F.struct(kind(x).alias("type"), x.alias("text")))
    rest = F.array_join(F.transform(F.filter("typed", lambda x: x["type"].isNull()), lambda x: x["text"]), " ")
    para = F.when(rest != "", F.array(F.struct(F.lit("paragraph").alias("type"), rest.alias("text")))).otherwise(F.array().cast("array<struct<type:string,text:string>>"))
    collapsed = (F.col("type") == "paragraph") & (F.length("text") > most) & F.contains("text", F.lit("\n"))
    b = blocks.withColumn("typed", F.when(collapsed, typed))
    parts = F.when(F.col("typed").isNotNull(), F.concat(F.filter("typed", lambda x: x["type"].isNotNull()), para)).otherwise(F.array(F.struct("type", "text")))
    return b.select(*[c for c in blocks.columns if c not in ("type", "text")], F.posexplode(parts).alias("part", "x")).select("*", "x.type", "x.text").drop("x")


def repair_stylised(blocks: DataFrame) -> DataFrame:
    """Mends handwritten headings; a paragraph with one is a heading."""
    hit = F.col("text").rlike("|".join(f"(?:{p})" for p, _ in STYLISED))
    text = F.col("text")
    for p, said in STYLISED:
        text = F.regexp_replace(text, p, said)
    b = blocks.withColumn("hit", hit).withColumn("text", F.when(F.col("hit"), text).otherwise(F.col("text")))
    return b.withColumn("type", F.when(F.col("hit") & (F.col("type") == "paragraph"), "heading").otherwise(F.col("type"))).drop("hit")


def reading_order(blocks: DataFrame, band: float = 6.0) -> DataFrame:
    """Adds read_order within a page, high y first. Blocks on one line (y within a band) go from left to right; a page with two columns goes header, left, right, footer; blocks without a box come last."""
    page = Window.partitionBy("doc_id", "page_num")
    boxed = F.col("x0").isNotNull() & F.col("y0").isNotNull() & F.col("x1").isNotNull() & F.col("y1").isNotNull()
    b = blocks.withColumns({"boxed": boxed, "lo": F.min(F.when(boxed, F.col("x0"))).over(page), "hi": F.max(F.when(boxed, F.col("x1"))).over(page)})
    b = b.withColumn("width", F.greatest(F.col("hi") - F.col("lo"), F.lit(100.0)))
    b = b.withColumns({"left": (F.col("x0") + F.col("x1")) / 2 < F.col("lo") + F.col("width") / 2, "narrow": F.col("boxed") & ((F.col("x1") - F.col("x0")) / F.col("width") < 0.5)})
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(page)
    b = b.withColumns({"nl": n(F.col("narrow") & F.col("left")), "nr": n(F.col("narrow") & ~F.col("left")), "nb": n(F.col("boxed"))})
    two = (F.col("nl") >= 4) & (F.col("nr") >= 4) & ((F.col("nl") + F.col("nr")) / F.greatest("nb", F.lit(1)) > 0.6)
    part = F.when(~F.col("boxed"), 9).when(~two, 0).when(F.col("type") == "header", 0).when(F.col("type") == "footer", 3).when(F.col("left"), 1).otherwise(2)
    b = b.withColumns({"part": part, "up": F.when(F.col("boxed"), -F.bround(F.col("y0") / band)), "x": F.when(F.col("boxed"), F.col("x0"))})
    order = F.row_number().over(page.orderBy("part", "up", "x", "seq"))
    return b.withColumn("read_order", order.cast("long")).select(*blocks.columns, "read_order")


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def drop_recent_repeats(blocks: DataFrame, window: int = 10, chars: int = 120) -> DataFrame:
    """Drops a block whose fingerprint (compatibility form, one blank for white space, lower case, ``chars`` characters) is among the last ``window`` that the page kept: a fold over the page's blocks in order."""
    text = F.coalesce("text", F.lit(""))
    plain = F.when(text.rlike(r"[^\x00-\x7F]"), _composed(text)).otherwise(text)
    mark = F.substring(F.lower(F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))), 1, chars)
    pages = blocks.select("doc_id", "page_num", "seq", F.md5(mark).alias("mark")).groupBy("doc_id", "page_num").agg(F.sort_array(F.collect_list(F.struct("seq", "mark"))).alias("bs"))
    start = F.struct(F.array().cast("array<string>").alias("last"), F.array().cast("array<bigint>").alias("gone"))

    def step(a: Column, x: Column) -> Column:
        more = F.array_append(a["last"], x["mark"])
        kept = F.when(F.size(more) > window, F.slice(more, 2, window)).otherwise(more)
        return F.when(F.array_contains(a["last"], x["mark"]), F.struct(a["last"].alias("last"), F.array_append(a["gone"], x["seq"]).alias("gone"))).otherwise(F.struct(kept.alias("last"), a["gone"].alias("gone")))

    gone = pages.select("doc_id", "page_num", F.explode(F.aggregate("bs", start, step, lambda a: a["gone"])).alias("seq"))
    return blocks.join(gone, ["doc_id", "page_num", "seq"], "left_anti")


def rescue_questions(blocks: DataFrame) -> DataFrame:
    """Footers taken for boilerplate that begin like an exam question are questions."""
    t = F.trim("text")
    hit = F.col("is_boilerplate") & (F.col("type") == "footer") & (t != "") & t.rlike(QUESTION)
    b = blocks.withColumn("was_corrected", hit)
    return b.withColumns({"type": F.when(hit, "pyq_question").otherwise(F.col("type")), "is_boilerplate": F.col("is_boilerplate") & ~hit})


def drop_false_blanks(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Drops blank-page markers of pages that have a table (doc_id, page_num)."""
    full = tables.where("page_num IS NOT NULL").select("doc_id", "page_num").distinct().withColumn("full", F.lit(True))
    return blocks.join(full, ["doc_id", "page_num"], "left").where((F.col("type") != "blank_page") | F.col("full").isNull()).drop("full")


#: Fixed value: how list items begin.
LIST_PREFIX = r"^(z |\? |\([a-d]\)\s|\d+\.\s|[•\-➢]\s)"


def restructured_pages(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """blocks, with each page that spans give at least two blocks for replaced by these.

    spans: (doc_id, page_num, blk, at, text, size, y0, page_height). A block is its spans in order; its kind follows from its height on the page, its largest letters, and how it begins; blocks of one character drop out.
    """
    said = F.transform(F.sort_array(F.collect_list(F.struct("at", F.trim("text").alias("t")))), lambda x: x["t"])
    b = spans.where(F.trim("text") != "").groupBy("doc_id", "page_num", "blk").agg(F.array_join(said, " ").alias("text"), F.max("size").alias("size"), F.min("y0").alias("y0"), F.max("page_height").alias("h")).where(F.length("text") >= 2)
    kind = F.when(F.col("y0") > F.col("h") * 0.93, "footer").when(F.col("y0") < F.col("h") * 0.07, "header").when((F.col("size") >= 11.0) & (F.length("text") < 120), "heading").when(F.col("text").rlike(LIST_PREFIX), "list_item").otherwise("paragraph")
    page = Window.partitionBy("doc_id", "page_num")
    b = b.withColumns({"type": kind, "n": F.count("*").over(page)}).where("n > 1")
    no = F.row_number().over(page.orderBy("blk"))
    b = b.select("doc_id", "page_num", F.format_string("blk_dict_p%04d_%03d", "page_num", no).alias("block_id"), "type", "text", F.col("type").isin("footer", "header").alias("is_boilerplate"))
    return blocks.join(b.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_anti").select(b.columns).unionByName(b)
