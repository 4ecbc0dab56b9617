"""Tables as (doc_id, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>), one row each, and what becomes of broken ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that name nothing.
GENERIC_HEADERS = ["column_1", "column_2", "column_3", "column_4", "column_5", "column_6", "column_7", "column_8", "list?", "s/no", "s.no", "sno", ""]
S = r"[ \t\n\x0b\f\r]+"


def _filled(row: Column) -> Column:
    return F.filter(F.transform(row, lambda c: F.trim(c)), lambda c: c != "")


def contents_like(rows: Column) -> Column:
    """More than half of the rows have dot leaders, or more than 40 % repeat a cell."""
    n = F.size(rows)
    dots = F.size(F.filter(rows, lambda r: F.array_join(r, " ").rlike(r"\.{4,}")))
    twice = F.size(F.filter(rows, lambda r: F.size(F.array_distinct(_filled(r))) < F.size(_filled(r))))
    return F.coalesce((n > 0) & ((dots / n > 0.5) | (twice / n > 0.4)), F.lit(False))


def degenerate(headers: Column, rows: Column) -> Column:
    """Why a table is none: empty, single_cell, generic_headers, sparse_rows; null for a sound one."""
    n, k = F.size(rows), F.size(headers)
    generic = (k > 0) & F.forall(headers, lambda h: F.lower(F.trim(h)).isin(GENERIC_HEADERS))
    sparse = F.size(F.filter(rows, lambda r: F.size(_filled(r)) <= 1))
    return F.when((n == 0) | (k == 0), "empty").when((n <= 1) & (k <= 1), "single_cell").when(generic, "generic_headers").when(sparse / n > 0.4, "sparse_rows")


def repair_headers(headers: Column) -> Column:
    """Headers that are all the same become Field and Value, or Column_1, Column_2 ..."""
    same = (F.size(headers) > 1) & (F.size(F.array_distinct(F.transform(headers, lambda h: F.lower(F.trim(h))))) == 1)
    return F.when(same & (F.size(headers) == 2), F.array(F.lit("Field"), F.lit("Value"))).when(same, F.transform(headers, lambda _, i: F.concat(F.lit("Column_"), (i + 1).cast("string")))).otherwise(headers)


def merge_phantom_column(tables: DataFrame) -> DataFrame:
    """The first inner column whose cells have two words at most is a wrapped word: it moves before the last word of the cell to its left. Rows that don't reach it stay."""
    count = lambda c: F.size(F.array_remove(F.split(F.trim(c), S), ""))
    k = F.size("headers")
    inner = F.when((k >= 3) & (F.size("rows") >= 2), F.sequence(F.lit(1), k - 2)).otherwise(F.array().cast("array<int>"))
    short = F.filter(inner, lambda i: F.exists("rows", lambda r: F.size(r) > i) & F.forall("rows", lambda r: (F.size(r) <= i) | (count(F.get(r, i)) <= 2)))
    t = tables.withColumn("at", F.get(short, 0))
    at = F.col("at")

    def moved(r: Column) -> Column:
        part, left = F.trim(F.get(r, at)), F.trim(F.get(r, at - 1))
        ws = F.array_remove(F.split(left, S), "")
        joined = F.when(F.size(ws) > 1, F.concat_ws(" ", F.array_join(F.slice(ws, 1, F.size(ws) - 1), " "), part, F.element_at(ws, -1))).otherwise(F.trim(F.concat_ws(" ", part, left)))
        cell = F.when(part == "", F.get(r, at - 1)).otherwise(joined)
        return F.when(F.size(r) > at, F.concat(F.slice(r, 1, at - 1), F.array(cell), F.slice(r, at + 2, F.size(r)))).otherwise(r)

    cut = F.concat(F.slice("headers", 1, at), F.slice("headers", at + 2, k))
    return t.withColumns({"rows": F.when(at.isNotNull(), F.transform("rows", moved)).otherwise(F.col("rows")), "headers": F.when(at.isNotNull(), cut).otherwise(F.col("headers"))}).drop("at")


def row_texts(tables: DataFrame, caption: Column | None = None) -> DataFrame:
    """(doc_id, block_id, text): a sentence for each row, "Table (caption): header: cell | ..."; a missing header is Column_k."""
    head = F.lit("Table: ") if caption is None else F.when(caption != "", F.concat(F.lit("Table ("), caption, F.lit("): "))).otherwise("Table: ")
    t = tables.select("doc_id", "headers", head.alias("head"), F.posexplode("rows").alias("i", "row"))
    cell = lambda c, k: F.concat(F.coalesce(F.get("headers", k), F.concat(F.lit("Column_"), (k + 1).cast("string"))), F.lit(": "), F.trim(c))
    return t.select("doc_id", F.format_string("tbl_%d_row_%d", "doc_id", F.col("i") + 1).alias("block_id"), F.concat("head", F.array_join(F.transform("row", cell), " | ")).alias("text"))


def _unsaid(tables: DataFrame, blocks: DataFrame, cells) -> DataFrame:
    """(doc_id, row_no, text): the tables' rows as text, where no block of the document says the same; equal ones once."""
    mark = lambda c: F.lower(F.trim(F.regexp_replace(c, S, " ")))
    rows = tables.select("doc_id", F.posexplode("rows").alias("i", "row")).select("doc_id", (F.col("i") + 1).cast("long").alias("row_no"), F.trim(F.array_join(cells(F.col("row")), " ")).alias("text")).where("text <> ''").withColumn("mark", mark(F.col("text")))
    known = blocks.select("doc_id", mark(F.col("text")).alias("mark")).distinct()
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("row_no"))).where("n = 1")
    return first.join(known, ["doc_id", "mark"], "left_anti").select("doc_id", "row_no", "text")


def rescued_rows(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, row_no, text): rows of contents-like tables as text, unless the document already says it; equal ones once."""
    return _unsaid(tables.where(contents_like(F.col("rows"))), blocks, _filled)


def label_values(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_num, label_seq, value_seq, text): short blocks with the block beside them that belongs to them.

    A join within the page: the value has three words or more, starts from 15 points before to 150 points after the label's right edge
    and overlaps it in height by more than 45 %. A label takes the one with the most overlap (the first of equals); a value goes to its first label.
    """
    n = F.size(F.array_remove(F.split(F.trim("text"), S), ""))
    b = blocks.where(~F.col("type").isin("diagram", "table_row", "table_fragment", "blank_page") & F.col("x0").isNotNull() & (F.trim("text") != "")).withColumns({"n": n, "lo": F.least("y0", "y1"), "hi": F.greatest("y0", "y1")}).where("hi > lo")
    label = b.where("n <= 4").select("doc_id", "page_num", F.col("seq").alias("label_seq"), F.trim("text").alias("label"), F.col("x1").alias("right"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
    value = b.where("n >= 3").select("doc_id", "page_num", F.col("seq").alias("value_seq"), F.trim("text").alias("value"), F.col("x0").alias("left"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    ratio = F.greatest(F.lit(0.0), F.least("hi1", "hi2") - F.greatest("lo1", "lo2")) / F.least(F.col("hi1") - F.col("lo1"), F.col("hi2") - F.col("lo2"))
    j = label.join(value, ["doc_id", "page_num"]).where((F.col("label_seq") != F.col("value_seq")) & (F.col("left") >= F.col("right") - 15) & (F.col("left") <= F.col("right") + 150)).withColumn("ratio", ratio).where("ratio > 0.45")
    best = j.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page_num", "label_seq").orderBy(F.desc("ratio"), "value_seq"))).where("k = 1")
    own = best.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "page_num", "value_seq").orderBy("label_seq"))).where("k = 1")
    return own.select("doc_id", "page_num", "label_seq", "value_seq", F.concat("label", F.lit(": "), "value").alias("text"))


def blob_lines(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_id, text): a collapsed paragraph line by line; one of a single line stays one block."""
    ls = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    b = blocks.select("doc_id", "block_id", ls.alias("ls"), F.trim("text").alias("t"))
    many = b.where(F.size("ls") > 1).select("doc_id", "block_id", F.posexplode("ls").alias("i", "text")).select("doc_id", F.format_string("%s_line_%d", "block_id", F.col("i") + 1).alias("block_id"), "text")
    return many.unionByName(b.where(F.size("ls") <= 1).select("doc_id", "block_id", F.col("t").alias("text")))


def split_diagram(text: Column, mark: str = "---SUMMARY---") -> Column:
    """struct(code, summary) of a diagram block: what stands before and after the mark; without it a fenced block and what follows; without that all is summary."""
    at, fence = F.locate(mark, text), r"(?is)```mermaid.*?```"
    parts = lambda code, summary: F.struct(F.trim(code).alias("code"), F.trim(summary).alias("summary"))
    marked = parts(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(mark), F.length(text)))
    fenced = parts(F.regexp_extract(text, fence, 0), F.regexp_extract(text, fence + "(.*)", 1))
    return F.when(at > 0, marked).when(text.rlike(fence), fenced).otherwise(parts(F.lit(""), text))


#: Entity labels with their patterns, in order of priority.
ENTITIES = [
    ("CONSTITUTIONAL_ARTICLE", r"(?i)\b(article|art\.)\s+\d+[a-z]?(\(\d+\))?|\b\d+(st|nd|rd|th)\s+constitutional\s+amendment(\s+act)?\b"),
    ("ACT_POLICY", r"(?i)\b([a-z\s]+)\s+act,?\s+\d{4}\b|\b([a-z\s]+)\s+policy,?\s+\d{4}\b|\bcode\s+of\s+[a-z\s]+\d{4}\b"),
    ("GOVT_BODY", r"(?i)\b(niti\s+aayog|election\s+commission|finance\s+commission|upsc|spsc|cag|law\s+commission|national\s+green\s+tribunal|ngt|supreme\s+court|high\s+court|rbi|reserve\b[a-z\s]*bank)\b"),
    ("SCHEME", r"(?i)\b(pm-?[a-z]+|mgnrega|ayushman\s+bharat|poshan\s+abhiyaan|swachh\s+bharat|make\s+in\s+india|digital\s+india|atmanirbhar\s+bharat)\b"),
    ("HISTORICAL_EVENT", r"(?i)\b(battle\s+of\s+[a-z]+|quit\s+india\s+movement|non-?cooperation\s+movement|civil\s+disobedience\s+movement|swadeshi\s+movement|treaty\s+of\s+[a-z]+|revolt\s+of\s+1857|sepoy\s+mutiny)\b"),
    ("DATE_YEAR", r"\b(1[0-9]{3}|20[0-2][0-9])\b|\b\d{1,2}(st|nd|rd|th)?\s+(january|february|march|april|may|june|july|august|september|october|november|december)\s+\d{4}\b"),
]
#: What a text must hold for a label's pattern to be tried, where that pattern is slow on long texts.
NEEDED = {"ACT_POLICY": r"(?i)\s(act|policy),?\s+\d{4}\b|\bcode\s+of\s"}
SPAN = "array<struct<start:int,end:int,label:string,text:string>>"


def _matches(text: Column, label: str, pattern: str) -> Column:
    """Spans of a pattern's matches: what lies between them gives their places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern)
    pairs = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("p"))
    start = F.struct(F.array().cast(SPAN).alias("spans"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        begin = a["at"] + F.length(x["p"])
        end = begin + F.length(x["m"])
        span = F.struct(begin.alias("start"), end.alias("end"), F.lit(label).alias("label"), F.trim(x["m"]).alias("text"))
        return F.struct(F.array_append(a["spans"], span).alias("spans"), end.alias("at"))

    tried = text.rlike(NEEDED[label]) if label in NEEDED else text.rlike(pattern)
    return F.when(tried, F.aggregate(pairs, start, step, lambda a: a["spans"])).otherwise(F.array().cast(SPAN))


def entities(text: Column) -> Column:
    """Entities of a text by place, as struct(start, end, label, text). Of overlapping ones that of the earlier label counts, and of one label the first."""
    every = F.concat(*[_matches(text, k, p) for k, p in ENTITIES])
    free = lambda a, s: ~F.exists(a, lambda x: (s["start"] < x["end"]) & (x["start"] < s["end"]))
    kept = F.aggregate(every, F.array().cast(SPAN), lambda a, s: F.when(free(a, s), F.array_append(a, s)).otherwise(a))
    return F.array_sort(kept)


def entity_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, label, n): entities of each label over a document's blocks."""
    return blocks.select("doc_id", F.explode(entities(F.coalesce("text", F.lit("")))).alias("e")).groupBy("doc_id", "e.label").agg(F.count("*").alias("n"))


def triaged_tables(tables: DataFrame) -> DataFrame:
    """Adds needs_review, without empty tables and single cells; generic headers and sparse rows stay, to be reviewed."""
    t = tables.withColumn("reason", degenerate(F.col("headers"), F.col("rows")))
    return t.where("reason IS NULL OR reason NOT IN ('empty', 'single_cell')").withColumn("needs_review", F.col("reason").isNotNull()).drop("reason")


def rescued_cells(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, row_no, type, text): rows of the tables that triage drops as list items, unless the document already says it; equal ones once."""
    lost = tables.where(degenerate(F.col("headers"), F.col("rows")).isin("empty", "single_cell"))
    return _unsaid(lost, blocks, _filled).withColumn("type", F.lit("list_item"))


def normalised(docs: DataFrame) -> DataFrame:
    """(doc_id, page_num, kind, text) of documents in either form: flat blocks, or blocks within pages (which then give the page). docs: (doc_id, text_blocks, pages)."""
    flat = docs.select("doc_id", F.posexplode("text_blocks").alias("i", "b")).select("doc_id", F.lit(0).alias("j"), "i", F.coalesce("b.page_num", F.lit(1)).cast("long").alias("page_num"), "b.type", "b.text")
    paged = docs.select("doc_id", F.posexplode("pages").alias("j", "p")).select("doc_id", "j", F.col("p.page_num").alias("n"), F.posexplode("p.text_blocks").alias("i", "b"))
    paged = paged.select("doc_id", "j", "i", F.coalesce("n", F.col("j") + 1).cast("long").alias("page_num"), "b.type", "b.text")
    return flat.unionByName(paged)


#: Running headers that tables take in, and rows that cite the table's source.
TABLE_BOILERPLATE = [r"(?i)india:\s*6\s*th\s*century\s*bce\s*to\s*200\s*bce", r"(?i)^\s*page\s+nos?\.\s*$", r"(?i)^\s*bhic-101\s*$"]
CITATION_ROW = r"(?i)^\s*\(.*?(?:Kumar|MHI|Block|Unit|p\.\s*\d+|Press|Edition|ISBN|Source|Adapted).*?\)\s*$"


def repaired_export(tables: DataFrame) -> DataFrame:
    """Repairs exported tables (headers, rows, caption): placeholders, numbers for headers, a first column of running headers, and rows that cite a source, which go to the caption."""
    held = lambda c: F.contains(c, F.lit("<!--"))
    t = tables.withColumns({"headers": F.transform("headers", lambda h, i: F.when(held(h), F.concat(F.lit("Col_"), (i + 1).cast("string"))).otherwise(h)), "rows": F.transform("rows", lambda r: F.transform(r, lambda c: F.when(held(c), "").otherwise(c)))})
    numbers = (F.size("headers") > 0) & F.forall("headers", lambda h: h.rlike("^[0-9]+$"))
    named = F.when(F.size("headers") == 2, F.array(F.lit("Section / Unit"), F.lit("Page Number"))).otherwise(F.transform("headers", lambda h: F.concat(F.lit("Column_"), (h.cast("int") + 1).cast("string"))))
    t = t.withColumn("headers", F.when(numbers, named).otherwise(F.col("headers")))
    first = lambda r: F.trim(F.coalesce(F.get(r, 0), F.lit("")))
    phantom = (F.size("headers") > 0) & (F.size("rows") > 0) & F.forall("rows", lambda r: (first(r) == "") | first(r).rlike("|".join(f"(?:{p})" for p in TABLE_BOILERPLATE)))
    t = t.withColumn("phantom", phantom)
    cut = F.transform(F.filter("rows", lambda r: F.size(r) > 1), lambda r: F.slice(r, 2, F.size(r)))
    t = t.withColumns({"headers": F.when(F.col("phantom"), F.slice("headers", 2, F.greatest(F.size("headers"), F.lit(1)))).otherwise(F.col("headers")), "rows": F.when(F.col("phantom"), cut).otherwise(F.col("rows"))})
    said = lambda r: F.array_join(_filled(r), " ")
    cites = F.transform(F.filter("rows", lambda r: said(r).rlike(CITATION_ROW)), said)
    t = t.withColumns({"cites": cites, "rows": F.filter("rows", lambda r: ~said(r).rlike(CITATION_ROW))})
    more = F.array_join(F.transform("cites", lambda c: F.concat(F.lit("("), c, F.lit(")"))), " ")
    later = F.array_join(F.transform(F.slice("cites", 2, F.size("cites") + 1), lambda c: F.concat(F.lit("("), c, F.lit(")"))), " ")
    caption = F.when(F.size("cites") == 0, F.col("caption")).when(F.col("caption") != "", F.concat_ws(" ", "caption", more)).when(F.size("cites") == 1, F.col("cites")[0]).otherwise(F.concat_ws(" ", F.col("cites")[0], later))
    return t.withColumn("caption", caption).drop("phantom", "cites")


def merged_page_rows(blocks: DataFrame, rows: DataFrame) -> DataFrame:
    """Blocks and table rows of a document by page, adding place: on a page blocks come first, each kind in its order. Both: (doc_id, page_num, seq, text)."""
    both = blocks.select("doc_id", "page_num", F.lit(0).alias("kind"), "seq", "text").unionByName(rows.select("doc_id", "page_num", F.lit(1).alias("kind"), "seq", "text"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num", "kind", "seq")).cast("long"))
