"""Tagging boilerplate blocks: an ordered ladder of patterns and margins, lines that repeat over pages, contents pages, inline watermarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of each kind, in order of trial.
HEADER = [
    r"(?i)^\s*upsc\s+(civil\s+services|prelims|mains|examination)",
    r"(?i)^\s*general\s+studies\s*[-–:]?\s*paper\s+[i|v|x\d]+",
    r"(?i)^\s*egyankosh\s*\|\s*ignou",
    r"(?i)^\s*subject\s*:\s*(history|geography|polity|economy|anthropology)",
    r"(?i)^\s*module\s+\d+\s*[-–:]?\s*",
    r"(?i)^\s*chapter\s+\d+\s*[-–:]?\s*$",
    r"(?i)^\s*vision\s+ias\s*",
    r"(?i)^\s*drishti\s+ias\s*",
    r"(?i)^\s*insights\s+on\s+india\s*",
    r"(?i)^\s*forum\s+ias\s*",
    r"(?i)^\s*byju'?s\s+classes\s*",
    r"(?i)^\s*violence\s+and\s+repression\s*$",
    r"(?i)^\s*modern\s+warfare\s*$",
    r"(?i)^\s*total\s+war\s*$",
    r"(?i)^\s*violence\s+by\s+non[-\s]state\s+actors\s*$",
    r"(?i)^\s*unit\s+\d+\s*$",
    r"(?i)^\s*block[-\s]\d+\s*$",
    r"(?i)^\s*ignou\s+the\s+people[']?s\s+university\s*$",
    r"(?i)^\s*the\s+people[']?s\s+university\s*$",
    r"(?i)^\s*ignou\s*$",
]
FOOTER = [
    r"(?i)^\s*page\s+\d+\s*(of\s+\d+)?\s*$",
    r"^\s*\d+\s*/\s*\d+\s*$",
    r"^\s*-\s*\d+\s*-\s*$",
    r"^\s*\[\s*\d+\s*\]\s*$",
    r"^\s*\d+\s*$",
    r"(?i)^\s*continued\s+on\s+next\s+page",
    r"(?i)^\s*turn\s+over\s*$",
    r"(?i)^\s*pto\s*$",
]
COPYRIGHT = [
    r"(?i)all\s+rights?\s+reserved",
    r"(?i)copyright\s*(©|\(c\))?\s*\d{4}",
    r"(?i)for\s+(internal|personal)\s+use\s+only",
    r"(?i)do\s+not\s+(copy|duplicate|reproduce|distribute)",
    r"(?i)no\s+part\s+of\s+this\s+(publication|document)\s+may\s+be",
    r"(?i)www\.[a-z0-9\-]+\.[a-z]{2,}",
    r"(?i)email\s*:\s*[^\s]+@[^\s]+",
    r"(?i)call\s*/?s*whatsapp\s*:\s*\+?\d[\d\s\-]{8,}",
    r"(?i)contact\s*:\s*\+?\d[\d\s\-]{8,}",
]
BIBLIOGRAPHY = [
    r"^[A-Z][a-zA-Z\-]+,\s+[A-Z][a-zA-Z\s\.]+\.\s+\d{4}\.",
    r"^[A-Z][a-zA-Z\s\-]+\.\s+\d{4}\.\s+['\"‘’“”]",
    r"(?i)^doi\s*:\s*(10\.\d{4,})",
    r"(?i)https?://doi\.org/",
    r"(?i)https?://dx\.doi\.org/",
    r"(?i)https?://[a-z]+\.jstor\.org/stable/",
    r"(?i)https?://[a-z]+\.luminosoa\.org/",
    r"(?i)\bProceedings\s+of\s+the\s+Indian\s+History\s+Congress\b",
    r"(?i)\bModern\s+Asian\s+Studies\b",
    r"(?i)\bThe\s+Journal\s+of\s+Asian\s+Studies\b",
]
EXERCISE = [
    r"(?i)^\s*check\s+your\s+progress\s*[-–]?\s*\d*\s*$",
    r"(?i)^\s*intext\s+questions?\s*\d*\s*$",
    r"(?i)^\s*self\s+assessment\s+questions?\s*\d*\s*$",
    r"(?i)^\s*activity\s+\d+\s*$",
    r"(?i)^\s*terminal\s+questions?\s*$",
]
TOC = [
    r"\.{4,}\s*\d+\s*$",
    r"_{4,}\s*\d+\s*$",
    r"(?i)^\s*contents\s*$",
    r"(?i)^\s*table\s+of\s+contents\s*$",
    r"^.{5,80}\s+\d{2,3}\s*$",
    r"(?i)^\s*course\s+contents\s*$",
    r"(?i)^\s*pages?\s*$",
]
WATERMARK = [
    r"(?i)^\s*draft\s*$",
    r"(?i)^\s*confidential\s*$",
    r"(?i)^\s*sample\s+only\s*$",
    r"(?i)^\s*for\s+review\s+only\s*$",
    r"(?i)^\s*not\s+for\s+sale\s*$",
    r"(?i)^\s*people[']?s\s*$",
    r"(?i)^\s*ople[']?s\s*$",
    r"(?i)^\s*he\s+people[']?s\s+ople[']?s\s*$",
    r"(?i)^\s*he\s+people[']?s\s*$",
    r"(?i)^\s*university\s*$",
    r"(?i)^\s*indira\s+gandhi\s+national\s+open\s+university\s*$",
    r"(?i)^\s*ingou\s*$",
]
INLINE = [
    r"(?i)\s*ignou\s+the\s+people[']?s\s+university\s*",
    r"(?i)\s*the\s+people[']?s\s+university\s*",
    r"(?i)\s*he\s+people[']?s\s+ople[']?s\s*",
    r"(?i)\s*he\s+people[']?s\s*",
    r"(?i)\s*people[']?s\s+university\s*",
    r"(?i)\s*indira\s+gandhi\s+national\s+open\s+university\s*",
    r"(?i)\s*ignou\s*",
]
TOP_WORDS = ["upsc", "paper", "module", "chapter", "notes", "unit", "block"]
CONTENTS_WORDS = ["course contents", "theme", "unit", "introduction", "pages"]
KEPT = ["exercise_heading", "bibliography"]


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def kind(text: Column, y: Column, height: float = 842.0) -> Column:
    """The first rule that fits, null if none. High y is the top of the page; a null y fits no margin."""
    t = F.trim(text)
    n, low = F.length(t), F.lower(t)
    named = F.exists(F.array(*map(F.lit, TOP_WORDS)), lambda w: F.contains(low, w))
    return F.when(t == "", None).when(_any(t, EXERCISE), "exercise_heading").when(_any(t, BIBLIOGRAPHY), "bibliography").when(_any(t, FOOTER), "footer").when(_any(t, HEADER), "header").when((y > height * 0.93) & (n < 80) & named, "header").when((y < height * 0.07) & (n < 60), "footer").when(_any(t, COPYRIGHT), "copyright").when(_any(t, TOC), "toc").when(_any(t, WATERMARK), "watermark")


def tag(blocks: DataFrame, height: float = 842.0) -> DataFrame:
    """Adds boilerplate_type and is_boilerplate by the ladder; exercises and bibliography are named but kept."""
    b = blocks.withColumn("boilerplate_type", kind(F.col("text"), F.col("y0"), height))
    return b.withColumn("is_boilerplate", F.col("boilerplate_type").isNotNull() & ~F.coalesce(F.col("boilerplate_type").isin(KEPT), F.lit(False)))


def repeating_lines(blocks: DataFrame, pages: int = 3, most: int = 120) -> DataFrame:
    """(doc_id, line): short texts on at least ``pages`` pages of a document."""
    t = blocks.select("doc_id", "page_num", F.trim("text").alias("line")).where((F.col("line") != "") & (F.length("line") < most))
    return t.groupBy("doc_id", "line").agg(F.count_distinct("page_num").alias("n")).where(F.col("n") >= pages).select("doc_id", "line")


def tag_repeats(tagged: DataFrame, **kw) -> DataFrame:
    lines = repeating_lines(tagged, **kw).withColumn("again", F.lit(True))
    j = tagged.withColumn("line", F.trim("text")).join(lines, ["doc_id", "line"], "left")
    hit = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("is_boilerplate") & ~F.coalesce(F.col("boilerplate_type").isin(KEPT), F.lit(False))
    return j.withColumns({"boilerplate_type": F.when(hit, "repeating_header_footer").otherwise(F.col("boilerplate_type")), "is_boilerplate": hit | F.col("is_boilerplate")}).drop("line", "again")


def enforce_types(tagged: DataFrame, most: int = 120) -> DataFrame:
    """Headers and footers by tag get the type; short ones by type get the tag."""
    t = F.when(F.col("is_boilerplate") & F.col("boilerplate_type").isin("header", "repeating_header_footer"), "header").when(F.col("is_boilerplate") & (F.col("boilerplate_type") == "footer"), "footer").otherwise(F.col("type"))
    b = tagged.withColumn("type", t)
    short = ~F.coalesce(F.col("boilerplate_type").isin(KEPT), F.lit(False)) & ~F.col("is_boilerplate") & F.col("type").isin("header", "footer") & (F.length(F.trim("text")) < most)
    return b.withColumns({"boilerplate_type": F.when(short, F.col("type")).otherwise(F.col("boilerplate_type")), "is_boilerplate": short | F.col("is_boilerplate")})


def tag_contents_numbers(tagged: DataFrame, words: list[str] = CONTENTS_WORDS) -> DataFrame:
    """Numbers alone on a contents page are its page numbers; such a page has a long paragraph with three of the words."""
    low = F.lower("text")
    hits = F.aggregate(F.array(*map(F.lit, words)), F.lit(0), lambda a, w: a + F.when(F.contains(low, w), 1).otherwise(0))
    pages = tagged.where((F.col("type") == "paragraph") & (F.length("text") > 200) & (hits >= 3)).select("doc_id", "page_num").distinct().withColumn("contents", F.lit(True))
    j = tagged.join(pages, ["doc_id", "page_num"], "left")
    number = F.coalesce(F.col("contents"), F.lit(False)) & F.col("is_boilerplate") & F.trim("text").rlike("^[0-9]{1,4}$")
    return j.withColumns({c: F.when(number, "toc_page_number").otherwise(F.col(c)) for c in ("boilerplate_type", "type")}).drop("contents")


def strip_watermarks(blocks: DataFrame) -> DataFrame:
    """Cuts watermark phrases out of body text; was_corrected tells where."""
    t = F.col("text")
    for p in INLINE:
        t = F.regexp_replace(t, p, " ")
    t = F.trim(F.regexp_replace(t, "[ \t]{2,}", " "))
    body = F.col("type").isin("paragraph", "heading", "list_item", "caption") & _any(F.col("text"), INLINE)
    return blocks.withColumn("was_corrected", body).withColumn("text", F.when(body, t).otherwise(F.col("text")))


def process(blocks: DataFrame, height: float = 842.0) -> DataFrame:
    return strip_watermarks(tag_contents_numbers(enforce_types(tag_repeats(tag(blocks, height)))))
