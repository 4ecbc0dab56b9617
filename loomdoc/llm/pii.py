"""Personal data: fixed patterns and information-theoretic sanitisation (operator 7; DataFrame functions only).

Patterns find e-mail and IP addresses, card and phone numbers. Protected entities are their values, the classes of values
(an e-mail's domain, a network of 16 bits, a card's issuer, an area code) and their kinds. Every entity's surroundings
(``CONTEXT`` words to each side) are compared with the whole corpus. With p(.) over all documents, a term t discloses
entity e as far as PMI(e; t) = log p(e, t) / (p(e) p(t)) comes near the information content IC(e) = -log p(e), which it
reaches when t never occurs without e. Terms with PMI >= GENERALISE * IC are generalised, those with PMI >= REMOVE * IC removed,
wherever they occur, if they stand beside the entity in at least ``MIN_CONTEXTS`` different contexts: copies of one
passage are one context, so a copied text doesn't condemn its words.

Defined cases: null and empty texts have no spans; a doc_id that repeats with another text is another row; repeated
rows are each given; further columns are ignored by ``find`` and pass through ``sanitise``; an empty table gives an empty result.

Offsets come from splitting a text at the matches and summing lengths, in time proportional to the text. Contexts are taken from
blocks of ``BLOCK`` characters that a text is cut into once, beside the array of its spans, so that a row holds a text once however many
spans it has; the told terms of a text are found by one pattern if there are up to ``ALTERNATIVES``, and else by a join of its words.
The patterns below carry possessive quantifiers and look-behinds where these change nothing but the time on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, row_key, written
from .decontam import LOWER, UPPER

KINDS = ["email", "ip", "card", "phone", "term"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
CHAR = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of a term
CONTEXT = 8
CONTEXT_CHARS = 160
BLOCK = 512
MIN_CONTEXTS = 3
#: Terms that are looked for in a text by one pattern.
ALTERNATIVES = 32
GENERALISE, REMOVE = 0.8, 0.95


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    twice = lambda d: d * 2 - F.when(d > 4, 9).otherwise(0)
    luhn = F.aggregate(F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, twice(d.cast("int"))).otherwise(d.cast("int"))), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0
    return F.when(kind == "email", True).when(kind == "ip", ip).when(kind == "card", n.between(12, 19) & luhn).otherwise(n.between(9, 15))


def _pieces(rows: DataFrame, by: list[str], matches: str, pieces: str, keep: int) -> DataFrame:
    """A row for each match of each row of (by..., matches, pieces): value, start, end, and up to keep characters on either side."""
    before, after = F.col("x")["p"], F.col("x")["q"]
    n = F.size(matches)
    zipped = F.arrays_zip(F.col(matches).alias("m"), F.slice(pieces, 1, n).alias("p"), F.slice(pieces, F.lit(2), n).alias("q"))
    x = rows.select(*by, F.posexplode(zipped).alias("i", "x"))
    # repeated rows of one key are one text
    x = x.select(*by, "i", F.col("x")["m"].alias("value"), F.length(before).alias("gap"), F.when(F.length(before) > keep, F.concat(F.lit("\x00"), F.substring(before, -keep, keep))).otherwise(before).alias("left"), F.when(F.length(after) > keep, F.concat(F.substring(after, 1, keep), F.lit("\x00"))).otherwise(after).alias("right")).distinct()
    upto = F.sum(F.col("gap") + F.length("value")).over(Window.partitionBy(*by).orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("end", upto.cast("long")).withColumn("start", F.col("end") - F.length("value"))


def base_spans(d: DataFrame) -> DataFrame:
    """(key, kind, value, start, end) of the fixed patterns; d: (key, t)."""
    per_kind = []
    for k, pattern in PATTERNS.items():
        tried = F.col("t").contains(NEEDED[k]) if NEEDED[k] else F.col("t").rlike("[0-9]")
        per_kind.append(F.when(tried & F.col("t").rlike(pattern), F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("t", F.lit(pattern), F.lit(0)).alias("m"), F.split("t", pattern).alias("p"))))
    rows = d.select("key", F.explode(F.array_compact(F.array(*per_kind))).alias("s")).select("key", "s.kind", "s.m", "s.p")
    return _pieces(rows, ["key", "kind"], "m", "p", 0).where(_valid(F.col("kind"), F.col("value"))).select("key", "kind", "value", "start", "end")


def terms_in(text: Column) -> Column:
    """Runs of letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")


def _let(x: Column, f) -> Column:
    """f(x), with x worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def blocks(t: Column) -> Column:
    """A text in blocks of BLOCK characters."""
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _part(b: Column, begin: Column, n: Column) -> Column:
    """n characters of a text in blocks, after the first begin ones: only the blocks that hold them are touched."""
    first = F.floor(begin / BLOCK).cast("int")
    some = F.slice(b, first + 1, F.floor((begin + n) / BLOCK).cast("int") - first + 1)
    return F.when(n > 0, F.array_join(some, "").substr((begin - first * BLOCK + 1).cast("int"), n.cast("int"))).otherwise("")


def _around(t: Column, start: Column, end: Column, b: Column | None = None, length: Column | None = None) -> Column:
    """The CONTEXT terms before start and after end, whatever stands between: from CONTEXT_CHARS characters if these hold as many, or else from more and more, up to the whole text. A term that the window cuts is left out. b: the text's blocks, length: its characters, where they are known."""
    b, length = blocks(t) if b is None else b, F.length(t) if length is None else length
    start, end = start.cast("int"), end.cast("int")
    after = length - end

    def before(n: Column) -> Column:
        x = _part(b, start - n, n)
        return terms_in(F.when(n < start, F.regexp_replace(x, f"^{CHAR}+", "")).otherwise(x))

    def behind(n: Column) -> Column:
        x = _part(b, end, n)
        return terms_in(F.when(n < after, F.regexp_replace(x, f"{CHAR}++$", "")).otherwise(x))

    def enough(side, most: Column, sizes=(CONTEXT_CHARS, 16 * CONTEXT_CHARS, 256 * CONTEXT_CHARS)) -> Column:
        if not sizes:
            return side(most)
        return _let(side(F.least(most, F.lit(sizes[0]))), lambda some: F.when((F.size(some) >= CONTEXT) | (most <= sizes[0]), some).otherwise(enough(side, most, sizes[1:])))

    last = _let(enough(before, start), lambda left: F.slice(left, F.greatest(F.size(left) - CONTEXT + 1, F.lit(1)), CONTEXT))
    return F.concat(last, F.slice(enough(behind, after), 1, CONTEXT))


def entities(kind: Column, value: Column) -> Column:
    """What a span is evidence of: its value, the class that holds it (an e-mail's domain, a network, a card's issuer, an area code), and its kind."""
    digits, low = F.regexp_replace(value, "[^0-9]", ""), F.translate(value, UPPER, LOWER)
    own = F.when(kind.isin("card", "phone"), digits).otherwise(low)
    of = F.when(kind == "email", F.substring_index(low, "@", -1)).when(kind == "ip", F.substring_index(low, ".", 2)).when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    name = lambda level, x: F.concat(kind, F.lit(f":{level}:"), x)
    return F.array(name("value", own), name("class", of), name("kind", F.lit("")))


def disclosing_terms(d: DataFrame, spans: DataFrame) -> DataFrame:
    """(term, ratio): terms that give a protected entity away; ratio: the largest PMI / IC over the entities."""
    named = spans.select("key", "start", "end", entities(F.col("kind"), F.col("value")).alias("entities"))
    at = written(named.groupBy("key").agg(F.collect_list(F.struct("start", "end", "entities")).alias("at")), "entities")
    t = F.coalesce("t", F.lit(""))
    texts = d.select("key", blocks(t).alias("b"), F.length(t).alias("length"))
    met = texts.join(if_small(at, width=F.length(F.to_json("at"))), "key")
    seen = F.transform("at", lambda s: F.struct(s["entities"].alias("entities"), _around(t, s["start"], s["end"], F.col("b"), F.col("length")).alias("around")))
    c = met.select("key", F.explode(seen).alias("c")).where(F.size("c.around") > 0)
    pairs = c.select("key", F.explode("c.entities").alias("entity"), F.xxhash64("c.around").alias("context"), F.array_distinct("c.around").alias("terms")).select("key", "entity", "context", F.explode("terms").alias("term"))
    # in steps, so that a common pair is pre-aggregated: documents of a context, then contexts
    near = pairs.distinct().groupBy("entity", "term", "context").agg(F.count("*").alias("docs")).groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("docs").alias("both"))
    near = written(near.where(F.col("contexts") >= MIN_CONTEXTS), "near")
    of_entity = named.select("key", F.explode("entities").alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("df_e"))
    # outer, as a filter for empty arrays would be pushed down with a copy of all that makes the array
    of_term = d.select(F.explode_outer(F.array_distinct(terms_in(F.coalesce("t", F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    whole = F.lit(float(max(2, d.count())))
    j = near.join(of_entity, "entity").join(of_term, "term")
    both = F.least(F.col("both"), F.col("df_e"), F.col("df_t"))
    ic = F.log(whole / F.least(F.col("df_e"), whole - 1))
    return j.groupBy("term").agg(F.max(F.log(both * whole / (F.col("df_e") * F.col("df_t"))) / ic).alias("ratio")).where(F.col("ratio") >= GENERALISE)


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, doc_id, spans) of each row: spans in order, as struct(start, ord, end, kind, ratio); offsets in code points, end exclusive."""
    d = docs.select(row_key(F.col(id_col), F.col(text)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text).alias("t"))
    spans = written(base_spans(d.select("key", F.coalesce("t", F.lit("")).alias("t"))), "spans").distinct()
    terms = written(disclosing_terms(d, spans), "terms")
    t = F.coalesce(F.col("t"), F.lit(""))
    told = d.select("key", F.explode_outer(F.array_distinct(terms_in(t))).alias("term")).join(if_small(terms, width=F.length("term")), "term")
    held = written(told.groupBy("key").agg(F.sort_array(F.collect_set("term")).alias("terms")), "told")
    low = F.translate(t, UPPER, LOWER)
    # one pattern finds the few told terms of a text; where there are many, all its words come with their offsets, and a join finds these among them
    few = held.where(F.size("terms") <= ALTERNATIVES)
    alone = F.concat(F.lit(f"(?<!{CHAR})(?:"), F.array_join(F.transform("terms", lambda w: F.concat(F.lit("\\Q"), w, F.lit("\\E"))), "|"), F.lit(f")(?!{CHAR})"))
    some = d.join(if_small(few, width=F.length(F.array_join("terms", " "))), "key").withColumn("alone", alone)
    some = some.select("key", F.regexp_extract_all(low, F.col("alone"), F.lit(0)).alias("m"), F.split(low, F.col("alone")).alias("p"))
    many = held.where(F.size("terms") > ALTERNATIVES).select("key")
    most = d.join(if_small(many, width=F.length("key")), "key", "left_semi").select("key", F.regexp_extract_all(low, F.lit(f"{CHAR}++"), F.lit(0)).alias("m"), F.split(low, f"{CHAR}++").alias("p"))
    at = _pieces(some, ["key"], "m", "p", 0).unionByName(_pieces(most, ["key"], "m", "p", 0)).join(if_small(terms, width=F.length("term")), F.col("value") == F.col("term"))
    every = spans.select("key", "kind", "start", "end", F.lit(None).cast("double").alias("ratio")).unionByName(at.select("key", F.lit("term").alias("kind"), "start", "end", "ratio"))
    # a term inside personal data is already covered: by a span that begins before it or with it, or by one that begins within it
    own = lambda c: F.when(F.col("kind") != "term", F.col(c))
    upto, onward = (Window.partitionBy("key").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("start"), F.desc("start")))
    every = every.withColumns({"reach": F.max(own("end")).over(upto), "next": F.min(own("start")).over(onward)})
    free = ~F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int").alias("ord")
    every = every.where((F.col("kind") != "term") | free).select("key", F.struct("start", place, "end", "kind", "ratio").alias("s"))
    found = every.groupBy("key").agg(F.sort_array(F.collect_set("s")).alias("spans"))
    none = F.array().cast(found.schema["spans"].dataType)
    return d.drop("t").join(written(found, "found"), "key", "left").select("key", "doc_id", F.coalesce("spans", none).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with personal data and removed terms replaced in the text: [EMAIL] and so on, [TERM] for a generalised term, nothing for a removed one."""
    f = find(docs, id_col, text).select(F.col("key").alias("__key"), F.col("spans").alias("__spans")).dropDuplicates(["__key"])
    free = F.aggregate("__spans", F.struct(F.array().cast(f.schema["__spans"].dataType).alias("a"), F.lit(0).cast("long").alias("end")), lambda a, s: F.when(s["start"] >= a["end"], F.struct(F.array_append(a["a"], s).alias("a"), s["end"].alias("end"))).otherwise(a), lambda a: a["a"])
    j = docs.withColumn("__key", row_key(F.col(id_col), F.col(text))).join(f, "__key", "left").withColumn("__s", free)
    shown = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["ratio"] >= REMOVE, "").otherwise("[TERM]")
    t = F.coalesce(F.col(text), F.lit(""))
    s = F.col("__s")
    begin = lambda i: F.when(i > 0, F.get(s, i - 1)["end"]).otherwise(0).cast("int")
    out = F.concat(F.array_join(F.transform(s, lambda x, i: F.concat(t.substr(begin(i) + 1, x["start"].cast("int") - begin(i)), shown(x))), ""), t.substr(F.coalesce(F.element_at(s, -1)["end"].cast("int"), F.lit(0)) + 1, F.length(t)))
    return j.withColumn(text, F.when(F.size(s) > 0, out).otherwise(F.col(text))).select(*docs.columns)
