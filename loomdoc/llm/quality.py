"""Quality rules with adaptive thresholds from mergeable quantile sketches (operator 9; DataFrame functions only).

Each document gets integer measures of its whole text. A log-linear histogram (counts per bucket, at most 1/32
relative error) of each measure is the quantile sketch: sketches of partitions, sources and languages merge by adding
counts, so hot sources pre-aggregate. Fences (quartile distance, Tukey) per language and source replace fixed
cutoffs; a group below ``min_rows`` takes the merged sketch of its language, then of all.

Defined cases: null or blank text has no words, fails the base rules and is not kept; null language or source counts
as the empty string; repeated rows are each judged alike; an empty table gives an empty result; further columns pass
through ``quality_filter`` unchanged, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WS_CHARS, WS_CLASS, hashed, if_small, joined_hashes, row_key, words, written

#: measure: (narrowest distance that counts as a quartile distance, both sides fenced). In thousandths.
MEASURES = {
    "mean_word": (700, True),
    "symbol_share": (50, False),
    "dup_line_share": (200, False),
    "repeat_share": (90, False),
}
FENCE = 3
MIN_ROWS = 200
SALTS = 16


def base_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) added.

    n_repeat_words counts the words inside 8-word windows that occur twice or more in the text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumns({"__w": words(F.col(text)), "__l": F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS_CLASS}]"))})
    df = df.withColumns({"n_words": F.size("__w").cast("long"), "n_lines": F.size("__l").cast("long"), "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"), "word_chars": F.length(F.translate(t, WS_CHARS, "")).cast("long"), "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"), "__h": hashed(F.col("__w"))})
    for step in (1, 2, 4):  # hashes of runs of 2, 4, 8 words
        df = df.withColumn("__h", joined_hashes(F.col("__h"), step))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(twice, placed))
    s = F.col("__s")
    same = lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"]))
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-8).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(8), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return df.withColumn("n_repeat_words", F.when(s.isNotNull(), covered).otherwise(0).cast("long")).drop("__w", "__l", "__h", "__s")


def _bucket(v: Column) -> Column:
    """Lower bound of v's bucket: exact below 64, then 32 buckets to each power of two."""
    shift = F.greatest(F.lit(0), F.length(F.bin(v)) - 6)
    power = F.expr("shiftleft(1L, greatest(0, length(bin(value)) - 6))")
    return F.when(shift > 0, F.floor(v / power) * power).otherwise(v)


def thresholds(measured: DataFrame, lang: str, source: str, min_rows: int = MIN_ROWS) -> DataFrame:
    """(__lang, __source, low_<m>, high_<m> ...) from the rows' measures, one row for each language and source."""
    m = measured.select(F.coalesce(F.col(lang), F.lit("")).alias("__lang"), F.coalesce(F.col(source), F.lit("")).alias("__source"), F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("value")) for k in MEASURES])).alias("x")).select("__lang", "__source", "x.measure", "x.value")
    own = m.groupBy("__lang", "__source", "measure", _bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))
    own = written(own, "sketch")
    by_lang = own.groupBy("__lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("measure", "bucket").agg(F.sum("n").alias("n"))

    def quartiles(sketch: DataFrame, keys: list[str], tag: str) -> DataFrame:
        whole = Window.partitionBy(*keys, "measure")
        upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        s = sketch.withColumns({"total": F.sum("n").over(whole), "upto": F.sum("n").over(upto)})
        q = lambda num: F.min(F.when(F.col("upto") * 4 >= F.col("total") * num, F.col("bucket")))
        return s.groupBy(*keys, "measure").agg(F.max("total").alias(f"n_{tag}"), q(1).alias(f"q1_{tag}"), q(3).alias(f"q3_{tag}"))

    t = quartiles(own, ["__lang", "__source"], "own").join(quartiles(by_lang, ["__lang"], "lang"), ["__lang", "measure"]).join(quartiles(by_all, [], "all"), ["measure"])
    pick = lambda q: F.when(F.col("n_own") >= min_rows, F.col(f"{q}_own")).when(F.col("n_lang") >= min_rows, F.col(f"{q}_lang")).otherwise(F.col(f"{q}_all"))
    floor = reduce(lambda c, k: c.when(F.col("measure") == k, F.lit(MEASURES[k][0])), MEASURES, F.when(F.lit(False), F.lit(0)))
    t = t.select("__lang", "__source", "measure", pick("q1").alias("q1"), pick("q3").alias("q3"), floor.alias("floor"))
    reach = FENCE * F.greatest(F.col("q3") - F.col("q1"), F.col("floor"))
    cut = lambda k, c: F.max(F.when(F.col("measure") == k, c))
    return t.groupBy("__lang", "__source").agg(*[cut(k, F.col("q3") + reach).alias(f"high_{k}") for k in MEASURES], *[cut(k, F.col("q1") - reach).alias(f"low_{k}") for k in MEASURES])


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """(key, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept), a row for each row of docs."""
    d = docs.select(row_key(F.col(id_col), F.col(text)).alias("key"), F.col(id_col).alias("doc_id"), F.col(text).alias("__t"), F.col(lang).cast("string").alias("__lang"), F.col(source).cast("string").alias("__source"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    share = lambda a, b: F.floor(1000 * F.col(a) / b).cast("long")
    m = base_measures(d, "__t").drop("__t").withColumns({"mean_word": share("word_chars", n), "symbol_share": share("n_symbols", n), "dup_line_share": share("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1))), "repeat_share": share("n_repeat_words", n)})
    m = m.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    m = written(m, "measures")
    cuts = written(thresholds(m.where("NOT base_failed"), "__lang", "__source", min_rows), "thresholds")
    # salted: a source with a third of all rows is dealt to SALTS keys
    salted = m.withColumns({"__lang": F.coalesce("__lang", F.lit("")), "__source": F.coalesce("__source", F.lit("")), "__salt": F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")})
    j = salted.join(cuts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["__lang", "__source", "__salt"], "left")
    out = reduce(lambda a, b: a | b, [F.col(k) > F.col(f"high_{k}") for k in MEASURES] + [F.col(k) < F.col(f"low_{k}") for k, (_, both) in MEASURES.items() if both])
    kept = ~F.col("base_failed") & ~F.coalesce(out, F.lit(False))
    return j.select("key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of docs that are kept, with all columns of docs."""
    bad = written(judge(docs, id_col, text, lang, source, min_rows).where("NOT kept").select(F.col("key").alias("__bad")).distinct(), "rejected")
    return docs.join(if_small(bad), row_key(docs[id_col], docs[text]) == F.col("__bad"), "left_anti")
