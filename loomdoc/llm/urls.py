"""URL filters: fixed host and path rules, then association rules mined from labels (operator 4; DataFrame functions and Spark's FP-growth only).

A URL's tokens are its host labels, host suffixes, path segments that are not numbers, and query names;
query values are none. Tokens that imply the label by themselves are rules, and no longer combination with them is needed. FP-growth mines
the combinations of the other tokens in the labelled URLs that are bad, on at least ``min_rows`` of these (and
``min_support`` of all labelled rows, if that is given); their confidence is counted over all labelled rows, and those that reach ``min_confidence`` become block rules, without those
that a shorter one already covers. Tokens that stand in the same labelled URLs, as those of one template, count as one while combinations are mined (else a template of n
tokens would have 2^n), and each of them fits in a rule for any other. Each rule is indexed under its rarest token only (inverted index), so a URL meets few
rules, and a rule fits if all its tokens are there. Fixed rules win over mined ones.

Defined cases: a null URL, or one without ``://``, has an empty host and path, no tokens, and is allowed; repeated
rows are each judged; without labels no rule is mined and the method allows all; null labels are left out; an empty
table gives an empty result; further columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .decontam import LOWER, UPPER

#: Fixed values of the contract: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: None by itself: with a share of all rows, a bad host would lose its rule as other hosts come in.
MIN_SUPPORT = 0.0
MIN_ROWS = 20
MIN_CONFIDENCE = 0.6
SALTS = 16


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    host, path = host_of(url), path_of(url)
    labels = F.array_remove(F.split(host, r"\."), "")
    n = F.size(labels)
    suffix = F.when(n >= 2, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), 2), ".")))).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split(path, "/"), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
    names = F.filter(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)="), F.lit(1)), lambda x: x != "")
    tag = lambda k, a: F.transform(a, lambda x: F.concat(F.lit(k), x))
    return F.array_distinct(F.concat(tag("h:", labels), suffix, tag("s:", segments), tag("q:", names)))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict)."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


FOUND = "antecedent array<string>, confidence double, rarest string, alternatives array<array<string>>"


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_rows: int = MIN_ROWS) -> DataFrame:
    """(antecedent, confidence, rarest, alternatives) from (tokens, bad): token combinations that imply the label, and for each of their tokens those that fit as well."""
    spark = labelled.sparkSession
    t = labelled.where("bad IS NOT NULL AND size(tokens) > 0").select("bad", F.array_distinct("tokens").alias("tokens"))
    t = written(t.withColumn("row", F.monotonically_increasing_id()), "labelled")
    total, n_bad = t.agg(F.count("*"), F.count_if("bad")).first()
    least = max(min_rows, min_support * total)
    if n_bad < least or not n_bad:
        return spark.createDataFrame([], FOUND)
    # where a token stands, as a sum that doesn't depend on order
    places = F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("places")
    each = t.select("row", "bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if("bad").alias("n_bad"), places)
    each = written(each.where(F.col("n_bad") >= least), "tokens")
    alone = F.col("n_bad") / F.col("n") >= min_confidence
    singles = each.where(alone).select(F.array("token").alias("antecedent"), (F.col("n_bad") / F.col("n")).alias("confidence"), F.col("token").alias("rarest"), F.array(F.array("token")).alias("alternatives"))
    same = each.where(~alone).groupBy("n", "n_bad", "places").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    classes = written(same.select(F.get("tokens", F.lit(0)).alias("item"), "n", "tokens"), "classes")
    of = classes.select("item", F.explode("tokens").alias("token"))
    rows = t.select("row", "bad", F.explode("tokens").alias("token")).join(of, "token").groupBy("row", "bad").agg(F.collect_set("item").alias("items"))
    rows = written(rows.where(F.size("items") > 1), "rows")
    bad = rows.where("bad").select("items")
    n = bad.count()
    if n < least:
        return written(singles, "kept_rules")
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=1.0).fit(bad)
    c = model.freqItemsets.where((F.size("items") > 1) & (F.col("freq") >= least)).select(F.sort_array("items").alias("items"), F.col("freq").alias("n_bad"))
    c = c.withColumn("id", F.sha2(F.array_join("items", "\n"), 256))
    keyed = c.select("id", "items", "n_bad", F.explode("items").alias("item")).join(classes.select("item", "n"), "item")
    keyed = written(keyed.groupBy("id").agg(F.first("items").alias("items"), F.first("n_bad").alias("n_bad"), F.min(F.struct("n", "item"))["item"].alias("rarest")), "candidates")
    # over all labelled rows; those of a common token are dealt over salts
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))).select("row", "items", "salt", F.explode("items").alias("rarest"))
    dealt = keyed.select("id", F.col("items").alias("wanted"), "rarest", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    counted = salted.join(dealt, ["rarest", "salt"]).where(F.size(F.array_except("wanted", "items")) == 0).groupBy("id").agg(F.count("*").alias("n"))
    sure = written(keyed.join(counted, "id").withColumn("confidence", F.col("n_bad") / F.col("n")).where(F.col("confidence") >= min_confidence).select("id", "items", "confidence", "rarest"), "sure")
    short = sure.select(F.col("rarest").alias("item"), F.col("items").alias("short"), F.col("id").alias("sid"))
    covered = sure.select("id", "items", F.explode("items").alias("item")).join(short, "item").where((F.col("id") != F.col("sid")) & (F.size(F.array_except("short", "items")) == 0)).select("id").distinct()
    kept = sure.join(covered, "id", "left_anti")
    told = kept.select("id", "items", "confidence", "rarest", F.posexplode("items").alias("i", "item")).join(classes.select("item", "tokens"), "item")
    told = told.groupBy("id").agg(F.first("items").alias("antecedent"), F.first("confidence").alias("confidence"), F.first("rarest").alias("rarest"), F.transform(F.sort_array(F.collect_list(F.struct("i", "tokens"))), lambda x: x["tokens"]).alias("alternatives"))
    return written(singles.unionByName(told.drop("id")), "kept_rules")


def judge(pages: DataFrame, labels: DataFrame | None = None, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", label: str = "toxic", rules: list[tuple[str, str, str]] = RULES, **mining) -> DataFrame:
    """(page_id, host, path, rule, verdict) for each page; mined_confidence is null unless a mined rule blocked it."""
    u = F.col("url")
    p = pages.select(row_key(F.col(page_id), F.col(url)).alias("key"), F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    p = p.withColumns({"host": host_of(u), "path": path_of(u)}).withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    open_pages = p.where("fixed IS NULL").select("key", tokens_of(u).alias("tokens"))
    if labels is None:
        blocked = open_pages.select("key", F.lit(None).cast("double").alias("confidence")).where("false")
    else:
        given = labels.select(F.col(label_id).alias("page_id"), (F.col(label) == 1).alias("bad"))
        found = mined_rules(p.select("page_id", tokens_of(u).alias("tokens")).join(given, "page_id").select("tokens", "bad"), **mining)
        # under each token that fits for the rarest one
        index = found.select("confidence", "alternatives", F.explode(F.element_at("alternatives", F.array_position("antecedent", F.col("rarest")).cast("int"))).alias("token"))
        meet = open_pages.select("key", "tokens", F.explode("tokens").alias("token")).join(index, "token").where(F.forall("alternatives", lambda a: F.arrays_overlap(a, "tokens")))
        blocked = meet.groupBy("key").agg(F.max("confidence").alias("confidence"))
    out = p.join(blocked, "key", "left")
    verdict = F.coalesce(F.col("fixed")["verdict"], F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("fixed")["rule"].alias("rule"), verdict.alias("verdict"), F.col("confidence").alias("mined_confidence"))
