"""Mixing sources to target weights by temperature (operator 6).

Source shares p of all words are raised to an exponent a and normalised to weights. The exponent, between 0 (equal
weights) and 1 (as it is), is bisected: to the least one whose repetition stays within ``max_epochs``, or to the one
whose weights have ``entropy`` (in nats; clamped to what is attainable). Without ``budget`` the budget is the least
one that holds every source once, so nothing is lost; with one, small budgets leave documents out by design.

A source's budget is dealt as whole passes plus a partial one. A pass is a permutation: documents are ordered by a
hash of source, pass and id, cut into ``BLOCKS`` blocks. The partial pass takes whole blocks up to the budget; the block on the
border is cut into blocks again, and of its own border block the documents are taken whose running sum still fits; so only block sums
and one block of a million are ever ordered, never a source. ``mix_at`` in [0, 1) orders the mixed stream: any stretch of it holds the sources near their weights.

Defined cases: null text has no words; a null source counts as the empty string; sources without words stay as they
are, once; repeated rows share a place in each permutation and are taken or left together; an empty table gives an
empty result; columns epoch, block and mix_at of the input are replaced by ``mix``, and ``mixed`` returns the input's
columns only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import words, written

BLOCKS = 1024
#: How often the block on the border is cut again: a window holds one in BLOCKS ** LEVELS of a source.
LEVELS = 2
MAX_EPOCHS = 2.0
SEED = 17
STEPS_A_JOB = 4


def place(source: Column, epoch: Column, key: Column, seed: int = SEED) -> Column:
    """Where a document stands in a pass: 48 hash bits as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), source, epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long").cast("double") / float(2**48)


def bisect_exponent(shares: DataFrame, max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: int | None = None, steps: int = 24) -> float:
    """The exponent, to 6 places. shares: (n) words of each source with any. Each job evaluates STEPS_A_JOB bisections at once."""
    whole, top, least = shares.agg(F.sum("n"), F.max("n"), F.min("n")).first()
    if not whole or top == least:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(0, steps, STEPS_A_JOB):
        cells = 2**STEPS_A_JOB
        grid = [lo + (hi - lo) * k / cells for k in range(1, cells)]
        p = F.col("n") / F.lit(float(whole))
        if entropy is None and budget is None:  # the smallest source repeats most; the largest once
            good = [(top / least) ** (1 - a) <= max_epochs for a in grid]
        else:
            got = shares.agg(*[F.struct(F.sum(F.pow(p, F.lit(a))).alias("z"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias("s")) for a in grid]).first()
            if entropy is not None:
                good = [math.log(r["z"]) - a * r["s"] / r["z"] <= entropy for a, r in zip(grid, got, strict=True)]
            else:
                good = [(least / whole) ** a / r["z"] * budget / least <= max_epochs for a, r in zip(grid, got, strict=True)]
        first = next((k for k, ok in enumerate(good) if ok), len(grid))
        lo, hi = ([lo, *grid][first], [*grid, hi][first])
    return round(hi, 6)


def plan(docs: DataFrame, source: str, text: str, max_epochs: float | None, entropy: float | None, budget: int | None) -> DataFrame:
    """(__src, n, weight, tokens, full, rest): each source's words, weight, budget, whole passes and rest."""
    s = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__src"), F.size(words(F.col(text))).cast("long").alias("n")).groupBy("__src").agg(F.sum("n").alias("n"))
    s = written(s, "sources")
    some = s.where("n > 0")
    a = bisect_exponent(some, max_epochs, entropy, budget)
    top = some.agg(F.max("n")).first()[0] or 1
    s = s.withColumn("share", F.when(F.col("n") > 0, F.pow(F.col("n") / F.lit(float(top)), F.lit(a))).otherwise(0.0))
    z = s.agg(F.sum("share")).first()[0] or 1.0
    tokens = F.col("share") * (float(top) if budget is None else float(budget) / z)
    s = s.withColumns({"weight": F.col("share") / z, "tokens": F.floor(tokens).cast("long")})
    s = s.withColumn("full", F.when(F.col("n") > 0, F.floor(F.col("tokens") / F.col("n"))).otherwise(1).cast("long"))
    return written(s.withColumn("rest", F.greatest(F.lit(0), F.col("tokens") - F.col("full") * F.col("n"))).select("__src", "n", "weight", "tokens", "full", "rest"), "plan")


def _cuts(docs: DataFrame, p: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """(__src, cut): the last place in the partial pass that still fits; -1 if none."""
    d = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("__src"), F.col(key).alias("k"), F.size(words(F.col(text))).cast("long").alias("w"))
    d = d.join(p.select("__src", "full", "rest").where("rest > 0"), "__src").select("__src", "rest", "w", place(F.col("__src"), F.col("full"), F.col("k"), seed).alias("u"))
    d = written(d, "places")
    run = Window.partitionBy("__src").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cuts, inside, width = None, d.withColumn("before", F.lit(0).cast("long")), 1
    for _ in range(LEVELS):  # blocks, then blocks of the block on the border
        width *= BLOCKS
        inside = inside.withColumn("b", F.floor(F.col("u") * width))
        blocks = inside.groupBy("__src", "b", "rest", "before").agg(F.sum("w").alias("w")).withColumn("upto", F.col("before") + F.sum("w").over(run))
        blocks = written(blocks, "blocks")
        whole = blocks.where("upto <= rest").groupBy("__src").agg(F.max((F.col("b") + 1) / width).alias("cut"))
        cuts = whole if cuts is None else cuts.unionByName(whole)
        border = blocks.where("upto > rest").groupBy("__src").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("w")).alias("before")), "b").alias("x"))
        inside = inside.drop("before").join(F.broadcast(border.select("__src", "x.b", "x.before")), ["__src", "b"])
    inner = inside.withColumn("upto", F.col("before") + F.sum("w").over(Window.partitionBy("__src", "b").orderBy("u")))
    part = inner.where("upto <= rest").groupBy("__src").agg(F.max("u").alias("cut"))
    return cuts.unionByName(part).groupBy("__src").agg(F.max("cut").alias("cut"))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", max_epochs: float | None = MAX_EPOCHS, entropy: float | None = None, budget: int | None = None, seed: int = SEED) -> DataFrame:
    """docs' rows as often as their source's budget holds them, with epoch (long), block (int) and mix_at (double)."""
    p = plan(docs, source, text, max_epochs, entropy, budget)
    p = written(p.join(_cuts(docs, p, key, source, text, seed), "__src", "left").select("__src", "full", (F.col("tokens") / F.greatest(F.col("n"), F.lit(1))).alias("__passes"), F.coalesce("cut", F.lit(-1.0)).alias("__cut")), "passes")
    d = docs.drop("epoch", "block", "mix_at")
    src = F.coalesce(d[source].cast("string"), F.lit(""))
    j = d.withColumn("__src", src).join(p, "__src")
    partial = place(F.col("__src"), F.col("full"), F.col(key), seed) <= F.col("__cut")
    times = F.col("full") + F.when(partial, 1).otherwise(0)
    j = j.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<bigint>"))))
    j = j.withColumn("__u", place(F.col("__src"), F.col("epoch"), F.col(key), seed))
    # a source without words is one pass of its own
    return j.withColumns({"block": F.floor(F.col("__u") * BLOCKS).cast("int"), "mix_at": (F.col("epoch") + F.col("__u")) / F.when(F.col("__passes") > 0, F.col("__passes")).otherwise(1.0)}).drop("__src", "full", "__passes", "__cut", "__u")


def mixed(docs: DataFrame, **kw) -> DataFrame:
    """mix(), with the columns of docs only."""
    return mix(docs, **kw).select(*[F.col(f"`{c}`") for c in docs.columns]) if not {"epoch", "block", "mix_at"} & set(docs.columns) else _kept_names(docs, **kw)


def _kept_names(docs: DataFrame, **kw) -> DataFrame:
    """As mixed(), where docs has columns with the names of mix()'s own."""
    own = {c: f"__own_{c}" for c in ("epoch", "block", "mix_at") if c in docs.columns}
    out = mix(docs.withColumnsRenamed(own), **kw).drop("epoch", "block", "mix_at")
    return out.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)
