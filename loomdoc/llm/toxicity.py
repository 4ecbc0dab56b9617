"""Toxicity by non-negative positive-unlabelled learning (operator 2).

Linear classifiers over the words a text holds (each counted once) are trained in numpy from confirmed toxic texts and
unlabelled ones. With class prior p and logistic loss l, the risk is p * R_P(+) + max(0, R_U(-) - p * R_P(-)); where the
difference turns negative in a batch, its gradient is reversed, as the unlabelled risk would otherwise be overfitted. The
classifiers of ``MODELS`` seeds are averaged. They are fitted on a bounded sample of rows: at most ``POSITIVES`` toxic and
``UNLABELLED`` other texts, each with all its words, of which those, ``FEATURES`` at most, that tell both apart by more than chance are features;
every text is then scored whole. Rows are drawn by a hash of id and text, so that the sample doesn't depend on the partitioning.

Defined cases: null and empty texts get the score of a text without known words; without any confirmed toxic text the
score is 0 for all; null labels count as unlabelled; repeated rows are each scored alike; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed
from .hashing import flat

POSITIVES, UNLABELLED = 4000, 12000
FEATURES = 1 << 15
MODELS, EPOCHS, BATCH, RATE, DECAY = 3, 40, 2000, 0.05, 1e-4
#: A word must be in so many texts of the sample to be a feature.
SUPPORT = 4
FALSE_WORDS = 0.05


@dataclass
class Model:
    """known: sorted word hashes; weight: of each; bias."""

    known: np.ndarray
    weight: np.ndarray
    bias: float

    def __call__(self, h: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The score of each text; h: its different words."""
        out = np.full(len(lengths), self.bias)
        if len(self.known) and len(h):
            at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
            found = np.flatnonzero(self.known[at] == h)
            row = np.repeat(np.arange(len(lengths)), lengths)[found]
            out += np.bincount(row, self.weight[at[found]], len(lengths))
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def terms(text: Column) -> Column:
    """Hashes of the different lower-cased words of letters, digits and characters beyond ASCII."""
    ws = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")
    return F.array_distinct(hashed(ws))


def fit(positive: tuple[np.ndarray, np.ndarray], unlabelled: tuple[np.ndarray, np.ndarray], prior: float) -> Model:
    """From (hashes, lengths) of both kinds of text."""
    none = np.empty(0, np.uint64)
    if not len(positive[1]) or not len(unlabelled[1]):
        return Model(none, np.empty(0), -60.0)
    (hp, lp), (hu, lu) = positive, unlabelled
    known, inv = np.unique(np.concatenate([hp, hu]), return_inverse=True)
    in_p, in_u = np.bincount(inv[: len(hp)], minlength=len(known)), np.bincount(inv[len(hp) :], minlength=len(known))
    tells = _tells(in_p, in_u, len(lp), len(lu))
    tells[in_p + in_u < SUPPORT] = 0
    order = np.argsort(-tells, kind="stable")[:FEATURES]
    # as many as keep the expected share of chance findings below FALSE_WORDS
    chance = np.array([math.erfc(x / math.sqrt(2)) for x in tells[order].tolist()])
    good = np.flatnonzero(chance * (in_p + in_u >= SUPPORT).sum() <= FALSE_WORDS * np.arange(1, len(order) + 1))
    chosen = np.sort(order[: good[-1] + 1 if len(good) else 0])
    place = np.full(len(known), -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(cols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        col, row = place[cols], np.repeat(np.arange(len(lengths)), lengths)
        col, row = col[col >= 0], row[col >= 0]
        return col, row, np.searchsorted(row, np.arange(len(lengths) + 1))

    sides = [matrix(inv[: len(hp)], lp), matrix(inv[len(hp) :], lu)]
    weight, bias = np.zeros(len(chosen)), 0.0
    for seed in range(MODELS):
        w, c = _train(sides, (len(lp), len(lu)), len(chosen), prior, np.random.default_rng(seed))
        weight, bias = weight + w / MODELS, bias + c / MODELS
    return Model(known[chosen], weight, bias)


def _tells(p: np.ndarray, u: np.ndarray, n_p: int, n_u: int) -> np.ndarray:
    """Root of the likelihood ratio of each word's counts in n_p and n_u texts: about standard normal for words that tell nothing."""
    out, share = np.zeros(len(p)), (p + u) / (n_p + n_u)
    for k, n in ((p, n_p), (u, n_u)):
        for seen, rate in ((k, share), (n - k, 1 - share)):
            out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(n * rate, 1e-9)), 0)
    return np.sqrt(np.maximum(2 * out, 0))


def _train(sides, sizes, n: int, prior: float, rng) -> tuple[np.ndarray, float]:
    theta = np.zeros(n + 1)
    theta[n] = np.log(prior / (1 - prior))
    m, v, step = np.zeros(n + 1), np.zeros(n + 1), 0
    batches = max(1, -(-max(sizes) // BATCH))
    for _ in range(EPOCHS):
        order = [rng.permutation(k) for k in sizes]
        for b in range(batches):
            parts = []
            for (col, row, at), o in zip(sides, order, strict=True):
                take = o[b::batches] if len(o) >= batches else o
                span = at[take + 1] - at[take]
                idx = np.repeat(at[take] - (np.cumsum(span) - span), span) + np.arange(span.sum())
                z = np.bincount(np.repeat(np.arange(len(take)), span), theta[col[idx]], len(take)) + theta[n]
                parts.append((col[idx], np.repeat(np.arange(len(take)), span), 1 / (1 + np.exp(-np.clip(z, -60, 60))), len(take)))

            def grad(part, d, n=n):
                col, row, _, size = part
                return np.append(np.bincount(col, d[row], n), d.sum()) / size

            (p, u) = parts
            minus = np.logaddexp(0, np.log(np.clip(u[2], 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(u[2], 1e-12, 1 - 1e-12))).mean() - prior * np.logaddexp(0, np.log(np.clip(p[2], 1e-12, 1 - 1e-12)) - np.log1p(-np.clip(p[2], 1e-12, 1 - 1e-12))).mean()
            gap = grad(u, u[2]) - prior * grad(p, p[2])
            g = prior * grad(p, p[2] - 1) + gap if minus >= 0 else -gap
            g[:n] += DECAY * theta[:n]
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:n], float(theta[n])


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None) -> Model:
    """Learns from rows that are not held out; prior: the share of toxic texts, by default that among the labelled ones."""
    given = labels.select(F.col(id_col).alias("i"), F.col(label).alias("y")).where(F.col("i").isNotNull() & ~held_out(F.col("i")))
    if prior is None:
        prior = given.agg(F.avg(F.col("y").cast("double"))).first()[0] or 0.0
    prior = min(max(prior, 1e-3), 0.5)
    rows = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.col(text)).alias("x")).where(F.col("i").isNotNull() & ~held_out(F.col("i"))).distinct()
    toxic = rows.join(given.where("y = 1").select("i").distinct(), "i")

    def sample(of: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        chosen = of.orderBy(F.xxhash64("i", F.lit("sample")), "i", "x").limit(most)
        t = docs.select(F.col(id_col).alias("i"), F.xxhash64(F.col(text)).alias("x"), F.col(text).alias("t")).join(F.broadcast(chosen), ["i", "x"])
        t = t.dropDuplicates(["i", "x"]).select("i", "x", terms(F.col("t")).alias("h")).toArrow()  # most rows
        return flat(t.sort_by([("i", "ascending"), ("x", "ascending")]).column("h").combine_chunks())

    return fit(sample(toxic, POSITIVES), sample(rows, UNLABELLED), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES rows at most
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, 1024):
                batch = big.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(shared.value(*flat(batch.column(1))))], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), terms(F.col(text)).alias("h")).mapInArrow(run, "doc_id bigint, score double")


def judge(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, **kw) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    s = score(docs, train(docs, labels, **kw))
    return s.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cutoff).cast("int").alias("predicted"))
