"""Embedding whitening by principal components (operator 12).

Entries become integers, x = floor(64 c) + 1,000,000, and all that is summed over rows stays exact or is centred first. The
fit list holds each x vector once. Its size n and its sums S give centred entries (n x - S) / n, whose difference is exact. Every task adds up the
products of its own centred rows; the matrices of the tasks are added by a shuffle of their cells, so the driver gets d times d numbers whatever the size
of the input. There, on that one small matrix: Householder reflections to a tridiagonal one, bisection by Sturm counts for the
leading eigenvalues, inverse iteration for their vectors, in which those of close eigenvalues are made orthogonal to each other
in every step, and the reflections taken back. The projection (d times 16) is broadcast, and a second pass
over the fit list measures the covariance of what it gives.

Defined cases: vectors that are null, empty, or hold nulls or entries that aren't finite are dropped; of vectors of unequal lengths,
those of the commonest length stay (of equally common ones, the longest); null and repeated ids are given row by row; directions
without variance (eigenvalues below ``LEAST`` of the norm, whose direction double precision doesn't tell) have no component, so that
fewer than 16 rows a vector may come; an empty table, or one of equal vectors, gives no rows; entries beyond ``BEYOND`` count as that;
deviations are exact as long as they fit a long; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
EPS = float(np.finfo(float).eps)
#: Eigenvalues nearer than this share of the norm are one cluster.
CLUSTER = 1e-3
LEAST = 1e-11
BEYOND = 2.0**40
#: Rows whose products are added up at once.
ROWS = 4096
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _vectors(column: pa.Array) -> np.ndarray:
    """The x vectors, one a row, of a column of lists of one length."""
    values = np.asarray(column.flatten())
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)


def integers(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that remain."""
    v = F.col(vector)
    number = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, number))
    lengths = sound.groupBy(F.size(v).alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    d = lengths["d"] if lengths else 0

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = np.asarray(batch.column(1).flatten())
            x = np.floor(np.clip(c, -BEYOND, BEYOND) * SCALE).astype(np.int64) + SHIFT
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, max(d, 1), dtype=np.int32)), pa.array(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["vec_id", "x"])

    kept = sound.where(F.size(v) == d).select(F.col(id_col).cast("long").alias("i"), v.cast("array<double>").alias("c"))
    return kept.mapInArrow(shift, "vec_id bigint, x array<bigint>")


def _added(rows: DataFrame, matrix) -> np.ndarray:
    """The sum over all rows of matrix(x vectors of some rows): a matrix a task, whose cells are added by a shuffle."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _vectors(batch.column(0))
            for at in range(0, len(x), ROWS):
                m = matrix(x[at : at + ROWS])
                total = m if total is None else total + m
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    kind = "bigint" if matrix is _sums else "double"
    cells = rows.select("x").mapInArrow(add, f"i bigint, j bigint, v {kind}").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()  # as many as the matrix has
    if not len(cells):
        return np.empty((0, 0))
    out = np.zeros((int(cells["i"].max()) + 1, int(cells["j"].max()) + 1), np.int64 if kind == "bigint" else float)
    out[cells["i"], cells["j"]] = cells["v"]
    return out


def _sums(x: np.ndarray) -> np.ndarray:
    """The sums of the dimensions, and the count."""
    return np.append(x.sum(axis=0), len(x))[None, :]


def _products(y: np.ndarray) -> np.ndarray:
    return y.T @ y


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal, and the Householder vectors that bring a symmetric matrix to that form."""
    a, n, used = a.copy(), len(a), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        v = v / size if size else v
        used.append(v)
        w = a[k + 1 :, k + 1 :]
        p = w @ v
        p -= (v @ p) * v
        w -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1, k] -= 2 * v[0] * (v @ a[k + 1 :, k])
        a[k + 2 :, k] = 0
    return np.diag(a).copy(), np.diag(a, -1).copy(), used


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: how many eigenvalues of the tridiagonal matrix are less than each x."""
    q, least = d[0] - x, EPS * (np.abs(d).max() + np.abs(e).max(initial=0.0)) * EPS
    n = (q < 0).astype(int)
    for k in range(1, len(d)):
        q = np.where(np.abs(q) < least, -least - np.finfo(float).tiny, q)
        q = d[k] - x - e[k - 1] ** 2 / q
        n += q < 0
    return n


def leading(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues, falling, each bisected until its interval can't be halved."""
    n = len(d)
    radius = np.append(np.abs(e), 0) + np.append(0, np.abs(e))
    low, high = np.full(k, (d - radius).min()), np.full(k, (d + radius).max())
    slack = 2 * EPS * n * max(abs(low[0]), abs(high[0])) + np.finfo(float).tiny
    low, high = low - slack, high + slack
    want = n - 1 - np.arange(k)  # number of smaller ones
    while True:
        mid = (low + high) / 2
        if not ((low < mid) & (mid < high)).any():
            return mid
        right = below(d, e, mid) <= want
        low, high = np.where(right, mid, low), np.where(right, high, mid)


def _solve(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift)^-1 b by elimination with exchanges of neighbouring rows; pivots of zero count as rounding errors."""
    n, tiny = len(d), EPS * (np.abs(d).max() + np.abs(e).max(initial=0.0)) or 1.0
    u, up, upp, b = d - shift, np.append(e, 0.0), np.zeros(n), b.copy()
    for k in range(n - 1):
        low, nxt, after = e[k], u[k + 1], up[k + 1]
        if abs(low) > abs(u[k]):
            m = u[k] / low
            u[k], old, b[k], keep = low, up[k], b[k + 1], b[k]
            up[k], upp[k] = nxt, after
            u[k + 1], up[k + 1], b[k + 1] = old - m * nxt, -m * after, keep - m * b[k]
        else:
            m = low / (u[k] if u[k] else tiny)
            u[k + 1], b[k + 1] = nxt - m * up[k], b[k + 1] - m * b[k]
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        rest = b[k] - (up[k] * x[k + 1] if k + 1 < n else 0) - (upp[k] * x[k + 2] if k + 2 < n else 0)
        x[k] = rest / (u[k] if abs(u[k]) > tiny * EPS else np.copysign(tiny * EPS, u[k]))
        if abs(x[k]) > 1e200:
            x, b = x / 1e200, b / 1e200
    return x


def components(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a covariance, falling, and their unit vectors as columns; none for eigenvalues at rounding error."""
    n = len(v)
    norm = np.abs(v).sum(axis=0).max(initial=0.0)
    if not n or not norm:
        return np.empty(0), np.empty((n, 0))
    d, e, used = tridiagonal(v)
    values = leading(d, e, min(k, n))
    values = values[values > LEAST * norm]
    found: list[np.ndarray] = []
    random = np.random.default_rng(1)
    first = 0  # of the present cluster
    for i, value in enumerate(values):
        if i and values[i - 1] - value > CLUSTER * norm:
            first = i
        # shifts within a cluster differ, so that their solutions do
        shift = min(value, values[i - 1] - 10 * EPS * norm) if i > first else value
        x = random.normal(size=n)
        for _ in range(6):
            x = _solve(d, e, shift, x / np.linalg.norm(x))
            for _ in range(2):
                for other in found[first:]:
                    x = x - (other @ x) / (other @ other) * other
            x = x / np.linalg.norm(x)
        found.append(x)
    out = np.array(found).T.reshape(n, len(found))
    for at in range(len(used) - 1, -1, -1):
        h = used[at]
        out[at + 1 :] -= 2 * np.outer(h, h @ out[at + 1 :])
    return values, out / np.linalg.norm(out, axis=0)


def fit(x: DataFrame, k: int = COMPONENTS) -> dict | None:
    """n, S, components, eigenvalues, trace and the identity error of the fit list; x: (vec_id, x). None without rows."""
    once = written(x.select("x").distinct(), "fit-list")
    sums = _added(once, _sums)
    if not sums.size:
        return None
    s, n = sums[0, :-1], int(sums[0, -1])
    v = _added(once, lambda a: _products((n * a - s) / n)) / n
    values, vectors = components((v + v.T) / 2, k)
    w = vectors / np.sqrt(values)
    mean = _added(once, lambda a: ((n * a - s) / n @ w).sum(axis=0)[None, :]) / n
    white = _added(once, lambda a: _products((n * a - s) / n @ w - mean)) / n
    error = float(np.abs(white - np.eye(len(values))).max(initial=0.0)) if len(values) else 0.0
    return {"n": n, "sums": s, "project": w, "values": values, "trace": float(np.trace(v)), "identity_error": error}


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector that remains and each component."""
    spark = rows.sparkSession
    x = integers(rows, id_col, vector)
    model = fit(x, k)
    if model is None or not len(model["values"]):
        return spark.createDataFrame([], OUT)
    shared = spark.sparkContext.broadcast(model)  # d times k numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        n, c = m["n"], len(m["values"])
        for batch in batches:
            apart = n * _vectors(batch.column(1)) - m["sums"]
            white, deviation = apart / n @ m["project"], (apart * apart).sum(axis=1)
            size = len(apart)
            cols = [
                batch.column(0).take(pa.array(np.repeat(np.arange(size), c))),
                pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), size)),
                pa.array(np.full(size * c, n)),
                pa.array(np.repeat(deviation, c)),
                pa.array(white.ravel()),
                pa.array(np.tile(m["values"] / m["trace"], size)),
                pa.array(np.full(size * c, m["identity_error"])),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(project, OUT)
