"""Whitening against whole-matrix arithmetic, the eigensolver on hard matrices, odd rows."""

import math

import numpy as np
import pytest
from loomdoc.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, x int, n string"


def plain(rows, k=16):
    """{(vec_id, component): (n, deviation, |whitened|, explained)} with Python's integers and numpy's own solver."""
    sound = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in sound]
    fit = sorted({tuple(x) for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in fit])
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in xs:
        apart = [n * a - b for a, b in zip(x, s, strict=True)]
        white = np.array([a / n for a in apart]) @ u / np.sqrt(e)
        for c in range(len(e)):
            out[i, c + 1] = (n, sum(a * a for a in apart), white[c], e[c] / np.trace(y.T @ y / n))
    return out


def compare(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, white, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(white) > 1e-3:
            sign.setdefault(r["component"], np.sign(white) * np.sign(r["whitened"]))
        assert r["whitened"] * sign.get(r["component"], 1) == pytest.approx(white, abs=1e-7)
        assert r["explained"] == pytest.approx(explained, rel=1e-9)
        assert r["identity_error"] < 1e-8
    assert len({r["identity_error"] for r in got}) <= 1


def test_given_vectors(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    compare(whitening.whiten(v).collect(), plain([(r["vec_id"], r["embedding"]) for r in v.collect()]))


def test_odd_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in r.normal(size=6) * [3, 2, 1.5, 1, 0.5, 0.25]]) for i in range(400)]
    hot = [(1000 + i, rows[0][1]) for i in range(300)]
    bad = [(2000, None), (2001, []), (2002, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2003, [float("nan")] * 6), (2004, [1.0] * 5 + [float("inf")]), (2005, [-math.inf] + [0.0] * 5)]
    short = [(3000 + i, [1.0, 2.0]) for i in range(20)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + hot + bad + short], SCHEMA).repartition(5)
    got = whitening.whiten(df).collect()
    compare(got, plain(rows + hot))
    assert got[0]["n"] == 400 and max(r["component"] for r in got) == 6


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], SCHEMA)
    equal = spark.createDataFrame([(i, [1.0, 2.0], 1, "x") for i in range(5)], SCHEMA)
    null = spark.createDataFrame([(1, None, 1, "x")], SCHEMA)
    for df in (empty, equal, null):
        out = whitening.whiten(df)
        assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_directions_without_variance(spark):
    r = np.random.default_rng(4)
    rows = []
    for i in range(200):
        a, b = (float(np.float32(x)) for x in r.integers(-200, 200, size=2) / 64)
        rows.append((i, [a, b, a, 0.0], 1, "x"))
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["component"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-9


def matrices():
    r = np.random.default_rng(0)
    q = np.linalg.qr(r.normal(size=(50, 50)))[0]
    turned = lambda values: ((q * values) @ q.T + ((q * values) @ q.T).T) / 2
    yield from ((lambda a: a.T @ a / len(a))(r.normal(size=(d + 40, d))) for d in (1, 2, 3, 7, 64))
    yield np.eye(40)
    yield np.diag([5.0] * 10 + [1.0] * 10)
    yield turned(np.repeat([9, 4, 1, 0.5, 0.1], 10) + r.normal(size=50) * 1e-12)
    yield turned(np.array([1.0] * 3 + [1e-6] * 2 + [0] * 45))
    yield turned(10.0 ** -np.arange(50))
    yield np.diag(np.abs(np.arange(21) - 10.0)) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield np.zeros((4, 4))


def test_components():
    for v in matrices():
        values, vectors = whitening.components(v)
        top = np.linalg.eigvalsh(v)[::-1][: len(values)]
        scale = max(np.abs(v).max(), 1e-300)
        assert len(values) == min(16, (np.linalg.eigvalsh(v) > whitening.LEAST * np.abs(v).sum(axis=0).max()).sum())
        assert np.abs(values - top).max(initial=0) < 1e-14 * scale * len(v)
        assert np.abs(v @ vectors - vectors * values).max(initial=0) < 1e-13 * scale
        assert np.abs(vectors.T @ vectors - np.eye(len(values))).max(initial=0) < 1e-13


def test_sturm_counts():
    r = np.random.default_rng(1)
    d, e = r.normal(size=30), r.normal(size=29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.linspace(-5, 5, 101)
    assert (whitening.below(d, e, at) == (values[None, :] < at[:, None]).sum(axis=1)).all()
