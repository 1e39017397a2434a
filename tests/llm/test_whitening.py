"""Whitening against exact fractions and a dense eigensolver."""

import math
from fractions import Fraction

import numpy as np
import pytest

from pathmine.llm import whitening as W


def spd(values, seed=1):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    v = q * np.array(values) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 64), np.geomspace(1e-9, 1e6, 40), [5.0] * 20 + [1.0] * 20, [3, 2, 1] + [0] * 30, [1e4] + [1 + 1e-9 * i for i in range(50)],
    [7.0], [0.0] * 4, np.r_[np.linspace(9, 10, 16), np.linspace(8.99, 8.999, 100)]])
def test_components_and_counts(values):
    v, values = spd(values), np.sort(values)[::-1]
    for s in (0.5, 1.5, 4.0, 9.5):
        assert W.above(v, s) == int((np.array(values) > s).sum())
    got, vectors = W.leading_components(v, 16)
    want = [x for x in values if x > max(values) * 1e-12][:16]
    assert len(got) == len(want)
    if len(want):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-13 * max(values))
        assert np.abs(vectors @ vectors.T - np.eye(len(want))).max() < 1e-12
        assert np.abs(v @ vectors.T - vectors.T * got).max() < 1e-13 * max(values) * len(values)


def reference(rows):
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({v for _, v in x})
    n, d = len(distinct), len(distinct[0])
    s = [sum(v[j] for v in distinct) for j in range(d)]
    y = [[Fraction(v[j] * n - s[j], n) for j in range(d)] for v in distinct]
    cov = np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    return x, n, s, cov, e[::-1], u[:, ::-1]


def test_against_fractions(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(c) for c in rng.standard_normal(20) * np.linspace(3, 0.4, 20) + 0.7]) for i in range(60)]
    rows = vectors + [(i + 100, v) for i, v in vectors[:9]] + [(200, None), (201, [None] + [0.0] * 19), (202, [float("nan")] * 20), (203, [float("inf")] * 20), (None, vectors[0][1])]
    df = spark.createDataFrame([(i, v, 1, 0.5) for i, v in rows], "vec_id long, embedding array<float>, n int, whitened double").repartition(5)
    kept = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    x, n, s, cov, e, u = reference(kept)
    got = W.whiten(df).collect()
    assert len(got) == 16 * len(x)
    per, of = {}, dict(x)
    for r in got:
        per.setdefault((r["vec_id"], r["component"]), r)
        assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(of[r["vec_id"]], s, strict=True))
        assert abs(r["explained"] - e[r["component"] - 1] / np.trace(cov)) < 1e-9 * r["explained"] and r["identity_error"] < 1e-10
    for k in range(16):
        want = {i: float((np.array(v, float) - np.array(s) / n) @ u[:, k] / np.sqrt(e[k])) for i, v in x}
        sign = np.sign(sum(want[i] * per[i, k + 1]["whitened"] for i in want))
        assert max(abs(sign * per[i, k + 1]["whitened"] - want[i]) for i in want) < 1e-7


def test_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert W.whiten(spark.createDataFrame([], schema)).count() == 0
    assert W.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0  # one distinct vector: no variance
    mixed = [(1, [1.0, 0.0]), (2, [0.0, 5.0]), (3, [9.0]), (4, [2.0]), (5, []), (6, [4.0, 4.0]), (7, [1e300, 0.0])]
    got = W.whiten(spark.createDataFrame(mixed, schema)).collect()
    assert sorted((r["vec_id"], r["component"]) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (6, 1), (6, 2)]
    assert {r["vec_id"]: r["n"] for r in got} == {1: 3, 2: 3, 3: 2, 4: 2, 6: 3}
    huge = [(i, [float(i) * 1e15, 3.0 * i * i]) for i in range(1, 8)]
    got = {(r["vec_id"], r["component"]): r for r in W.whiten(spark.createDataFrame(huge, schema)).collect()}
    assert all((r["deviation"] is None) == (i != 4) and r["identity_error"] < 1e-6 for (i, _), r in got.items())
    first = [got[i, 1]["whitened"] for i in range(1, 8)]
    assert np.allclose(np.abs(first), np.abs(np.arange(-3, 4) / 2), atol=1e-6)


def test_statistics_are_exact_in_any_order(spark):
    rows = [(i, [i * 0.37 % 5, -(i % 11) * 1e6, 2.0**40 + i]) for i in range(300)]
    a, b = (W.fit(W.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(k))) for k in (1, 9))
    assert a[3].n == b[3].n and a[3].sums == b[3].sums and np.array_equal(a[3].values, b[3].values) and np.array_equal(a[3].vectors, b[3].vectors)
