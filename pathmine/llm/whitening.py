"""Embedding whitening with components from contour integration (FEAST).

Vectors are quantised to integers, each distinct integer vector counts once, and count, sums and the matrix of products
of the centred vectors are exact integers (summed task by task, then row of the matrix by row), so the covariance is
rounded once, whatever the order of the tasks. Its leading components are found on the driver, whose memory is bounded by
the square of the vector length:

1. Inertia counts (signs of the pivots of a symmetric factorisation of V - sI) say how many eigenvalues lie above s.
   Bisection over them cuts the top of the spectrum into intervals of few eigenvalues.
2. For each interval a block of vectors is filtered by Gauss-Legendre quadrature of complex shifted solves
   (zI - V)^-1 Y on the circle around the interval, which projects onto its eigenvectors; Rayleigh-Ritz extracts them;
   both are repeated until the residuals are at rounding level.
3. The number found must equal the inertia count of the interval, so none is missed. A last Rayleigh-Ritz over all
   intervals makes the components orthogonal and is counted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathmine.llm import common as C

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this have no long x; such vectors are left out.
LARGEST = 1.4e17
_EPS = np.finfo(float).eps
_EXACT = 1 << 53


# ------------------------------------------------------------------ eigenvalues
def positives(a: np.ndarray) -> int:
    """Number of positive eigenvalues of a symmetric matrix: Bunch-Parlett pivots of order one and two."""
    a, found = np.array(a, float), 0
    while len(a):
        size = np.abs(a)
        p = int(np.argmax(np.diagonal(size)))
        on = size[p, p]
        np.fill_diagonal(size, 0)
        i, j = np.unravel_index(int(np.argmax(size)), size.shape)
        off = size[i, j]
        if not max(on, off):
            break
        order = np.arange(len(a))
        if on >= 0.6403882 * off:  # (1 + sqrt 17) / 8
            order[[0, p]] = order[[p, 0]]
            a = a[np.ix_(order, order)]
            found += a[0, 0] > 0
            a = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:] / a[0, 0])
        else:  # a pivot of order two is indefinite: one positive, one negative
            rest = np.delete(order, [i, j])
            b, c = a[np.ix_([i, j], [i, j])], a[np.ix_(rest, [i, j])]
            found += 1
            a = a[np.ix_(rest, rest)] - c @ np.linalg.solve(b, c.T)
        a = (a + a.T) / 2
    return int(found)


def above(v: np.ndarray, s: float) -> int:
    return positives(v - s * np.eye(len(v)))


def spectrum_cuts(v: np.ndarray, want: int, few: int = 8) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues inside), highest first, that hold at least the ``want`` largest positive
    eigenvalues (all positive ones if there are fewer), each with at most ``few`` unless they agree to rounding."""
    top = float(np.abs(v).sum(axis=1).max(initial=0)) * (1 + 1e-9)
    if not top:
        return []
    low = top * len(v) * 4 * _EPS  # smaller ones are rounding of zero
    n_low, high = above(v, low), top
    want = min(want, n_low)
    if not want:
        return []
    while n_low > want + few and high - low > 1e-13 * high:
        mid = float(np.sqrt(low * high))
        n = above(v, mid)
        if n >= want:
            low, n_low = mid, n
        else:
            high = mid
    out, todo = [], [(low, top, n_low, 0)]
    while todo:
        a, b, na, nb = todo.pop()
        if na == nb:
            continue
        if na - nb > few and b - a > 1e-13 * b:
            mid = float(np.sqrt(a * b))
            n = above(v, mid)
            todo += [(a, mid, na, n), (mid, b, n, nb)]
            continue
        for _ in range(12):  # a circle that hugs its eigenvalues filters better
            mid = (a + b) / 2
            n = above(v, mid) if b - a > 1e-9 * b else -1
            if n == nb:
                b = mid
            elif n == na:
                a = mid
            else:
                break
        out.append((a, b, na - nb))
    return sorted(out, reverse=True)


def contour_eigenpairs(v: np.ndarray, low: float, high: float, count: int, nodes: int = 8, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` in (low, high): (values, vectors as columns)."""
    d, norm = len(v), float(np.abs(v).sum(axis=1).max())
    slack = 64 * _EPS * norm if high - low <= 1e-12 * high else 0.0  # equal eigenvalues: computed ones scatter by rounding
    centre, radius = (low + high) / 2, (high - low) / 2 + slack
    x, w = np.polynomial.legendre.leggauss(nodes)
    angle = np.pi / 2 * (1 - x)
    turn = radius * np.exp(1j * angle)
    m, rng, eye = min(d, max(2 * count, count + 8)), np.random.default_rng(seed), np.eye(d)
    while True:
        y, best = rng.standard_normal((d, m)), np.inf
        for _ in range(60):
            u = sum(wk / 2 * np.real(tk * np.linalg.solve((centre + tk) * eye - v, y)) for wk, tk in zip(w, turn, strict=True))
            q, _ = np.linalg.qr(u)
            value, inner = np.linalg.eigh(q.T @ v @ q)
            y = q @ inner
            inside = (value > low - slack) & (value <= high + slack)
            error = np.linalg.norm(v @ y - y * value, axis=0)
            good = inside & (error <= 200 * _EPS * norm)
            worst = float(error[inside].max(initial=0))
            if good.sum() == count and inside.sum() == count and (worst <= 8 * _EPS * norm or worst >= best / 2):
                return value[inside], y[:, inside]
            best = min(best, worst)
        if m == d:
            raise ArithmeticError(f"{int(good.sum())} of {count} eigenvalues found in ({low}, {high})")
        m = min(d, 2 * m)


def leading_components(v: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as rows): the ``want`` largest positive ones, fewer if V has fewer."""
    cuts = spectrum_cuts(v, want)
    if not cuts:
        return np.zeros(0), np.zeros((0, len(v)))
    found = [contour_eigenpairs(v, *cut)[1] for cut in cuts]
    q, size, _ = np.linalg.svd(np.concatenate(found, axis=1), full_matrices=False)
    q = q[:, size > 0.5]  # a vector found in two touching intervals counts once
    value, inner = np.linalg.eigh(q.T @ v @ q)
    vectors = q @ inner
    lowest = cuts[-1][0]
    if (value > lowest).sum() != above(v, lowest):
        raise ArithmeticError("inertia count and components disagree")
    order = np.argsort(-value)[:want]
    return value[order], vectors[:, order].T


# ------------------------------------------------------------------ exact statistics
@dataclass
class Fit:
    """Statistics and components of the vectors of one length."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def __post_init__(self):
        self.floor = [s // self.n for s in self.sums]
        self.rest = np.array([s % self.n for s in self.sums], object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: whole part exact, one rounding at the end."""
        whole = _minus(x, self.floor)
        return whole.astype(float) - (self.rest / self.n).astype(float)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list:
        """Sum over dimensions of (n x - S)^2, exact; None where it fits no long."""
        whole = _minus(x, self.floor)
        bound = int(np.abs(whole).max(initial=0)) * self.n + self.n
        if bound * bound * max(1, x.shape[1]) < 1 << 63:
            y = whole.astype(np.int64) * self.n - self.rest.astype(np.int64)
            return (y * y).sum(axis=1).tolist()
        y = whole.astype(object) * self.n - self.rest
        return [s if s < 1 << 63 else None for s in (int(r) for r in (y * y).sum(axis=1))]


def _minus(x: np.ndarray, floor: list[int]) -> np.ndarray:
    """x - floor in integers that hold it."""
    small = int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) < 1 << 61 and all(abs(f) < 1 << 61 for f in floor)
    return x - np.array(floor, np.int64) if small else x.astype(object) - np.array(floor, object)


def _stack(b: pd.DataFrame) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, row positions, vectors) of the rows of one batch, by vector length."""
    sizes = b["x"].str.len().to_numpy()
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield int(d), at, np.stack(b["x"].iloc[at].to_numpy()).astype(np.int64).reshape(len(at), int(d))


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows whose vector is not null and holds finite entries only."""
    c = F.transform(F.col(f"`{vec_col}`"), lambda e: e.cast("double"))
    fits = F.forall("_c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) <= LARGEST))
    x = F.transform("_c", lambda e: F.floor(e * SCALE) + F.lit(SHIFT).cast("long"))
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), c.alias("_c")).where(
        F.col("_c").isNotNull() & F.coalesce(fits, F.lit(False))).select("vec_id", x.alias("x"))


def _added(parts: DataFrame) -> DataFrame:
    """Rows (d, i, n, values) summed by (d, i), exact integers as text; a row at a time, so a key's rows are never held."""
    n = max(1, int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, count, total = None, 0, None
        for b in batches:
            for d, i, k, values in zip(b["d"], b["i"], b["n"], b["values"], strict=True):
                row = [int(s) for s in values]
                if key == (d, i):
                    count, total = count + k, [p + q for p, q in zip(total, row, strict=True)]
                    continue
                if key:
                    yield _part(*key, count, total)
                key, count, total = (d, i), k, row
        if key:
            yield _part(*key, count, total)

    return parts.repartition(n, "d", "i").sortWithinPartitions("d", "i").mapInPandas(run, _PART)


_PART = "d int, i int, n long, values array<string>"


def _part(d: int, i: int, n: int, values: list) -> pd.DataFrame:
    return pd.DataFrame({"d": [d], "i": [i], "n": [n], "values": [[str(v) for v in values]]})


def sums(fit_list: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """(n, S) by vector length; the driver holds one row per length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for d, at, x in _stack(b):
                whole = x if len(x) * int(np.abs(x).max(initial=0)) < 1 << 62 else x.astype(object)
                n, total = held.get(d, (0, [0] * d))
                held[d] = (n + len(at), [s + int(t) for s, t in zip(total, whole.sum(axis=0), strict=True)])
        for d, (n, total) in held.items():
            yield _part(d, 0, n, total)

    return {r["d"]: (r["n"], [int(s) for s in r["values"]]) for r in _added(fit_list.mapInPandas(run, _PART)).collect()}


def covariances(fit_list: DataFrame, found: dict[int, tuple[int, list[int]]]) -> Iterator[tuple[int, np.ndarray]]:
    """(length, covariance), divisor n: products of x - floor(S/n) summed exactly, the rest of the mean taken off exactly.
    The driver holds the matrix of one length at a time."""
    floors = {d: [s // n for s in total] for d, (n, total) in found.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _stack(b):
                y = _minus(x, floors[d])
                m = int(np.abs(y).max(initial=0))
                # products of small integers are exact in double precision, larger ones are multiplied as integers
                g = (y.T.astype(float) @ y.astype(float)).astype(np.int64) if m * m * len(y) < _EXACT else y.astype(object).T @ y.astype(object)
                held[d] = g.astype(object) + held[d] if d in held else g.astype(object)
        for d, g in held.items():
            for i, row in enumerate(g):
                yield _part(d, i, 0, row)

    rows = C.written(_added(fit_list.mapInPandas(run, _PART)), "whitening-products")
    for d in sorted(k for k in found if k):
        n, total = found[d]
        g, t = np.zeros((d, d), object), np.array([s % n for s in total], object)
        for r in rows.where(F.col("d") == d).toLocalIterator():
            g[r["i"]] = [int(v) for v in r["values"]]
        exact = g * n - np.outer(t, t)
        yield d, np.array([[v / (n * n) for v in row] for row in exact], float)


def fit(vectors_x: DataFrame, components: int = 16) -> dict[int, Fit]:
    """Fits by vector length over the distinct vectors of ``vectors_x`` (column x)."""
    fit_list = C.written(vectors_x.select("x").distinct(), "whitening-fit")
    found = sums(fit_list)
    out = {}
    for d, v in covariances(fit_list, found):
        values, vectors = leading_components(v, components)
        out[d] = Fit(*found[d], values, vectors, float(np.trace(v)))
    for d, error in identity_errors(fit_list, out).items():
        out[d].identity_error = error
    return out


def identity_errors(fit_list: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, by vector length."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, x in _stack(b):
                if d in fits and len(fits[d].values):
                    w = fits[d].project(x)
                    one = np.concatenate([w, np.ones((len(w), 1))], axis=1)
                    held[d] = held.get(d, 0) + one.T @ one
        for d, g in held.items():
            yield pd.DataFrame({"d": d, "at": np.arange(g.size), "value": g.ravel()})

    entries = fit_list.mapInPandas(run, "d int, at int, value double").groupBy("d", "at").agg(F.sum("value").alias("value")).collect()
    out = {}
    for d in {r["d"] for r in entries}:
        k = len(fits[d].values) + 1
        g = np.zeros(k * k)
        for r in entries:
            if r["d"] == d:
                g[r["at"]] = r["value"]
        g = g.reshape(k, k) / fits[d].n
        out[d] = float(np.abs(g[:-1, :-1] - np.outer(g[:-1, -1], g[-1, :-1]) - np.eye(k - 1)).max())
    return out


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 16) -> DataFrame:
    """Per remaining row and component (from 1, falling eigenvalue): vec_id, component, n, deviation, whitened, explained,
    identity_error.

    Rows whose vector is null or holds null, non-finite or larger than 1.4e17 entries are left out. Equal vectors count
    once in the fit and each get their rows; null ids are kept. Vectors of different lengths have a fit each. Components
    exist for positive eigenvalues only: a fit of one vector, vectors without entries and an empty table give no rows.
    ``deviation`` is null where it fits no long. Other columns are not read.
    """
    C.bounded_batches(vectors.sparkSession)
    rows = quantised(vectors, id_col, vec_col)
    fits = fit(rows, components)  # count, sums and components only: bounded by the vector lengths, not by the rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = b["vec_id"].astype("Int64")
            for d, at, x in _stack(b):
                f = fits.get(d)
                if f is None or not len(f.values):
                    continue
                k = len(f.values)
                yield pd.DataFrame({
                    "vec_id": ids.iloc[np.repeat(at, k)].array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(at)), "n": f.n,
                    "deviation": pd.array(np.repeat(np.array(f.deviations(x), object), k), "Int64"), "whitened": f.project(x).ravel(),
                    "explained": np.tile(f.values / f.trace, len(at)), "identity_error": f.identity_error})

    return rows.mapInPandas(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
