"""Whitening of vectors by the eigenvectors of their covariance, refined to double precision.

Components become integers x = floor(SCALE * c) + SHIFT, so that sums are exact: one pass gives count and sums, a second
the sums of products of what is left after the whole part of the mean is taken out (centred before multiplying; what the
fraction of the mean adds is a product of two sums, taken out exactly). Both passes reduce a task's rows to one number
for each dimension or pair of dimensions, added up again by Spark; the driver gets dim^2 / 2 of them whatever the number
of rows.

The covariance is decomposed on the driver: first in single precision, then corrected by the iteration of Ogita and Aishima, which needs
matrix products only, in extended precision. With R = I - X'X and S = X'AX it adds to X the product of X with (s_ij + l_j r_ij) /
(l_j - l_i), or r_ij / 2 where two eigenvalues are nearer than the error bound. The columns of such a cluster are turned by
the eigenvectors of A - m projected on them, m their mean, whose small spread a sub-solve in double precision resolves; the next
step continues with the bound so gained.

A third pass measures the covariance of the whitened rows (whose mean follows from the sums of the first), a last one
writes them. Nothing is shuffled but the sums.

Defined results: vectors that are null or hold null, NaN or infinite components are dropped; vectors of each dimension
are a fit of their own; rows that repeat an id, or have none, are rows of their own. A component without variance (its
eigenvalue is zero within working precision) has whitened and explained 0 and takes no part in identity_error, which is 0
where none is left. Components beyond 2^30 in size count as that; a deviation that no long holds is null. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import slices
from inkwell.llm.vector_codes import finite

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Steps of refinement at most; three or four do where no eigenvalues are close.
STEPS = 12
_LIMIT, _HALF = 1 << 30, 31


def refined_eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors in columns of a symmetric matrix of extended precision."""
    wide = np.longdouble
    size = len(a)
    scale = np.abs(a).max(initial=0)
    if not scale:
        return np.zeros(size, wide), np.eye(size, dtype=wide)
    a = a / scale
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(wide)
    one, eps = np.eye(size, dtype=wide), np.finfo(wide).eps
    norm = lambda m: np.sqrt((m * m).sum())  # noqa: E731  the spectral norm is not above it
    for _ in range(STEPS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        value = np.diag(s) / (1 - np.diag(r))
        order = np.argsort(value)
        x, r, s, value = x[:, order], r[np.ix_(order, order)], s[np.ix_(order, order)], value[order]
        near = 2 * (norm(s - np.diag(value)) + norm(a) * norm(r))
        gap = value[None, :] - value[:, None]
        far = np.abs(gap) > near
        change = np.where(far, (s + value[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ change
        cuts = np.flatnonzero(np.diff(value) > near) + 1
        for run in np.split(np.arange(size), cuts):
            if len(run) > 1:
                part = x[:, run]
                left = part.T @ (a @ part) - value[run].mean() * (part.T @ part)
                left = (left + left.T) / 2
                if norm(left) > eps * norm(a):
                    x[:, run] = part @ np.linalg.eigh((left / norm(left)).astype(np.float64))[1].astype(wide)
        if np.abs(change).max() < 64 * eps and len(cuts) == size - 1:
            break
    x = x + x @ (one - x.T @ x) / 2
    value = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-value, kind="stable")
    return value[order] * scale, x[:, order]


def shifted(flat: np.ndarray, dim: int) -> np.ndarray:
    """floor(SCALE * c) + SHIFT of vectors laid end to end, rows x dim."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(flat.astype(np.float64) * SCALE), -_LIMIT, _LIMIT).astype(np.int64).reshape(-1, dim) + SHIFT


def _by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """(dim, rows, shifted components) of the vectors in batches that have components."""
    for b in slices(batches, 16_384):
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            if dim:
                rows = b.filter(pa.array(dims == dim))
                yield dim, rows, shifted(rows.column("v").flatten().to_numpy(zero_copy_only=False), dim)


def _summed(rows: DataFrame, term: Callable[[int, np.ndarray], list[np.ndarray]], kind: str) -> dict[tuple[int, int], list]:
    """For each dimension and place the sums over all rows of the arrays that term gives for a block of vectors: a task
    adds up its own, then Spark."""
    arrow = pa.int64() if kind == "long" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for dim, _, x in _by_dimension(batches):
            new = term(dim, x)
            sums[dim] = [a + b for a, b in zip(sums[dim], new, strict=True)] if dim in sums else new
        for dim, (high, low) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(high), dim), pa.int32()), pa.array(np.arange(len(high)), pa.int32()), pa.array(high, arrow), pa.array(low, arrow)], ["dim", "at", "high", "low"])

    found = rows.mapInArrow(run, f"dim int, at int, high {kind}, low {kind}")
    return {(r["dim"], r["at"]): [r["high"], r["low"]] for r in found.groupBy("dim", "at").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}


def _products(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exact matrix z'z of integers as high * 2^31 + low."""
    largest = int(np.abs(z).max(initial=0))
    step = max(1, min(len(z), (1 << 53) // max(1, largest**2) - 1)) if largest < 1 << 26 else 1
    high = low = np.zeros((z.shape[1], z.shape[1]), np.int64)
    for at in range(0, len(z), step):
        block = z[at : at + step]
        whole = (block.T.astype(np.float64) @ block.astype(np.float64)).astype(np.int64) if largest < 1 << 26 else block.T @ block
        high, low = high + (whole >> _HALF), low + (whole & ((1 << _HALF) - 1))
    return high, low


class Fit:
    """Count, sums, covariance and its leading eigenvectors of the vectors of one dimension."""

    def __init__(self, n: int, sums: list[int], middle: list[int], products: np.ndarray, components: int):
        """sums of the shifted components, middle the whole parts of their means, products (of Python's integers) of
        what is above middle."""
        self.n, self.dim = n, len(sums)
        self.middle = np.array(middle, np.int64)
        self.rest = [s - n * m for s, m in zip(sums, middle, strict=True)]
        rest = np.array(self.rest, object)
        exact = n * products - np.outer(rest, rest)
        wide = np.longdouble
        self.covariance = np.array([[wide(v) for v in row] for row in exact], wide).reshape(self.dim, self.dim) / wide(n) / wide(n)
        value, vector = refined_eigen(self.covariance)
        value, vector = value[:components], vector[:, :components]
        trace = np.trace(self.covariance)
        alive = value > trace * self.dim * wide(2) ** -58
        vector = vector * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(len(value))])
        self.alive = alive
        self.explained = np.where(alive, value / trace if trace else 0, 0).astype(np.float64)
        self.turn = (vector * np.where(alive, 1 / np.sqrt(np.where(alive, value, 1)), 0)).astype(np.float64)
        fraction = np.array([wide(r) for r in self.rest], wide) / wide(n)
        self.fraction = fraction.astype(np.float64)
        # of the whitened rows as computed: what rounding the fraction has left
        self.mean = ((fraction - self.fraction.astype(wide)) @ self.turn.astype(wide)).astype(np.float64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle) - self.fraction) @ self.turn

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)^2 of each row, exactly."""
        z = x - self.middle
        bound = self.n * int(np.abs(z).max(initial=0)) + max(map(abs, self.rest), default=0)
        if self.dim * bound**2 < 1 << 63:
            return ((self.n * z - np.array(self.rest, np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * z.astype(object) - np.array(self.rest, object)) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """For each dimension the fit of rows (dim, v)."""

    def totals(dim: int, x: np.ndarray) -> list[np.ndarray]:
        return [x.sum(axis=0), np.full(dim, len(x))]

    first = _summed(rows, totals, "long")
    dims = sorted({d for d, _ in first})
    sums = {d: [first[d, i][0] for i in range(d)] for d in dims}
    n = {d: first[d, 0][1] for d in dims}
    middle = {d: [(2 * s + n[d]) // (2 * n[d]) for s in sums[d]] for d in dims}

    def products(dim: int, x: np.ndarray) -> list[np.ndarray]:
        at = np.triu_indices(dim)
        return [m[at] for m in _products(x - np.array(middle[dim], np.int64))]

    second, fits = _summed(rows, products, "long"), {}
    for d in dims:
        whole = np.zeros((d, d), object)
        for at, (i, j) in enumerate(zip(*np.triu_indices(d), strict=True)):
            high, low = second[d, at]
            whole[i, j] = whole[j, i] = (high << _HALF) + low
        fits[d] = Fit(n[d], sums[d], middle[d], whole, components)
    return fits


def identity_errors(rows: DataFrame, fits: dict[int, Fit]) -> dict[int, float]:
    """For each dimension the largest difference between the covariance of the whitened rows and the identity."""

    def products(dim: int, x: np.ndarray) -> list[np.ndarray]:
        w = fits[dim].whitened(x) - fits[dim].mean
        return [(w.T @ w).reshape(-1), np.zeros(w.shape[1] ** 2)]

    found = _summed(rows, products, "double")
    out = {}
    for d, fit in fits.items():
        k = len(fit.alive)
        got = np.array([found[d, i][0] for i in range(k * k)]).reshape(k, k) / fit.n
        out[d] = float(np.abs(got - np.eye(k))[np.ix_(fit.alive, fit.alive)].max(initial=0.0))
    return out


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    rows = vectors.filter(finite(F.col(vector_column)))
    rows = rows.select(F.size(vector_column).alias("dim"), F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    fits = fit_whitening(rows, components)
    errors = identity_errors(rows, fits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, b, x in _by_dimension(batches):
            fit = fits[dim]
            w, deviation, k = fit.whitened(x), pa.array(fit.deviation(x), pa.int64()), len(fit.alive)
            each = pa.array(np.repeat(np.arange(len(x)), k))
            full = lambda v, t: pa.array(np.full(len(x) * k, v), t)
            columns = [b.column("vec_id").take(each), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), full(fit.n, pa.int64()), deviation.take(each), pa.array(w.reshape(-1)), pa.array(np.tile(fit.explained, len(x))), full(errors[dim], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
