"""Embedding whitening: principal components by cyclic Jacobi, scaled to unit variance.

The fit list is each distinct vector once. Its length and sums are exact; its scatter is centred
first and summed per task, then over tasks, so what reaches the driver is one number per pair of
dimensions. The driver turns pairs of dimensions by Jacobi rotations, sweep after sweep over all pairs,
until every off-diagonal entry is negligible beside the two diagonal entries it stands between; that
criterion (not one beside the whole matrix) is what keeps small eigenvalues accurate. Pairs are
taken in the order of a round-robin tournament: the pairs of a round share no dimension, so their
rotations are one array operation. Components are sorted by falling eigenvalue and the whitening
matrix is broadcast (width squared numbers).

Defined results: rows whose vector is null or holds a null or an entry that is not finite are left out;
the width is that of the vector of the smallest id, and vectors of another width take no part in the
fit and get null for deviation and whitened; a component whose eigenvalue is zero up to rounding (as all
are where the list has one vector) has null whitened and takes no part in the identity error; repeated rows
are returned one to one; a deviation beyond a long is null; no rows give no rows; a width under the
number of components gives as many as there are dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlume.llm import codes, vectors
from barlume.llm.common import materialize

COMPONENTS = 4
SWEEPS = 60


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors, one a row, of a symmetric matrix."""
    a = np.array(matrix, np.float64)
    n = len(a)
    turned = np.eye(n)  # rows are the eigenvectors so far
    seats = np.arange(n + n % 2)
    eps, last = np.finfo(np.float64).eps, np.inf
    for _ in range(SWEEPS):
        moved = 0.0
        for _ in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = np.sort(np.stack([seats[:half], seats[half:][::-1]], axis=1), axis=1)
            pairs = pairs[pairs[:, 1] < n]
            p, q = pairs[:, 0], pairs[:, 1]
            off, dp, dq = a[p, q], a[p, p], a[q, q]
            big = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(dp * dq)), np.finfo(np.float64).tiny)
            if big.any():
                p, q, off, dp, dq = p[big], q[big], off[big], dp[big], dq[big]
                moved = max(moved, float(np.abs(off).max()))
                with np.errstate(over="ignore"):  # a tangent of zero is right then
                    theta = (dq - dp) / (2 * off)
                    t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.sqrt(theta * theta + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                c1, s1 = c[:, None], s[:, None]
                a[p], a[q] = c1 * a[p] - s1 * a[q], s1 * a[p] + c1 * a[q]
                a[:, p], a[:, q] = c * a[:, p] - s * a[:, q], s * a[:, p] + c * a[:, q]
                a[p, p], a[q, q] = dp - t * off, dq + t * off
                a[p, q] = a[q, p] = 0.0
                turned[p], turned[q] = c1 * turned[p] - s1 * turned[q], s1 * turned[p] + c1 * turned[q]
            seats = np.r_[seats[0], seats[-1], seats[1:-1]]
        if not moved or (moved >= last and moved <= 4 * eps * np.abs(np.diag(a)).max()):  # vanished, or rounding is all that is left
            break
        last = moved
    values = np.diag(a).copy()
    by = np.argsort(-values, kind="stable")
    turned = turned[by]
    sign = np.sign(turned[np.arange(n), np.abs(turned).argmax(axis=1)]) if n else np.ones(0)
    return values[by], turned * sign[:, None]


@dataclass(frozen=True)
class Model:
    """``n`` distinct vectors of ``width`` with exact ``sums``; ``whiten`` has one row per component that can be scaled."""

    n: int
    width: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    identity_error: float | None = None

    @property
    def trace(self) -> float:
        return float(self.variances.sum())

    def scaled(self, components: int) -> np.ndarray:
        """Whitening matrix: a row of NaN where the eigenvalue is zero up to the rounding of the variances that it mixes."""
        e, axes = self.values[:components], self.axes[:components]
        mixed = (np.abs(axes) @ np.sqrt(np.maximum(self.variances, 0.0))) ** 2
        ok = e > max(1, self.width) * np.finfo(np.float64).eps * mixed
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(ok[:, None], axes / np.sqrt(e)[:, None], np.nan)

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _summed(rows: DataFrame, run, keys: str, value: str) -> list:
    """Partial sums per task, summed over tasks: bounded by the number of keys."""
    out = rows.mapInArrow(run, ", ".join([*(f"{k} int" for k in keys.split()), value]))
    return out.groupBy(*keys.split()).agg(*(F.sum(c.split()[0]).alias(c.split()[0]) for c in value.split(", "))).collect()


def distinct_vectors(x: DataFrame, width: int) -> DataFrame:
    """The fit list, written once as three passes read it. Copies meet within a task before any is shuffled."""
    return materialize(x.where(F.size("x") == width).select("x").distinct(), "whitening-fit")


def fit(x: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of the ``id`` and ``x`` of ``codes.numbers``; None without rows."""
    first = vectors.smallest(x, 1)
    if not first:
        return None
    width = len(first[0])
    rows = distinct_vectors(x, width)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for b in vectors.blocks(batches, width):
            m = vectors.matrix(b.column(0), width) if width else np.zeros((b.num_rows, 0), np.int64)
            fits = not m.size or float(np.abs(m.astype(np.float64)).max()) * len(m) < 2**62
            total += (m if fits else m.astype(object)).sum(axis=0)
            n += b.num_rows
        out = [-1, *range(width)], [Decimal(n), *(Decimal(int(t)) for t in total)]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.decimal128(38, 0))], names=["dim", "total"])

    got = {r.dim: int(r.total) for r in _summed(rows, sums, "dim", "total decimal(38,0)")}
    n, total = got[-1], [got[d] for d in range(width)]
    model = Model(n, width, total, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    scatter = _second_moment(rows, width, model.mean, np.eye(width)) / n
    values, axes = jacobi(scatter)
    model = Model(n, width, total, values, axes, np.diag(scatter).copy())
    k = min(components, width)
    matrix = model.scaled(k)
    use = ~np.isnan(matrix).any(axis=1) if k else np.zeros(0, bool)
    error = None
    if use.any():
        identity = _second_moment(rows, width, model.mean, matrix[use]) / n
        error = float(np.abs(identity - np.eye(int(use.sum()))).max())
    return Model(n, width, total, values, axes, model.variances, error)


def _second_moment(rows: DataFrame, width: int, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The sum over rows of (matrix (x - mean)) times its transpose."""
    k = len(matrix)
    plain = matrix.shape == (width, width) and np.array_equal(matrix, np.eye(width))
    held = rows.sparkSession.sparkContext.broadcast((mean, None if plain else matrix))
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, turn = held.value
        total, any_rows = np.zeros((k, k)), False
        for b in vectors.blocks(batches, width):
            c = vectors.matrix(b.column(0), width) - middle
            c = c if turn is None else c @ turn.T
            total += c.T @ c
            any_rows = True
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "total"])

    out = np.zeros((k, k))
    for r in _summed(rows, run, "i j", "total double") if k else []:
        out[r.i, r.j] = out[r.j, r.i] = r.total
    return out


def apply(x: DataFrame, model: Model, components: int = COMPONENTS) -> DataFrame:
    """(id, component, deviation, whitened) of every row of ``codes.numbers`` and component."""
    width, n, k = model.width, model.n, min(components, model.width)
    held = x.sparkSession.sparkContext.broadcast((model.sums, model.mean, model.scaled(k)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, mean, matrix = held.value
        blank = np.isnan(matrix).any(axis=1)
        for b in vectors.blocks(batches, width):
            there = np.flatnonzero(np.asarray(b.column(1).is_valid()))
            m = vectors.matrix(b.column(1), width)
            most = n * float(np.abs(m.astype(np.float64)).max(initial=0)) + max(map(abs, sums), default=0)
            if most * most * width < 2**62:
                apart = ((n * m - np.array(sums, np.int64)) ** 2).sum(axis=1)
            else:
                apart = ((n * m.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)
            white = (m - mean) @ np.where(blank[:, None], 0.0, matrix).T
            deviation, whitened = np.full(b.num_rows, None, object), np.full((b.num_rows, k), None, object)
            deviation[there] = [int(v) if v <= vectors.LONG else None for v in apart]
            whitened[there] = white
            whitened[:, blank] = None
            at = pa.array(np.repeat(np.arange(b.num_rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()),
                    pa.array(np.repeat(deviation, k), pa.int64()), pa.array(whitened.ravel(), pa.float64()),
                ],
                names=["id", "component", "deviation", "whitened"],
            )

    same = F.when(F.size("x") == width, F.col("x")).alias("x")
    kind = x.schema["id"].dataType.simpleString()
    return x.select("id", same).mapInArrow(run, f"id {kind}, component int, deviation long, whitened double")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) of every finite vector and component."""
    x = codes.numbers(rows, id_col, vector_col)
    model = fit(x, components)
    if model is None:
        empty = x.select("id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("deviation"), F.lit(0.0).alias("whitened")).limit(0)
        return empty.select("id", "component", F.lit(0).cast("long").alias("n"), "deviation", "whitened", F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    k = min(components, model.width)
    share = [float(e / model.trace) if model.trace > 0 else None for e in model.values[:k]]
    explained = F.get(F.array(*(F.lit(s).cast("double") for s in share)) if share else F.array().cast("array<double>"), F.col("component") - 1)
    return apply(x, model, components).select(
        "id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
