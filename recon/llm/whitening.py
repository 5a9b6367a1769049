"""Whitening of embeddings on the leading eigenvectors of their covariance.

Sums of the scaled vectors are taken over all rows first, exactly; then each task adds up the products of
its centred vectors, and the tasks' matrices are summed entry by entry. A covariance has as many entries as
the dimension squared, whatever the number of rows, so its eigenvectors are found on the driver: Householder
reflections make it tridiagonal, counts of Sturm sequences locate the leading eigenvalues by bisection,
inverse iteration gives their vectors, each made orthogonal to the earlier ones of its cluster, and the
reflections are undone. The components (at most 32 by dimension) are broadcast and every row projected.
A last pass takes the covariance of what was projected and states how far it is from the identity.

Results of odd input: a vector that is null, empty, or holds a null or non-finite entry, or one whose scaled
value has no 64-bit integer, takes no part. Vectors of other than the most frequent dimension take none either
(of two as frequent, the larger). Repeated rows count and are returned as often as they come; a null vec_id is
kept. Ties among eigenvalues: any orthonormal basis of the common space, the same for all rows. Directions
without variance (an eigenvalue at most ``NO_VARIANCE`` of the trace) give no component, so equal vectors or an
empty table give no rows. Further columns are not read. Vectors are worked on ``BLOCK`` entries at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recon.llm.common import written

COMPONENTS = 32
#: x = floor(SCALE * c) + OFFSET
SCALE, OFFSET = 64, 1_000_000
#: Share of the trace below which a direction counts as having no variance.
NO_VARIANCE = 1e-13
#: Eigenvalues closer than this share of the matrix's norm are one cluster.
CLUSTER = 1e-3
#: Vector entries that one step of a task works on.
BLOCK = 1 << 18

_EPS = np.finfo(np.float64).eps


def scaled_vectors(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x) of the rows that take part, but for the dimension; x as array<bigint>."""
    cells = F.col(vector).cast("array<double>")
    fine = F.forall(cells, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(2.0**56)))
    x = F.transform(cells, lambda c: F.floor(c * SCALE).cast("bigint") + F.lit(OFFSET))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(fine).select(
        F.col(id_column).cast("bigint").alias("vec_id"), x.alias("x"))


def _blocks(batches, dim: int, column: str = "x"):
    """Matrices of at most BLOCK entries (one row at least) with the batch slice they come from."""
    step = max(1, BLOCK // dim)
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            cut = batch.slice(at, step)
            yield cut, cut.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def sums(vectors: DataFrame) -> tuple[int, int, list[int]]:
    """(dimension, rows, sum of every dimension) of the vectors of the most frequent dimension, exactly."""
    best = (vectors.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
            .orderBy(F.desc("n"), F.desc("dim")).limit(1).collect())
    if not best:
        return 0, 0, []
    dim, n = best[0].dim, best[0].n
    totals = (vectors.where(F.size("x") == dim).select(F.posexplode("x").alias("at", "value"))
              .groupBy("at").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).orderBy("at").collect())
    return dim, n, [int(r.total) for r in totals]


def centred(x: np.ndarray, n: int, totals: np.ndarray) -> np.ndarray:
    """x - S/n. The whole part of the mean goes off in integers, so that nothing cancels in doubles."""
    whole = totals // n
    rest = np.array([int(r) / n for r in totals - whole * n])
    return (x - np.array([int(w) for w in whole], np.int64)).astype(np.float64) - rest


def _total_products(parts: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum the tasks' vectors and upper triangles entry by entry; (sum, product matrix)."""
    summed = parts.groupBy("i", "j").agg(F.sum("value").alias("value")).toArrow()
    i, j, value = (summed.column(c).to_numpy() for c in ("i", "j", "value"))
    total, square = np.zeros(dim), np.zeros((dim, dim))
    total[j[i < 0]] = value[i < 0]
    square[i[i >= 0], j[i >= 0]] = value[i >= 0]
    return total, square + np.triu(square, 1).T


def _products(vectors: DataFrame, to_matrix: _Centre, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Over all rows of ``to_matrix(block)``: their sum, and the sum of their outer products."""

    def add(batches):
        total, square, some = np.zeros(width), np.zeros((width, width)), False
        for _, x in _blocks(batches, to_matrix.dim):
            d = to_matrix(x)
            total += d.sum(axis=0)
            square += d.T @ d
            some = True
        if not some:
            return
        i, j = np.triu_indices(width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.full(width, -1), i]).astype(np.int32)),
             pa.array(np.concatenate([np.arange(width), j]).astype(np.int32)),
             pa.array(np.concatenate([total, square[i, j]]))], names=["i", "j", "value"])

    return _total_products(vectors.mapInArrow(add, "i int, j int, value double"), width)


class _Centre:
    """Blocks of x to centred vectors."""

    def __init__(self, dim: int, n: int, totals: list[int]):
        self.dim, self.n, self.totals = dim, n, totals

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, np.array(self.totals, object))


class _Project(_Centre):
    """Blocks of x to whitened vectors, less a given mean."""

    def __init__(self, centre: _Centre, basis: np.ndarray, mean: np.ndarray | None = None):
        super().__init__(centre.dim, centre.n, centre.totals)
        self.basis, self.mean = basis, mean

    def __call__(self, x: np.ndarray) -> np.ndarray:
        out = super().__call__(x) @ self.basis
        return out if self.mean is None else out - self.mean


def covariance(vectors: DataFrame, centre: _Centre) -> np.ndarray:
    return _products(vectors, centre, centre.dim)[1] / centre.n


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and Householder vectors of a symmetric matrix made tridiagonal."""
    a = np.array(matrix, np.float64)
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        column = a[k + 1:, k].copy()
        length = np.linalg.norm(column)
        v = column
        if length > 0:
            v[0] += length if v[0] >= 0 else -length
            v /= np.linalg.norm(v)
            below = a[k + 1:, k + 1:]
            w = below @ v
            w -= (v @ w) * v
            below -= 2 * (np.outer(v, w) + np.outer(w, v))
            a[k + 1:, k] -= 2 * v * (v @ a[k + 1:, k])
        mirrors.append(v)
    return np.diag(a).copy(), np.array([a[i + 1, i] for i in range(n - 1)]), mirrors


def _below(diagonal: np.ndarray, off_squared: np.ndarray, x: np.ndarray, least: float) -> np.ndarray:
    """For each x, how many eigenvalues are smaller: negative terms of the Sturm sequence."""
    count = np.zeros(len(x), np.int64)
    q = diagonal[0] - x
    count += q < 0
    for i in range(1, len(diagonal)):
        q = diagonal[i] - x - off_squared[i - 1] / np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The k largest eigenvalues of a tridiagonal matrix, falling, by bisection on Sturm counts."""
    n = len(diagonal)
    reach = np.abs(np.append(off, 0)) + np.abs(np.append(0, off))
    low, high = float((diagonal - reach).min()), float((diagonal + reach).max())
    norm = max(abs(low), abs(high), np.finfo(float).tiny)
    least = max(norm * _EPS * _EPS, np.finfo(float).tiny)
    lows, highs = np.full(k, low - _EPS * norm), np.full(k, high + _EPS * norm)
    rank = n - 1 - np.arange(k)
    squared = off * off
    for _ in range(200):
        middle = (lows + highs) / 2
        stuck = (middle <= lows) | (middle >= highs) | (highs - lows <= 2 * _EPS * np.maximum(np.abs(lows), np.abs(highs)))
        if stuck.all():
            break
        under = _below(diagonal, squared, middle, least) > rank
        highs, lows = np.where(under, middle, highs), np.where(under, lows, middle)
    return (lows + highs) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, shift: float, norm: float):
    """Solve (T - shift) y = b: Gaussian elimination with row exchange, factored once for several b."""
    n = len(diagonal)
    least = _EPS * norm
    # Row i of the upper factor has three entries; lower factor and exchanges are kept as steps.
    u = np.zeros((n, 3))
    steps = []
    current = np.array([diagonal[0] - shift, off[0] if n > 1 else 0.0, 0.0])
    for i in range(n - 1):
        following = np.array([off[i], diagonal[i + 1] - shift, off[i + 1] if i + 1 < n - 1 else 0.0])
        swap = abs(following[0]) > abs(current[0])
        if swap:
            current, following = following, current
        if abs(current[0]) < least:
            current[0] = least
        factor = following[0] / current[0]
        steps.append((swap, factor))
        u[i] = current
        rest = following - factor * current
        current = np.array([rest[1], rest[2], 0.0])
    if abs(current[0]) < least:
        current[0] = least
    u[n - 1] = current

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor * y[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                y[i] -= u[i, 1] * y[i + 1]
            if i + 2 < n:
                y[i] -= u[i, 2] * y[i + 2]
            y[i] /= u[i, 0]
        return y / np.linalg.norm(y)

    return solve


def tridiagonal_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) to given eigenvalues, falling, by inverse iteration.

    Within a cluster shifts are moved apart a little and each vector is made orthogonal to the ones
    before it, twice in every step.
    """
    n = len(diagonal)
    norm = max(float(np.abs(diagonal).max() + 2 * (np.abs(off).max() if n > 1 else 0)), np.finfo(float).tiny)
    seed = np.random.default_rng(20)
    out = np.zeros((n, len(values)))
    first, shift = 0, 0.0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first = k
        shift = min(value, shift - 4 * _EPS * norm) if k > first else value
        solve = _solver(diagonal, off, shift, norm)
        y = seed.standard_normal(n)
        for _ in range(6):
            for _ in range(2):
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
            y = solve(y / np.linalg.norm(y))
        for _ in range(2):
            y -= out[:, first:k] @ (out[:, first:k].T @ y)
            y /= np.linalg.norm(y)
        out[:, k] = y
    return out


def leading_components(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as columns) of the k largest eigenvalues that carry variance, falling.

    Of a vector's two signs the one with a positive largest entry is taken.
    """
    trace = float(np.trace(matrix))
    if not trace > 0:
        return np.empty(0), np.empty((len(matrix), 0))
    diagonal, off, mirrors = tridiagonal(matrix / trace)
    values = leading_eigenvalues(diagonal, off, min(k, len(matrix)))
    values = values[values > NO_VARIANCE]
    vectors = tridiagonal_vectors(diagonal, off, values)
    for at in range(len(mirrors) - 1, -1, -1):
        v = mirrors[at]
        vectors[at + 1:] -= 2 * np.outer(v, v @ vectors[at + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    top = np.abs(vectors).argmax(axis=0)
    vectors *= np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0)
    # The Rayleigh quotient of a unit vector has twice its digits.
    return np.einsum("ik,ij,jk->k", vectors, matrix, vectors), vectors


def _deviations(x: np.ndarray, n: int, totals: list[int]) -> list[int]:
    """Sum over dimensions of (n*x - S)^2, exactly: in 64 bits where that holds it, else in Python integers."""
    whole = np.array([t // n for t in totals], np.int64)
    rest = [t % n for t in totals]
    off = x - whole
    if (int(np.abs(off).max(initial=0)) * n + n) ** 2 * x.shape[1] < 2**63:
        y = off * n - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    return [sum((int(o) * n - r) ** 2 for o, r in zip(row, rest)) for row in off]


RESULT = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
          "identity_error double, deviation_text string")


def whiten(rows: DataFrame, components: int = COMPONENTS, id_column: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """One row per vector and component (RESULT). ``deviation`` is null where 64 bits do not hold it;
    ``deviation_text`` always has its digits."""
    spark = rows.sparkSession
    vectors = written(scaled_vectors(rows, id_column, vector))
    dim, n, totals = sums(vectors)
    empty = spark.createDataFrame([], RESULT)
    if not n:
        return empty
    vectors = vectors.where(F.size("x") == dim)
    centre = _Centre(dim, n, totals)
    matrix = covariance(vectors, centre)
    values, basis = leading_components(matrix, components)
    k = len(values)
    if not k:
        return empty
    basis = basis / np.sqrt(values)
    explained = values / np.trace(matrix)
    mean = _products(vectors, _Project(centre, basis), k)[0] / n
    spread = _products(vectors, _Project(centre, basis, mean), k)[1] / n
    error = float(np.abs(spread - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((_Project(centre, basis), explained))

    def project(batches):
        to_white, share = shared.value
        for cut, x in _blocks(batches, dim):
            white = to_white(x)
            exact = _deviations(x, n, totals)
            rows_here = len(x)
            each = np.repeat(np.arange(rows_here), k)
            short = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            text = pa.array([str(v) for v in exact], pa.string())
            yield pa.RecordBatch.from_arrays([
                cut.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows_here)),
                pa.array(np.full(rows_here * k, n, np.int64)),
                short.take(pa.array(each)),
                pa.array(white.ravel()),
                pa.array(np.tile(share, rows_here)),
                pa.array(np.full(rows_here * k, error)),
                text.take(pa.array(each)),
            ], names=[c.split()[0] for c in RESULT.split(", ")])

    return vectors.mapInArrow(project, RESULT)
