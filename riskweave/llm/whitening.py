"""Operator 11, embedding whitening.

Vectors become whole numbers.  Each distinct vector counts once: their sums are
exact, their covariance is summed from centred vectors in every task.  Only that
matrix (dimension x dimension) reaches the driver, where Householder reflections
make it tridiagonal, bisection over Sturm counts finds the leading eigenvalues
and inverse iteration, with reorthogonalisation in clusters, their vectors.  The
components are broadcast (dimension x components) and all rows projected on them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.storage import materialize

SCALE, COMPONENTS = 256, 4
#: Eigenvalues nearer than this share of the largest are a cluster.
CLUSTER = 1e-3
#: An eigenvalue below this share of the largest, for each dimension, is rounding and not a component.
LEAST_SHARE = 4 * np.finfo(float).eps
#: Where the last component's eigenvalue is below this share of the first's, the projections' own covariance corrects them.
UNEVEN = 1e-8
#: Rows projected at a time.
SLICE = 4096
_EXACT = 1 << 62


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and unit Householder vectors of a symmetric matrix."""
    a, n, mirrors = matrix.astype(np.float64).copy(), len(matrix), []
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        v[0] += np.copysign(length, v[0])
        size = np.linalg.norm(v)
        if not length or not size:
            mirrors.append(np.zeros(n - k - 1))
            continue
        v /= size
        mirrors.append(v)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * (rest @ v)
        w = p - (v @ p) * v
        rest -= np.outer(v, w) + np.outer(w, v)
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(diagonal: np.ndarray, squares: np.ndarray, at: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm counts: how many eigenvalues are smaller than each of ``at``."""
    count, q = np.zeros(len(at), np.int64), np.ones(len(at))
    for i, d in enumerate(diagonal):
        q = d - at - (squares[i - 1] / q if i else 0.0)
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of a tridiagonal matrix, falling, bisected until no double lies between the bounds."""
    n, around = len(diagonal), np.abs(np.concatenate([[0.0], off])) + np.abs(np.concatenate([off, [0.0]]))
    low, high = np.full(k, (diagonal - around).min()), np.full(k, (diagonal + around).max())
    norm = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - 1e-12 * norm, high + 1e-12 * norm
    tiny, squares, rank = np.finfo(float).eps ** 2 * norm, off**2, n - 1 - np.arange(k)
    for _ in range(200):
        middle = low + (high - low) / 2
        if not ((middle > low) & (middle < high)).any():
            break
        over = below(diagonal, squares, middle, tiny) > rank
        high, low = np.where(over, middle, high), np.where(over, low, middle)
    return low + (high - low) / 2


def _solver(diagonal: np.ndarray, off: np.ndarray, tiny: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves a tridiagonal system by elimination with row exchanges; pivots are at least ``tiny``."""
    n = len(diagonal)
    d, u, v = diagonal.tolist(), [*off.tolist(), 0.0], [0.0] * n
    factor, swapped = [0.0] * n, [False] * n
    for i in range(n - 1):
        lower = float(off[i])
        if abs(lower) > abs(d[i]):
            swapped[i] = True
            factor[i] = d[i] / lower
            d[i], u[i], v[i], d[i + 1], u[i + 1] = lower, d[i + 1], u[i + 1], u[i] - factor[i] * d[i + 1], -factor[i] * u[i + 1]
        else:
            d[i] = d[i] if abs(d[i]) >= tiny else tiny
            factor[i] = lower / d[i]
            d[i + 1] -= factor[i] * u[i]
    d[-1] = d[-1] if abs(d[-1]) >= tiny else tiny

    def solve(right: np.ndarray) -> np.ndarray:
        x = right.tolist()
        for i in range(n - 1):
            if swapped[i]:
                x[i], x[i + 1] = x[i + 1], x[i] - factor[i] * x[i + 1]
            else:
                x[i + 1] -= factor[i] * x[i]
        for i in range(n - 1, -1, -1):
            rest = x[i] - (u[i] * x[i + 1] if i + 1 < n else 0.0) - (v[i] * x[i + 2] if i + 2 < n else 0.0)
            x[i] = rest / d[i]
        return np.array(x)

    return solve


def leading_vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns) of a tridiagonal matrix for its leading ``values``, by inverse iteration."""
    n, norm = len(diagonal), max(np.abs(diagonal).max(initial=0.0) + 2 * np.abs(off).max(initial=0.0), np.finfo(float).tiny)
    eps, random, out = np.finfo(float).eps, np.random.default_rng(11), np.zeros((n, len(values)))
    first, shift = 0, 0.0
    for k, value in enumerate(values):
        near = k > 0 and values[k - 1] - value <= CLUSTER * norm
        first = first if near else k
        # Equal values are moved apart by a rounding, so that each system is another.
        shift = min(value, shift - 2 * eps * norm) if near else value
        solve, others = _solver(diagonal - shift, off, eps * norm), out[:, first:k]
        x = random.uniform(-1, 1, n)
        for _ in range(6):
            x = solve(x / np.abs(x).max())
            x /= np.abs(x).max()
            for _ in range(2):
                x = x - others @ (others.T @ x)
            length = np.linalg.norm(x)
            x = x / length if length > 1e-8 else random.uniform(-1, 1, n)
        for _ in range(2):
            x = x - out[:, :k] @ (out[:, :k].T @ x)
            x /= np.linalg.norm(x)
        out[:, k] = x
    return out


def leading(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``k`` largest eigenvalues above rounding, falling, and their unit eigenvectors (columns)."""
    scale = np.abs(matrix).max(initial=0.0)
    if not scale:
        return np.zeros(0), np.zeros((len(matrix), 0))
    diagonal, off, mirrors = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, min(k, len(matrix)))
    values = values[values > len(matrix) * LEAST_SHARE * max(values[0], 0.0)]
    vectors = leading_vectors(diagonal, off, values)
    for i in range(len(mirrors) - 1, -1, -1):
        vectors[i + 1 :] -= 2 * np.outer(mirrors[i], mirrors[i] @ vectors[i + 1 :])
    return values * scale, vectors


@dataclass
class Centre:
    """Distinct vectors and the exact sum of each dimension over them."""

    n: int
    sums: list[int]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly: as longs, or as Python's integers where longs might overflow."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
        if self.n * most + max(map(abs, self.sums), default=0) < _EXACT:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, rounded once."""
        return (self.apart(x) / self.n).astype(np.float64)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of the squares of n*x - S; None where no long holds it."""
        far = self.apart(x)
        if far.dtype != object and (not far.size or far.shape[1] * max(int(far.max()), -int(far.min())) ** 2 < _EXACT):
            return (far * far).sum(axis=1).tolist()
        return [y if (y := sum(int(v) ** 2 for v in row)) < 1 << 63 else None for row in far]


@dataclass
class Whitening:
    """What whitens vectors: their centre, eigenvalues and components of their covariance (columns), its trace, and how far the whitened covariance is from the identity."""

    centre: Centre
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        # Not by a matrix product, whose rounding depends on how many rows it is given: equal vectors have equal results.
        return np.einsum("ij,jk->ik", self.centre.centred(x), self.components / np.sqrt(self.values))


def _matrix(column: pa.ListArray) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), len(values) // max(len(column), 1))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors: their number (dim -1) and the sum of each dimension."""
    n, total = 0, 0
    for batch in batches:
        if len(batch):
            x = _matrix(batch.column(0))
            small = max(int(x.max(initial=0)), -int(x.min(initial=0))) * len(x) < _EXACT
            n, total = n + len(x), total + (x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0))
    if n:
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(-1, len(total)), pa.int32()), "total": pa.array([str(int(v)) for v in [n, *total]])})


def _products(values: Callable[[np.ndarray], np.ndarray]):
    """Sums of the products of each two of a task's centred ``values``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for i in range(0, len(x), SLICE):
                y = values(x[i : i + SLICE])
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    return run


def _covariance(fit: DataFrame, values: Callable[[np.ndarray], np.ndarray], size: int, n: int) -> np.ndarray:
    """The covariance of centred ``values`` over the fit list: at most size x size / 2 numbers reach the driver."""
    rows = fit.mapInArrow(_products(values), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((size, size))
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy()
    out[rows["j"].to_numpy(), rows["i"].to_numpy()] = rows["v"].to_numpy()
    return out / n


def whole_numbers(vector: Column) -> Column:
    """floor(256*c) of each entry as a long; those beyond a long's range are at its ends."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))


def usable(vectors: DataFrame, *, vector_col: str = "embedding") -> DataFrame:
    """Rows whose vector has the commonest length (of equally common ones the longest) and only finite entries, with its whole numbers as x."""
    v = F.col(f"`{vector_col}`")
    complete = v.isNotNull() & ~F.coalesce(F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    rows = vectors.where(complete)
    length = rows.groupBy(F.size(v).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size(v) == (length["d"] if length else 0)).withColumn("x", whole_numbers(v))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors of ``x`` (x); None where no two differ."""
    distinct = materialize(x.select("x").distinct())
    sums = distinct.mapInArrow(_sums, "dim int, total string").groupBy("dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("dim").collect()  # one row for each dimension
    if len(sums) < 2 or sums[0]["total"] < 2:
        return None
    n, *totals = (int(r["total"]) for r in sums)
    centre, spark = Centre(n, totals), x.sparkSession
    covariance = _covariance(distinct, centre.centred, len(totals), n)
    values, vectors = leading(covariance, components)
    found = Whitening(centre, values, vectors, float(np.trace(covariance)))

    def seen() -> np.ndarray:
        # n*x - S sums to zero exactly, so projections are centred as they are.
        shared = spark.sparkContext.broadcast(found)
        out = _covariance(distinct, lambda y: shared.value.project(y), len(found.values), n)
        shared.unpersist()
        return out

    spread = seen()
    if values[-1] < UNEVEN * values[0]:
        back = np.sqrt(np.outer(values, values)) * spread
        found.values, turn = leading(back, components)
        found.components = vectors @ turn
        spread = seen()
    found.identity_error = float(np.abs(spread - np.eye(len(spread))).max())
    return found


def whiten(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """Whitened leading components of every vector.

    Returns one row for each usable row and component (``components`` at most,
    from 1 by falling eigenvalue): vec_id, component, n (distinct vectors),
    deviation (exact; null where no long holds it), whitened, explained and
    identity_error.

    Vectors that are null or hold null or non-finite entries give no rows, nor do
    vectors of another length than the commonest.  Entries beyond the range of a
    long after scaling are taken at its ends.  There are as many components as
    eigenvalues above rounding, so none where all vectors are equal, empty or
    missing.  Equal vectors count once in the fit and have equal results.  Rows
    with null or repeated ids stay rows of their own.  Other columns are ignored,
    whatever their names.
    """
    rows = usable(vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").alias("v")), vector_col="v").select("vec_id", "x")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # dimension x components numbers

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        k = len(own.values)
        share = own.values / own.trace
        for batch in batches:
            for i in range(0, len(batch), SLICE):
                part = batch.slice(i, SLICE)
                x = _matrix(part.column(1))
                each = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()), pa.array(np.full(len(each), own.centre.n, np.int64)),
                        pa.array(own.centre.deviation(x), pa.int64()).take(pa.array(each)), pa.array(own.project(x).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), own.identity_error)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, schema)
