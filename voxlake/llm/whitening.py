"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its triangular factor.

Entries c become whole numbers x = floor(1024 c) + 100000. Three passes over the vectors, each in Arrow batches with one
small partial result for each task: exact sums by dimension; the scatter of x less its mean, a matrix of dimension by
dimension; and the covariance of the whitened values. Between the passes the driver holds matrices of the dimension's
size only, whatever the number of rows. There the covariance V = P L L' P' is factored with pivoting, which stops where
nothing is left (rank), and plane rotations make the columns of L orthogonal: their squared norms are V's eigenvalues and
the normalised columns, with the rows put back in place, its unit eigenvectors.

Rows whose vector is null or holds null or non-finite entries are dropped, and so are those of another length than
most (of equally frequent lengths the longest stays). Entries beyond 2^30 count as 2^30, so that sums are exact. Null ids
stay; repeated rows are rows of their own and equal each other; other columns are left out. V has no eigenvectors for
eigenvalues that are zero to rounding, so there are min(components, rank) of them; an empty table, a single row
or equal vectors only give no rows. Of equal eigenvalues any orthogonal eigenvectors are right. A deviation that is
beyond a long is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxlake.llm.common import cut, partitions

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LARGEST = float(1 << 30)
SWEEPS = 60


def whole_numbers(vectors: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the finite vectors of that size, and their whole numbers as a matrix."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), -1))
    at = np.flatnonzero(lengths == size)
    values = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    finite = np.isfinite(values).all(axis=1)
    values = np.clip(values[finite], -LARGEST, LARGEST)
    return at[finite], np.floor(SCALE * values).astype(np.int64) + SHIFT


def _sums(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, tuple[int, np.ndarray]] = {}
    for part in parts:
        vectors = part.column("vector")
        for size in np.unique(np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))).tolist():
            if size:
                _, x = whole_numbers(vectors, size)
                n, total = found.get(size, (0, np.zeros(size, np.int64)))
                found[size] = n + len(x), total + x.sum(axis=0)
    for size, (n, total) in found.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(size, size)), pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(total)],
            names=["size", "place", "n", "total"])


def _matrix_of(partial: Callable[[np.ndarray], np.ndarray], size: int):
    """The sum of partial(x) over a task's batches, as rows (i, row)."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            _, x = whole_numbers(part.column("vector"), size)
            own = partial(x)
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])
    return run


def _added(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for part in parts:
        for i, row in zip(part.column("i").to_pylist(), part.column("row"), strict=True):
            total[i] = total.get(i, 0.0) + row.values.to_numpy()
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.list_(pa.float64()))], names=["i", "row"])


def _summed(vectors: DataFrame, partial: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum of partial(x) over all rows. Tasks add up their own; rows of the matrix are added in several tasks."""
    schema = "i long, row array<double>"
    rows = vectors.mapInArrow(_matrix_of(partial, size), schema).repartition(partitions(vectors), "i").mapInArrow(_added, schema)
    return np.array([r["row"] for r in sorted(rows.collect(), key=lambda r: r["i"])])


def pivoted_cholesky(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lower factor L (one column for each of its ranks) and the order of rows, so that matrix[order][:, order] = L L'."""
    rest, size = matrix.copy(), len(matrix)
    order, factor, rank = np.arange(size), np.zeros((size, size)), 0
    floor = size * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(size):
        pivot = k + int(np.argmax(rest.diagonal()[k:]))
        if rest[pivot, pivot] <= floor:
            break
        for own in (rest, factor):
            own[[k, pivot]] = own[[pivot, k]]
        rest[:, [k, pivot]] = rest[:, [pivot, k]]
        order[[k, pivot]] = order[[pivot, k]]
        factor[k:, k] = rest[k:, k] / np.sqrt(rest[k, k])
        rest[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
        rank = k + 1
    return factor[:, :rank], order


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, in rounds of disjoint pairs."""
    circle = np.arange(n + n % 2)
    half = len(circle) // 2
    for _ in range(len(circle) - 1):
        a, b = circle[:half], circle[half:][::-1]
        real = (a < n) & (b < n)
        yield np.minimum(a, b)[real], np.maximum(a, b)[real]
        circle[1:] = np.roll(circle[1:], 1)


def orthogonal_columns(factor: np.ndarray) -> np.ndarray:
    """The factor's columns after one-sided Jacobi rotations, orthogonal to one another, longest first."""
    columns = np.ascontiguousarray(factor.T)
    small = np.finfo(float).eps * max(1.0, np.sqrt(len(columns)))
    for _ in range(SWEEPS):
        turned = False
        for a, b in _rounds(len(columns)):
            x, y = columns[a], columns[b]
            xx, yy, xy = (np.einsum("ij,ij->i", u, v) for u, v in ((x, x), (y, y), (x, y)))
            at = np.flatnonzero(np.abs(xy) > small * np.sqrt(xx * yy))
            if not len(at):
                continue
            turned = True
            ratio = (yy[at] - xx[at]) / (2 * xy[at])
            tangent = np.where(ratio >= 0, 1.0, -1.0) / (np.abs(ratio) + np.hypot(1.0, ratio))
            cosine = 1 / np.sqrt(1 + tangent * tangent)
            sine = (cosine * tangent)[:, None]
            cosine = cosine[:, None]
            columns[a[at]], columns[b[at]] = cosine * x[at] - sine * y[at], sine * x[at] + cosine * y[at]
        if not turned:
            break
    norms = np.einsum("ij,ij->i", columns, columns)
    return columns[np.argsort(-norms, kind="stable")].T


def eigenpairs(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenvalues of a covariance matrix, falling, and unit eigenvectors as columns."""
    factor, order = pivoted_cholesky(matrix)
    columns = orthogonal_columns(factor)
    values = np.einsum("ij,ij->j", columns, columns)
    vectors = np.empty_like(columns)
    vectors[order] = columns / np.sqrt(values)
    return values, vectors


def deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """The sum over dimensions of (n x - total)^2 for each row, exactly; None beyond a long."""
    largest = max([abs(n * int(v)) for v in (x.min(initial=0), x.max(initial=0))] + [abs(t) for t in total])
    if len(total) * (2 * largest) ** 2 < 1 << 63:
        apart = n * x - np.array(total, np.int64)
        return (apart * apart).sum(axis=1).tolist()
    apart = n * x.astype(object) - np.array(total, object)
    if apart.size and max(abs(int(apart.min())), abs(int(apart.max()))) ** 2 * len(total) < 1 << 63:
        small = apart.astype(np.int64)
        return (small * small).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (apart * apart).sum(axis=1).tolist()]


def _whitened(size: int, n: int, total: list[int], mean: np.ndarray, weights: np.ndarray, explained: list[float], error: float):
    k = weights.shape[1]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at, x = whole_numbers(part.column("vector"), size)
            rows = len(at)
            again = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id").take(pa.array(at)).take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                 pa.array(np.full(rows * k, n)), pa.array(deviations(x, n, total), pa.int64()).take(again),
                 pa.array(((x - mean) @ weights).reshape(-1)), pa.array(np.tile(explained, rows)),
                 pa.array(np.full(rows * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitening(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error of each vector and component."""
    vectors = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    own = vectors.select("vector")
    sums = cut(own.mapInArrow(_sums, "size long, place long, n long, total long").groupBy("size", "place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    most = sums.filter("place = 0 and n > 0").orderBy(F.desc("n"), F.desc("size")).first()
    if most is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    size, n = most["size"], most["n"]
    # one row for each dimension
    total = [int(r["total"]) for r in sums.filter(F.col("size") == size).orderBy("place").collect()]
    mean = np.array([float(Decimal(t) / n) for t in total])

    def scatter(x: np.ndarray) -> np.ndarray:
        apart = x - mean
        return apart.T @ apart

    covariance = _summed(own, scatter, size) / n
    covariance = (covariance + covariance.T) / 2
    values, eigenvectors = eigenpairs(covariance)
    k = min(components, len(values))
    if not k:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    weights = eigenvectors[:, :k] / np.sqrt(values[:k])

    def moments(x: np.ndarray) -> np.ndarray:
        white = (x - mean) @ weights
        return np.column_stack((white.T @ white, white.sum(axis=0)))

    found = _summed(own, moments, size) / n
    spread = found[:, :k] - np.outer(found[:, k], found[:, k])
    error = float(np.abs(spread - np.eye(k)).max())
    explained = (values[:k] / covariance.trace()).tolist()
    return vectors.mapInArrow(_whitened(size, n, total, mean, weights, explained, error), RESULT)
