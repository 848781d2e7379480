"""Whitening of vectors: streaming covariance, its eigenvectors, and coordinates of unit variance.

The distinct integer vectors are the fit list. Each partition streams its part through Welford's rank-one updates
of count, mean and scatter, which are centred before they are multiplied; the parallel formula merges partitions in a
``treeAggregate``. Only dim * dim numbers reach the driver, where a symmetric QR iteration (Householder tridiagonal
form, implicit Wilkinson shifts) solves for the eigenvectors. The identity error is measured in a second pass over the fit list.

Edge cases: null vectors, vectors with null or non-finite entries and empty ones are left out. The space has the commonest length (of
equally common ones the longest); vectors of another length have no place in it and are left out. Repeated ids, null ids and
repeated vectors are rows each, a repeated vector is once in the fit list. Entries beyond the range of a long count as its ends; a
deviation beyond it is null. Along a component without variance ``whitened`` is null and the identity error leaves it out; with
none left the error is null, and ``explained`` is null if nothing varies. Of an eigenvector the largest entry, the first of equals, is positive.
Spaces of fewer dimensions than components give as many rows as they have. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .vectors import LONG, longs, magnitude, matrix, quantised, tree_sum, usable

COMPONENTS, SCALE = 4, 256


def welford(rows: Iterator[np.ndarray], dim: int):
    """(count, mean, scatter) of the rows of several matrices; None without rows."""
    n, mean, scatter, product = 0, np.zeros(dim), np.zeros((dim, dim)), np.empty((dim, dim))
    for x in rows:
        for row in x:
            n += 1
            off = row - mean
            mean += off / n
            np.multiply.outer(off, row - mean, out=product)
            scatter += product
    return (n, mean, scatter) if n else None


def merged(a: tuple, b: tuple) -> tuple:
    """(count, mean, scatter) of two parts; what follows these is added."""
    n, off = a[0] + b[0], b[1] - a[1]
    scatter = a[2] + b[2] + np.outer(off, off) * (a[0] * b[0] / n)
    return n, a[1] + off * (b[0] / n), scatter, *(x + y for x, y in zip(a[3:], b[3:], strict=True))


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, off-diagonal and orthogonal basis of the tridiagonal form of a symmetric matrix, by Householder reflections."""
    a, n = a.astype(float), len(a)
    basis = np.eye(n)
    for k in range(n - 2):
        v = a[k + 1 :, k].copy()
        v[0] += math.copysign(np.linalg.norm(v), v[0])
        size = np.linalg.norm(v)
        if size:
            v /= size
            a[k + 1 :, k:] -= 2 * np.outer(v, v @ a[k + 1 :, k:])
            a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
            basis[:, k + 1 :] -= 2 * np.outer(basis[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), basis


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors (columns) of a symmetric matrix."""
    scale = np.abs(a).max() if a.size and np.abs(a).max() > 0 else 1.0
    d, e, z = tridiagonal(a / scale)
    z = z.T.copy()  # rows are rotated
    high = len(d) - 1
    while high > 0:
        e[np.abs(e) <= np.finfo(float).eps * (np.abs(d[:-1]) + np.abs(d[1:]))] = 0.0
        if e[high - 1] == 0.0:
            high -= 1
            continue
        low = high - 1
        while low > 0 and e[low - 1] != 0.0:
            low -= 1
        half = (d[high - 1] - d[high]) / 2
        x, y = d[low] - (d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))), e[low]
        for k in range(low, high):
            r = math.hypot(x, y)
            c, s = (x / r, y / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            one, two, off = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * one + 2 * c * s * off + s * s * two, s * s * one - 2 * c * s * off + c * c * two
            e[k] = c * s * (two - one) + (c * c - s * s) * off
            x = e[k]
            if k < high - 1:
                y, e[k + 1] = s * e[k + 1], c * e[k + 1]
            z[k : k + 2] = np.array([[c, s], [-s, c]]) @ z[k : k + 2]
    order = np.argsort(-d, kind="stable")
    vectors = z[order]
    signs = np.sign(vectors[np.arange(len(d)), np.abs(vectors).argmax(axis=1)])
    return d[order] * scale, (vectors * signs[:, None]).T


def fit_parts(dim: int):
    """Of a partition of the fit list: count, mean, scatter and exact sums."""

    def run(batches: Iterator[pa.RecordBatch]):
        sums = np.zeros(dim, object)

        def rows() -> Iterator[np.ndarray]:
            nonlocal sums
            for batch in batches:
                x = matrix(batch.column("x"), dim)
                sums = sums + x.astype(np.int64 if len(x) * magnitude(x) < LONG else object).sum(axis=0)
                yield x.astype(float)

        found = welford(rows(), dim)
        return found and (*found, sums)

    return run


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Exact sums of (n * x - sums)^2 over the dimensions."""
    bound = n * magnitude(x) + max(abs(int(s)) for s in sums)
    kind = np.int64 if x.shape[1] * bound**2 < LONG else object
    return ((x.astype(kind) * n - sums.astype(kind)) ** 2).sum(axis=1)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every usable vector and component."""
    spark = prepare(vectors.sparkSession)
    kept = vectors.where(usable(F.col(vector)) & (F.size(vector) > 0))
    rows = kept.select(F.col(vec_id).alias("vec_id"), quantised(F.col(vector), scale).alias("x"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], shape)
    dim = common.dim
    rows = rows.where(F.size("x") == dim)
    fit = written(rows.select("x").distinct())
    n, _, scatter, sums = tree_sum(fit, fit_parts(dim), merged)
    values, basis = symmetric_qr(scatter / n)
    top = min(components, dim)
    trace, values, basis = float(np.trace(scatter / n)), values[:top], basis[:, :top]
    varies = values > 8 * dim * np.finfo(float).eps * max(values[0], 0.0)
    centre = np.array([int(s) / n for s in sums])
    turn = basis / np.sqrt(np.where(varies, values, np.nan))

    def whitened(x: np.ndarray) -> np.ndarray:
        return (x - centre) @ turn

    def white_parts(batches: Iterator[pa.RecordBatch]):
        return welford((whitened(matrix(b.column("x"), dim))[:, varies] for b in batches), int(varies.sum()))

    error = None
    if varies.any():
        _, _, spread = tree_sum(fit, white_parts, merged)
        error = float(np.abs(spread / n - np.eye(int(varies.sum()))).max())
    explained = values / trace if trace > 0 else np.full(top, np.nan)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            size = len(x) * top
            ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), top)))
            made = [
                pa.array(np.tile(np.arange(1, top + 1, dtype=np.int32), len(x))), pa.array(np.full(size, n, np.int64)),
                longs(np.repeat(deviations(x, n, sums), top)), pa.array(whitened(x).ravel(), from_pandas=True),
                pa.array(np.tile(explained, len(x)), from_pandas=True), pa.array([error] * size, pa.float64())]
            yield pa.RecordBatch.from_arrays([ids, *made], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, shape)
