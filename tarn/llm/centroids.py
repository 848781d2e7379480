"""Centroid clustering (Lloyd's rounds) in exact integer arithmetic.

Vectors become integers. Distances come from |x|^2 - 2 x.c + |c|^2 with one matrix product of doubles for each batch:
while dim * (max|x| + max|c|)^2 is below 2^53, every value in it is an exact integer. Batches beyond that bound are
compared by integers. Each partition sums its vectors by cluster; ``treeAggregate`` adds the sums, so that only
k * dim numbers reach the driver and go out again with the next round.

Edge cases: null vectors, vectors of another length and those with null or non-finite entries are left out. With fewer
than k vectors each one is a centroid. Repeated ids, null ids (last in the order of the first centroids, then by vector) and
repeated vectors are rows each. Entries beyond the range of a long count as its ends; distances and inertias
beyond it are null. Centroids without vectors stay as they are. Other columns of any name are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .vectors import EXACT, LONG, longs, magnitude, matrix, quantised, tree_sum, usable

CLUSTERS, ROUNDS, DIM, SEED, SCALE = 40, 5, 64, 2, 256


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest row of ``c`` for each row of ``x``, the smaller one of equals, and its squared distance."""
    bound = x.shape[1] * (magnitude(x) + magnitude(c)) ** 2
    if bound < EXACT:
        a, b = x.astype(np.float64), c.astype(np.float64)
        far = np.einsum("ij,ij->i", a, a)[:, None] - 2.0 * (a @ b.T) + np.einsum("ij,ij->i", b, b)
        number = far.argmin(axis=1)
        return number, far[np.arange(len(x)), number].astype(np.int64)
    kind = np.int64 if bound < LONG else object
    a, b = x.astype(kind), c.astype(kind)
    far = np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1)
    number = far.argmin(axis=1)
    return number, far[np.arange(len(x)), number]


def cluster_sums(c: np.ndarray):
    """Of a partition: vectors, their sum and the sum of their distances for each cluster, as unbounded integers."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            x = matrix(batch.column("x"), c.shape[1])
            if not len(x):
                continue
            number, distance = nearest(x, c)
            order = np.argsort(number, kind="stable")
            seen, first = np.unique(number[order], return_index=True)
            small = len(x) * max(magnitude(x), magnitude(distance)) < LONG
            kind = np.int64 if small else object
            found = [np.zeros(len(c), object), np.zeros(c.shape, object), np.zeros(len(c), object)]
            found[0][seen] = np.diff([*first, len(x)])
            found[1][seen] = np.add.reduceat(x[order].astype(kind), first, axis=0)
            found[2][seen] = np.add.reduceat(distance[order].astype(kind), first)
            total = found if total is None else add(total, found)
        return total

    return run


def add(a: list, b: list) -> list:
    return [x + y for x, y in zip(a, b, strict=True)]


def moved(c: np.ndarray, sums: list) -> np.ndarray:
    """Centroids after a round: floor(sum / count) of each component; those without vectors stay."""
    count, total, _ = sums
    return np.array([[int(s) // int(n) for s in row] if n else [int(v) for v in old] for n, row, old in zip(count, total, c, strict=True)], dtype=np.int64).reshape(c.shape)


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector of ``dim`` entries."""
    spark = prepare(vectors.sparkSession)
    kept = vectors.where(usable(F.col(vector)) & (F.size(vector) == dim))
    rows = written(kept.select(F.col(vec_id).alias("vec_id"), quantised(F.col(vector), scale).alias("x")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "x").select("x").limit(k).collect()  # k vectors
    c = np.array([r.x for r in first], dtype=np.int64).reshape(len(first), dim)
    kind = rows.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(c):
        return spark.createDataFrame([], shape)
    for _ in range(rounds):
        c = moved(c, tree_sum(rows, cluster_sums(c), add))
    inertia = np.array(tree_sum(rows, cluster_sums(c), add)[2], object)
    digests = np.array([hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in c], object)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(matrix(batch.column("x"), dim), c)
            total = np.full(len(number), inertia.sum(), object)
            made = [pa.array(number, pa.int32()), longs(distance), longs(inertia[number]), longs(total), pa.array(digests[number], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *made], names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return rows.mapInArrow(assigned, shape)
