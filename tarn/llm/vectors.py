"""Integer vectors for operators that need exact arithmetic, and sums of them over partitions."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers below it are exact as doubles.
EXACT = 1 << 53
LONG = 1 << 63


def usable(vector: Column) -> Column:
    """Whether a vector is not null and all its entries are finite numbers."""
    bad = F.exists(vector.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of each entry c, taken as double; beyond the range of a long its ends."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.lit(float(scale)) * c))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` longs each as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dim)


def magnitude(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def longs(values: np.ndarray) -> pa.Array:
    """Integers as longs; those beyond the range of a long are null."""
    if values.dtype != object:
        return pa.array(values, pa.int64())
    return pa.array([int(v) if -LONG <= v < LONG else None for v in values], pa.int64())


def tree_sum(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], object], merge: Callable):
    """``merge`` over what ``partial`` makes of each partition, by ``treeAggregate``; None without rows.

    A partial result is of fixed size, whatever the rows, and None for a partition without rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = partial(batches)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["part"])

    def both(a, b):
        return b if a is None else a if b is None else merge(a, b)

    parts = rows.mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(r.part))
    return parts.treeAggregate(None, both, both, depth=3)
