import hashlib
import math

import numpy as np
import pytest

from tarn.llm import centroids
from tarn.llm.centroids import nearest


def brute(rows, k, rounds, dim, seed=2, scale=256):
    """Plain integers, row by row."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [max(-(2**63), min(2**63 - 1, math.floor(scale * c))) if abs(c) < 1e300 else (2**63 - 1 if c > 0 else -(2**63)) for c in v]))
    digest = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    c = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, digest(r[0]), r[1]))[:k]]

    def assigned():
        far = [[sum((a - b) ** 2 for a, b in zip(x, row)) for row in c] for _, x in kept]
        return [(d.index(min(d)), min(d)) for d in far]

    for _ in range(rounds):
        found = assigned()
        for j in range(len(c)):
            mine = [x for (_, x), (n, _) in zip(kept, found) if n == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assigned()
    long = lambda v: v if v < 2**63 else None
    total = sum(d for _, d in found)
    return sorted(((i, n, long(d), long(sum(e for m, e in found if m == n)), long(total), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest())
                   for (i, _), (n, d) in zip(kept, found)), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, x string")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def rows_of(seed, n=300, dim=6, size=0.3):
    r = np.random.default_rng(seed)
    middles = r.standard_normal((5, dim))
    return [(int(i) * 3 - 40, [float(c) for c in (middles[r.integers(5)] + r.standard_normal(dim) * 0.4) * size]) for i in range(n)]


@pytest.mark.parametrize("size", [0.3, 3e5, 2e6, 1e14, 1e18])
def test_against_plain_integers(spark, size):
    """From sums of doubles over longs to integers of any size."""
    rows = rows_of(3, 120, size=size)
    df = frame(spark, rows).repartition(5)
    assert found(centroids.cluster(df, k=7, rounds=4, dim=6)) == brute(rows, 7, 4, 6)


def test_edges(spark):
    v = [0.5, -0.25, 0.125]
    rows = [(1, v), (1, v), (2, v), (None, v), (None, [9.0, 9.0, 9.0]), (3, None), (4, []), (5, [1.0, 2.0]), (6, [math.nan, 0.0, 0.0]), (7, [math.inf, 0.0, 0.0]),
            (8, [None, 0.0, 0.0]), (9, [-0.0, 1e-9, -1e-9]), (10, [4.0, 4.0, 4.0])]
    for k in (2, 3, 50):
        assert found(centroids.cluster(frame(spark, rows), k=k, rounds=3, dim=3)) == brute(rows, k, 3, 3)
    empty = centroids.cluster(frame(spark, [(1, None)]), dim=3)
    assert empty.count() == 0 and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_equal_distances_go_to_the_smaller_number():
    x, c = np.array([[0, 0], [5, 5]]), np.array([[1, 0], [0, 1], [1, 0]])
    for grow in (1, 1 << 28, 1 << 40):
        number, distance = nearest(x * grow, c * grow)
        assert number.tolist() == [0, 0] and [int(d) for d in distance] == [grow**2, 41 * grow**2]
