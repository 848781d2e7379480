import math
from fractions import Fraction

import numpy as np
import pytest

from tarn.llm import whitening
from tarn.llm.whitening import merged, symmetric_qr, welford


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, n int, component string")


def check(df, rows, top=4):
    """The result against exact covariances and another eigen-solver."""
    good = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, dim = len(fit), len(fit[0])
    sums = [sum(col) for col in zip(*fit)]
    cov = np.array([[float(sum((Fraction(n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit), Fraction(0)) / n**3) for j in range(dim)] for i in range(dim)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    got = {}
    for r in df.collect():
        got.setdefault(r.component, []).append(r)
    assert sorted(got) == list(range(1, min(top, dim) + 1))
    for j, found in got.items():
        assert sorted(r.vec_id for r in found) == sorted(i for i, _ in good)
        by = {i: x for i, x in good}
        sign = None
        for r in found:
            x = by[r.vec_id]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            want = float((np.array(x) - np.array([s / n for s in sums])) @ vectors[:, j - 1] / np.sqrt(values[j - 1]))
            if sign is None and abs(want) > 0.1:
                sign = np.sign(want * r.whitened)
            if sign is not None:
                assert r.whitened == pytest.approx(want * sign, abs=1e-9)
            assert r.explained == pytest.approx(values[j - 1] / np.trace(cov), rel=1e-9)
            assert 0 <= r.identity_error <= 1e-9


def rows_of(seed, n, dim, shift=0.0):
    r = np.random.default_rng(seed)
    turn = r.standard_normal((dim, dim)) * np.arange(1, dim + 1) / dim
    return [(i, [float(c) for c in r.standard_normal(dim) @ turn + shift]) for i in range(n)]


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_against_exact_covariance(spark, shift):
    rows = rows_of(1, 200, 9, shift)
    rows += [(1000 + i, v) for i, v in rows[:50]]  # copies count once in the fit
    check(whitening.whiten(frame(spark, rows).repartition(5)), rows)


def test_edges(spark):
    rows = rows_of(2, 30, 3)
    rows += [(50, None), (51, []), (52, [math.nan, 1.0, 1.0]), (53, [math.inf, 1.0, 1.0]), (54, [None, 1.0, 1.0]), (55, [-0.0, 0.0, 0.0])]
    check(whitening.whiten(frame(spark, rows)), rows)
    assert {r.vec_id for r in whitening.whiten(frame(spark, [*rows, (60, [1.0, 2.0]), (None, [1.0, 2.0, 3.0])])).collect()} == {*range(30), 55, None}
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0


def test_no_variance(spark):
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.deviation == 0 and r.whitened is None and r.explained is None and r.identity_error is None for r in one)
    line = whitening.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [4.0, 8.0])])).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in line)
    assert {r.component: round(r.explained, 12) for r in line} == {1: 1.0, 2: 0.0}


def test_long_entries(spark):
    rows = whitening.whiten(frame(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])])).collect()
    assert len(rows) == 6 and {r.deviation for r in rows if r.vec_id == 1} == {None}


def test_merging_parts_is_the_whole():
    x = np.random.default_rng(0).standard_normal((500, 5)) + 1e6
    parts = [welford(iter([x[a:b]]), 5) for a, b in ((0, 1), (1, 60), (60, 500))]
    n, mean, scatter = merged(merged(parts[0], parts[1]), parts[2])
    off = x - x.mean(axis=0)
    assert n == 500 and np.allclose(mean, x.mean(axis=0), rtol=1e-14) and np.allclose(scatter, off.T @ off, rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_symmetric_qr(n):
    r = np.random.default_rng(n)
    for a in (r.standard_normal((n, n)), np.zeros((n, n)), np.eye(n), r.standard_normal((n, 1)) * np.ones(n)):
        a = a @ a.T
        w, v = symmetric_qr(a)
        size = max(np.abs(a).max(), 1.0)
        assert np.allclose(a @ v, v * w, atol=1e-12 * size) and np.allclose(v.T @ v, np.eye(n), atol=1e-12) and (np.diff(w) <= 0).all()
