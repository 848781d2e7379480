import random
import statistics

import pytest
from pyspark.sql import functions as F

from tarn.operators import ranks


def rows_of(seed, n):
    r = random.Random(seed)
    values = [lambda: r.gauss(0, 1), lambda: float(r.randrange(3)), lambda: 7.0, lambda: r.choice([-1e300, 1e300, 0.0])]
    return [(k, g, None if r.random() < 0.05 else values[(g or 0) % 4]()) for k in range(n) for g in [r.choice([None, 0, 0, 0, 1, 2, 3, k + 10 if k % 97 == 0 else 5])]]


@pytest.mark.parametrize("seed,n", [(1, 3000), (2, 40), (3, 0)])
def test_middles(spark, monkeypatch, seed, n):
    rows = rows_of(seed, n)
    df = spark.createDataFrame(rows, "k long, g long, v double").repartition(5)
    groups = {}
    for _, g, v in rows:
        groups.setdefault(g, [])
        if v is not None:
            groups[g].append(v)
    want = {g: (len(v), sorted(v)[(len(v) - 1) // 2], sorted(v)[len(v) // 2]) for g, v in groups.items() if v}
    assert {r.g: (r.n, r.lower, r.upper) for r in ranks.middles(df, ["g"], "v").collect()} == want
    found = {r.g: (r.v, r.w) for r in ranks.medians(df.withColumn("w", -F.col("v") / 2), ["g"], "v", "w").collect()}
    assert found.keys() == groups.keys()
    for g, v in groups.items():
        assert found[g] == ((statistics.median(v), -statistics.median(v) / 2) if v else (None, None))
    monkeypatch.setattr(ranks, "LOW", 0.7)  # a bracket that misses: the group is put in order whole
    monkeypatch.setattr(ranks, "HIGH", 0.8)
    assert {r.g: (r.n, r.lower, r.upper) for r in ranks.middles(df, ["g"], "v").collect()} == want


@pytest.mark.parametrize("parts", [1, 7])
def test_running(spark, parts):
    rows = [(k, None if k % 11 == 0 else k % 3 * (k % 3 < 2), (k * 7919) % 1009, float(k % 5)) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, g long, o long, v double").repartition(4)
    found = ranks.running(df, ["g"], ["o", "k"], "v", parts).collect()
    want = {}
    for g in {r[1] for r in rows}:
        total = 0.0
        for p, (k, _, _, v) in enumerate(sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))):
            want[k] = (p, total)
            total += v
    assert {r.k: (r.position, r.before) for r in found} == want and found[0].__fields__ == ["k", "g", "o", "v", "position", "before"]
    assert ranks.running(df.where("k < 0"), ["g"], ["o", "k"]).count() == 0
