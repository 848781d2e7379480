import numpy as np

from tarn.llm import embedding_dedup


def brute(rows, threshold=0.98):
    good = [(i, lab, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, v, lab in rows
            if v is not None and lab is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    parent, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, lab, v) in enumerate(good):
        for j, other, w in good[k + 1 :]:
            if lab == other and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links[i], root(i), root(i) == i) for i in parent}


def found(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def rows_of(seed, dim=32):
    r = np.random.default_rng(seed)
    rows, add = [], lambda v, lab: rows.append((len(rows) * 2 + 5, None if v is None else [float(x) for x in v], lab))
    base = r.standard_normal(dim)
    for _ in range(90):  # one large group, its links not transitive
        add(base + r.standard_normal(dim) * r.choice([0.05, 0.09, 0.12]), 1)
    for _ in range(150):
        v = r.standard_normal(dim)
        add(v, int(r.integers(0, 3)))
        if r.random() < 0.4:
            add(v * 3, rows[-1][2])
    add(base, 2)
    add(np.zeros(dim), 1)
    add(None, 1)
    add(base, None)
    add([], 1)
    add([*base[:-1], np.nan], 1)
    add(base[:5], 1)
    add(base[:5] * 1e-200, 1)
    add(base[:5] * 1e200, 1)
    rows.append((999, [None, *[float(x) for x in base[1:]]], 1))
    return rows


def test_recall_and_counts_against_brute_force(spark, monkeypatch):
    for block, seed in ((16, 0), (256, 1)):
        monkeypatch.setattr(embedding_dedup, "BLOCK", block)
        rows = rows_of(seed)
        df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<double>, label int, n_links string")
        got, want = found(embedding_dedup.near_vectors(df)), brute(rows)
        assert got.keys() == want.keys()
        assert all(got[i][0] <= want[i][0] for i in want)
        total, hit = sum(w[0] for w in want.values()), sum(g[0] for g in got.values())
        print("recall of links", hit / total)
        assert hit >= 0.99 * total
        assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_empty_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [2.0, 0.0], 1)], schema)
    assert sorted(tuple(r)[:3] for r in embedding_dedup.near_vectors(df).collect()) == [(1, 2, 1), (1, 2, 1), (2**63 - 1, 2, 1)]


def test_rows_of_one_id_are_vectors_each(spark):
    most = 2**63 - 1
    rows = [(None, [1.0, 0.0], "a"), (None, [0.0, 1.0], "a"), (5, [0.0, 2.0], "a"), (5, [1.0, 1.0], "a"), (None, [0.0, 1.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(df).collect())
    assert got == [(5, 0, 5, True), (5, 1, 5, True), (most, 0, most, True), (most, 0, most, True), (most, 1, 5, False)]


def test_bound_holds():
    r = np.random.default_rng(5)
    x = embedding_dedup.unit(r.standard_normal((2000, 64)))
    y = embedding_dedup.unit(x + r.standard_normal(x.shape) * 0.02)
    code, factor, _ = embedding_dedup.encode(x)
    signs = np.unpackbits(code, axis=1) * 2.0 - 1
    turned = y @ embedding_dedup.rotations(64)[:, :64]
    estimate = (signs * turned).sum(axis=1) / (factor * 8)
    error = embedding_dedup.EPSILON * np.sqrt(1 - factor**2) / factor / np.sqrt(63)
    assert (np.abs(estimate - (x * y).sum(axis=1)) < error).all()
