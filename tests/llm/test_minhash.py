import random
import re

import numpy as np
import pytest

from tarn.llm import minhash


def brute(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0d]+", lowered)
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(4000)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, line, rows = say(60), say(7), []
    add = lambda words: rows.append((len(rows) * 3 + 1, " ".join(words)))
    base = say(150)
    for _ in range(60):  # a large group of near copies, some of them too far apart to link directly
        new = list(base)
        for _ in range(r.choice([1, 2, 4, 6, 9])):
            new[r.randrange(len(new))] = r.choice(vocabulary)
        add(new)
    for _ in range(40):  # unrelated texts around a common passage
        add(say(r.choice([5, 20, 200])) + passage + say(r.choice([0, 5, 200])))
    for _ in range(30):  # short texts of a common line
        add(line + say(r.choice([0, 1, 2, 3])))
    for _ in range(20):
        words = say(r.choice([1, 2, 3, 4, 5, 8, 40, 400]))
        add(words)
        add(words)
        add([*words, "tail"])
    return [*rows, (900_000, None), (900_001, " \t"), (900_002, "Ab cD"), (900_003, "aB Cd"), (900_004, "ÀB x y z q")]


@pytest.mark.parametrize(("short", "seed"), [(4, 1), (32, 2)])
def test_same_as_brute_force(spark, monkeypatch, short, seed):
    monkeypatch.setattr(minhash, "LIST", short)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, kept string, n long")
    assert found(minhash.near_groups(docs, width=4)) == brute(rows, 4)


def test_filter_default_width_and_edges(spark):
    rows = [(k, t) for k, t in enumerate(["a b c d e f g h i j k l m n o p q r s t u v w x y z"] * 3 + ["q w e r t y", None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = minhash.drop_near(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, v in brute(rows, 5).items() if v[2]]
    assert minhash.near_groups(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (4, "a b"), (4, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_groups(nulls).collect()) == [(4, 4), (4, 4), (2**63 - 1, 4)]


def test_estimates_agree_with_sets():
    r = np.random.default_rng(0)
    for size in (3, 40, 64, 500):
        sets = [np.unique(r.integers(0, 600, size)) for _ in range(12)]
        kept = [s[: minhash.SKETCH] for s in sets]
        for s, k in zip(sets, kept):
            score = minhash._estimates(k, kept)
            for other, x in zip(sets, score):
                union = np.union1d(s, other)[: minhash.SKETCH]
                assert x == pytest.approx(np.isin(union, np.intersect1d(s, other)).mean())


def test_one_row_of_each_group_stays(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(0, long), (1, long), (1, "other words"), (2, "c d"), (2, "c d"), (2, "c d"), (None, long + " more"), (None, "z"), (8, None), (8, None), (9, " ")]
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long, tag string")
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert found == sorted([(0, long), (1, "other words"), (2, "c d"), (None, "z"), (8, None), (8, None), (9, " ")], key=repr)


def test_both_ways_of_prefix_lists(spark, monkeypatch):
    r = random.Random(4)
    rows = [(k, sorted(r.sample(range(60), r.randint(1, 20)))) for k in range(80)]
    sets = spark.createDataFrame(rows, "id long, shingles array<long>")
    key = lambda df: sorted((x.key, x.id, x.n, x["size"]) for x in df.collect())
    small = key(minhash._prefix_lists(sets, 80))
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", -1)
    assert key(minhash._prefix_lists(sets, 80)) == small
    lists = {}
    for k, i, _, _ in small:
        lists.setdefault(k, set()).add(i)
    by = {i: {*s} for i, s in rows}
    for i in by:
        for j in by:
            if i < j and 100 * len(by[i] & by[j]) >= 80 * len(by[i] | by[j]):
                assert any({i, j} <= ids for ids in lists.values())


def test_small_tables_take_few_tasks(spark, monkeypatch):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(60)]
    kind, made = type(spark.range(0)), []
    plain = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, eager=True: made.append((out := plain(self, eager)).rdd.getNumPartitions()) or out)
    changed = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 4).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 60 and made
    assert max(made) <= spark.sparkContext.defaultParallelism
