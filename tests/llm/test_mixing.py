import random
import re

import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing


def water_fill(sizes):
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = {s: w for s, w in weights.items() if s not in fixed}
        level = (total - sum(fixed.values())) / sum(free.values()) if free else 0
        over = [s for s, w in free.items() if level * w > 3 * sizes[s]]
        if not over:
            return fixed | {s: level * w for s, w in free.items()}
        fixed |= {s: 3 * sizes[s] for s in over}


def make(spark, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(3000):
        source = r.choice([None, "z", "é", "a", "b", *["hot"] * 3, "tiny"]) if k % 50 else "tiny"
        if source == "tiny" and k % 50:
            source = "a"
        rows.append((k, " ".join("w" * r.randint(1, 5) for _ in range(r.choice([0, 1, 5, 60, 400])))if k % 97 else None, source, 7, "keep"))
    rows.append((5000, "long " * 30_000, "a", 1, "keep"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string")


def test_targets_bounds_and_reruns(spark):
    rows, docs = make(spark)
    size = {i: len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for i, t, *_ in rows}
    of = {}
    for i, _, s, *_ in rows:
        of[s] = of.get(s, 0) + size[i]
    want = water_fill(of)
    found = mixing.mix(docs).collect()
    assert sorted(r.doc_id for r in found) == sorted(size)
    got = {}
    for r in found:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size and r.source_size == of[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
        got[r.source] = got.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(got[s] - t) <= 0.03 * t + 3 * mixing.BLOCK_WORDS
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, again), key=str)


def test_mixed_documents_hold_the_words_taken(spark):
    rows, docs = make(spark, 2)
    want = {(r.doc_id): r.taken for r in mixing.mix(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {}
    texts = {i: t for i, t, *_ in rows}
    for r in mixed.collect():
        n = len((r.text or "").split())
        got[r.doc_id] = got.get(r.doc_id, 0) + n
        assert r.text == texts[r.doc_id] or set(r.text.split()) <= set(texts[r.doc_id].split())
    assert got == {i: n for i, n in want.items() if n}


def test_permutations(spark):
    for n in [1, 2, 3, 5, 17, 256, 1000, 4097]:
        row = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3)).alias("p"))
        assert sorted(r.p for r in row.collect()) == list(range(n))


def test_empty_and_blank(spark):
    schema = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], schema)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, None), (2, " ", "a")], schema)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in blank) == [(1, 0, 0), (2, 0, 0)]
    assert all(r.target == 0 for r in blank)


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a b c " * 200, "s", "x")] * 3 + [(None, "d e " * 300, "s", "y"), (None, "f g h " * 250, "s", "z"), (2, "k " * 900, None, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __ranges string").selectExpr("*", "1 as __whole", "2 as tag", "3 as places")
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    found = mixed.collect()
    assert sum(len(r.text.split()) for r in found) == taken
    assert all(set(r.text.split()) <= {1: {"a", "b", "c"}, 2: {"k"}}.get(r.doc_id, {"d", "e"} if r["__ranges"] == "y" else {"f", "g", "h"}) for r in found)
    assert len(found) <= mixing.PASSES * len(rows)
