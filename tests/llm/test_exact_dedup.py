import hashlib
import re

from tarn.llm import exact_dedup

SCHEMA = "doc_id long, text string, digest string, content string, lang string"


def expected(rows):
    groups = {}
    for i, text, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), i))
    return {
        i: (min(g)[1], len(g), min(g)[1] == i, hashlib.sha256(c.encode()).hexdigest())
        for c, g in groups.items() for _, i in g
    }


def found(df):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect()}


ROWS = [(k, t, "x", None, "en") for k, t in enumerate([
    "a b", "ab", " a\tb ", None, "", "  ", " ", "A b", "x" * 50_000, "x " * 50_000, "é", "é", "a b", *["same"] * 300])]


def test_edge_cases(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert found(exact_dedup.exact_groups(docs)) == expected(ROWS)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, e in expected(ROWS).items() if e[2]}
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a"), (-5, "b")], "doc_id long, text string")
    rows = sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    most = 2**63 - 1
    assert rows == [(-5, -5, 1, True), (1, 1, 3, True), (1, 1, 3, True), (most, 1, 3, False)]


def test_equal_digests_of_different_texts_stay_apart(spark):
    rows = spark.createDataFrame(
        [(1, "a", "d"), (2, "b", "d"), (3, "a", "d"), (4, "c", "e")], "doc_id long, content string, digest string")
    classes = spark.createDataFrame([("d", 1, 2), ("d", 2, 1), ("e", 4, 1)], "digest string, keep_id long, group_size long")
    shared = classes.groupBy("digest").count().where("count > 1")
    told = exact_dedup._told_apart(rows, classes, shared).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in told) == [(1, 1, 2), (2, 2, 1), (3, 1, 2), (4, 4, 1)]


def test_one_row_of_each_group_stays(spark):
    rows = [(0, "a"), (1, "a"), (1, "b"), (2, "c"), (2, "c"), (None, "a"), (None, "z"), (5, "d e"), (5, "de "), (5, "d  e"), (6, None), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, k, "x") for k, (i, t) in enumerate(rows)], "doc_id long, text string, n long, tag string")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    found = kept.collect()
    assert sorted(((r.doc_id, r.text) for r in found), key=repr) == sorted([(0, "a"), (1, "b"), (2, "c"), (None, "z"), (5, "d  e"), (6, None)], key=repr)
    assert all(rows[r.n] == (r.doc_id, r.text) for r in found)
