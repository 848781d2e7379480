"""Kernels on literal edge cases, against values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.operators import retrieval as R


def apply(spark, f, values):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in rows.select("k", f(F.col("v")).alias("x")).orderBy("k").collect()]


def test_page_normalisation(spark):
    assert apply(spark, T.normalise_page, ["a  \nb\t\n\n\n\nc \n", "\n\nx", ""]) == ["a\nb\n\nc", "x", ""]


def test_compact(spark):
    assert apply(spark, T.compact, ["“Ab” – c", "ﬁne…", "a b　c d�", "it's", "\u201elow\u201a\u201b \u2015", "a\u2012b"]) == ["ab-c", "fine...", "abcd", "its", "low-", "a\u2012b"]
    assert apply(spark, T.plain, ["\u2018q\u2019 \uf0b7 – x"]) == ["q  - x"]
    assert apply(spark, T.compact_map, ["", "a ﬁ!", "…b"]) == [[], [0, 2, 2, 3], [0, 0, 0, 1]]


def test_refusals(spark):
    yes = ["not given here", "It was NOT FOUND", "does not contain it", "there is no mention", "cannot be found", "cannot determined", "isn't stated", "unable to determine"]
    no = ["I do not know", "I cannot answer", "nothing", "noted", "is not here"]
    assert apply(spark, lambda c: c.rlike(T.REFUSAL), yes + no) == [True] * len(yes) + [False] * len(no)


def test_lenient_json_and_scan_marks(spark):
    assert apply(spark, T.lenient_json, ["[1]", "```json\n[1]\n```", "so [1, [2]] it is", "none", None]) == ["[1]", "[1]", "[1, [2]]", None, None]
    assert apply(spark, T.bad_scan_marks, ["lf ln x", "elf", "a[b c|d e]]f", "a b"]) == [2, 0, 3, 0]


def test_spans_of_chunks_passages_and_pages(spark):
    text = "Intro: “The fee” is due.\nPage two: the ﬁne is 40 euro."
    docs = spark.createDataFrame([(1, text), (2, None), (3, "...")], "doc_id long, text string")
    found = R.chunks(docs, size=4, overlap=1).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.text, r.passage) for r in found] == [
        (1, "intro the fee is", "Intro: “The fee” is"), (1, "is due page two", "is due.\nPage two"), (1, "two the ne is", "two: the ﬁne is"), (1, "is 40 euro", "is 40 euro")]
    assert all(text[r.char_start : r.char_end] == r.passage for r in found)
    passages = spark.createDataFrame([(7, "the fine is"), (8, "'the fee' is due"), (9, "absent words here")], "passage_id long, text string")
    spans = R.located_spans(docs, passages)
    assert {r.passage_id: text[r.lo : r.hi] for r in spans.collect()} == {7: "the ﬁne is", 8: "The fee” is due"}
    hits = R.overlapping(spans, R.chunks(docs, size=4, overlap=1), "char_start", "char_end").collect()
    assert {(r.passage_id, r.chunk_index) for r in hits} == {(7, 2), (7, 3), (8, 0), (8, 1)}
    pages = spark.createDataFrame([(1, 0, 0, 24), (1, 1, 25, 60)], "doc_id long, page_no int, span_start int, span_end int")
    points = spark.createDataFrame([("a", 1, 24), ("b", 1, 25), ("c", 1, 99)], "point_id string, doc_id long, at int")
    assert {r.point_id: r.page_no for r in R.page_of(points, pages).collect()} == {"a": 0, "b": 1}


def test_dense_search_and_fill(spark, monkeypatch):
    monkeypatch.setattr(R, "ROWS", 3)
    monkeypatch.setattr(R, "QUERIES", 2)
    rows = [(f"v{k}", [1.0, k / 10]) for k in range(9)] + [("zero", [0.0, 0.0]), ("null", None)]
    vectors = spark.createDataFrame(rows, "vec_id string, embedding array<double>")
    queries = vectors.where("vec_id in ('v0', 'v4', 'v8', 'zero')").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in R.cosine_topk(vectors, queries, 2).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {"v0": ["v1", "v2"], "v4": ["v5", "v3"], "v8": ["v7", "v6"]}
    scores = spark.createDataFrame([(1, "c", 2.0)], "query_id long, doc_id string, score double")
    items = spark.createDataFrame([(x,) for x in "abcd"], "doc_id string")
    asked = spark.createDataFrame([(1,), (2,)], "query_id long")
    assert sorted(tuple(r) for r in R.ranked(R.filled(scores, items, asked, 2), 2).select("query_id", "rank", "doc_id").collect()) == [(1, 1, "c"), (1, 2, "a"), (2, 1, "a"), (2, 2, "b")]


def test_agreement_of_devices(spark):
    from tarn.operators import grading as G
    from tarn.plans.grading_queries import CASES

    rows = spark.createDataFrame([(c, k, d, t) for c, k, a, b in CASES for d, t in (("gpu", a), ("npu", b))] + [(99, 1, "gpu", "alone")], "c int, kind int, device string, output string")
    found = {r.c: (r.all_empty, r.exact, r.normalised, r.containment, r.substantive) for r in G.agreement(rows, ["c"], "device", "kind", "output").collect()}
    n, t, f = None, True, False
    assert found == {
        1: (f, t, t, t, t), 2: (f, f, t, t, t), 3: (f, f, f, t, t), 4: (f, f, f, f, f), 5: (t, n, n, n, n), 6: (f, f, f, f, f), 7: (f, f, f, f, t), 8: (f, f, f, t, f),
        9: (f, f, f, f, t), 10: (f, f, f, f, f), 11: (f, f, f, f, t), 12: (f, f, f, f, t), 13: (f, f, f, f, f)}


def test_grades_of_empty_answers_and_citations(spark):
    from tarn.operators import grading as G

    rows = spark.createDataFrame([("a", "x", ["1", "2"], ["2"]), ("b", "", ["1"], ["1"]), ("c", "y", [], ["1"]), ("d", "z", ["1"], None), ("e", "w", ["1"], ["1"])], "row_id string, answer string, context_ids array<string>, gold_ids array<string>")
    replies = spark.createDataFrame([("a", 2, 1, ["2"]), ("b", 2, 2, ["1"]), ("c", 1, None, ["1"]), ("d", 0, 0, ["1"])], "row_id string, accuracy int, groundedness int, cited array<string>")
    got = {r.row_id: (r.accuracy, r.groundedness, r.citation_correct, r.judged) for r in G.graded(rows, replies).collect()}
    assert got == {"a": (2, 1, True, True), "b": (0, None, None, False), "c": (1, None, None, True), "d": (0, 0, False, True), "e": (None, None, None, True)}


def test_answers(spark):
    assert apply(spark, T.clean_answer, ["<think>x</think>\n\n42", "<think>\n\nkept", "a<think>lost", "a</think>b", " z　", "<think>\r\n\r\nkept", "A<think>\n\nB", "A<think>\nB\n\nC"]) == ["42", "kept", "a", "ab", "z", "kept", "AB", "A"]
    assert apply(spark, T.thinking_tokens, ["<think>one two</think>x", "<think>a b c", "<think>\n\nkept", "plain"]) == [2, 3, 0, 0]
    assert apply(spark, T.number_set, ["7 and 2.5 and 7", "none"]) == [["2.5", "7"], []]
    assert apply(spark, T.normalise_answer, [" A-b  C! "]) == ["ab  c"]


def test_page_lists_keep_their_digits(spark):
    assert apply(spark, T.page_list, ["0", "10", "100, 11,  22", "20-21, 1"]) == [[0], [10], [100, 11, 22], [20, 21, 1]]


def test_page_lists(spark):
    assert apply(spark, T.page_list, [None, "7", "29-31", "2, 5, 7", "3,,4", "null"]) == [[], [7], [29, 30, 31], [2, 5, 7], [3, 4], []]


@pytest.mark.parametrize(("n", "rows"), [(0, 0), (1, 1), (512, 1), (513, 2), (960, 2), (961, 3)])
def test_window_counts(spark, n, rows):
    docs = spark.createDataFrame([(1, "w " * n)], "doc_id long, text string")
    assert R.chunks(docs).count() == rows


def test_ranking_rules(spark):
    docs = spark.createDataFrame([(1, "cat dog"), (2, "cat cat bird"), (3, "fish"), (4, "dog"), (5, "dog"), (6, "dog")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "cat zebra"), (2, "cat cat")], "query_id long, text string")
    top = R.ranked(R.bm25_scores(docs, queries), 10).collect()
    score = {(r.query_id, r.doc_id): r.score for r in top}
    assert set(score) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    assert score[2, 1] == pytest.approx(2 * score[1, 1], abs=2e-6)
    floored = R.idf_table(R.postings(docs), F.lit(6.0), 0.25).where("term = 'dog'").first().idf
    assert floored > 0 > R.idf_table(R.postings(docs), F.lit(6.0)).where("term = 'dog'").first().idf
    floored_scores = R.bm25_scores(docs, spark.createDataFrame([(1, "dog")], "query_id long, text string"), 0.25)
    assert all(r.score > 0 for r in floored_scores.collect())
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    two = spark.createDataFrame([(1, 12, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in R.fuse(one, two).orderBy("rank").collect()] == [11, 10, 12]


def test_recall_falls_with_wrong_gold(spark):
    ranking = spark.createDataFrame([(q, q, 1) for q in range(10)], "query_id long, doc_id long, rank int")
    right = spark.createDataFrame([(q, q) for q in range(10)], "query_id long, doc_id long")
    wrong = spark.createDataFrame([(q, (q + 1) % 10) for q in range(10)], "query_id long, doc_id long")
    assert R.recall(ranking, right).agg(F.avg("any_1")).first()[0] == 1
    assert R.recall(ranking, wrong).agg(F.avg("any_10")).first()[0] == 0
    assert R.recall(ranking, right.union(wrong)).agg(F.avg("all_10")).first()[0] == 0


def test_chunk_places_are_those_of_the_text_itself(spark):
    """Letters that grow in lower case do not shift places; tokens stay those of the lower-case text."""
    from tarn.operators import retrieval as R

    texts = ["İ ab İx cd", "aİb, Kelvin ß e1", "--- ", "", None, "one", "İİ", "  A-b_c  "]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {}
    for r in R.chunks(rows, size=3, overlap=1).orderBy("doc_id", "chunk_index").collect():
        assert r.passage == texts[r.doc_id][r.char_start : r.char_end] and r.n_tokens == r.token_end - r.token_start == len(r.text.split(" "))
        found.setdefault(r.doc_id, []).append(r)
    import re

    for k, text in enumerate(texts):
        tokens = re.findall("[0-9a-z]+", (text or "").lower())
        windows = [tokens[s : s + 3] for s in range(0, max(1, len(tokens) - 1), 2)] if tokens else []
        assert [r.text.split(" ") for r in found.get(k, [])] == windows
    assert [(r.char_start, r.char_end, r.passage) for r in found[0]] == [(0, 6, "İ ab İ"), (5, 10, "İx cd")]


def test_chunks_are_linear_in_the_document(spark):
    import time

    from pyspark.sql import functions as F
    from tarn.operators import retrieval as R

    def seconds(n):
        rows = spark.range(1).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.concat(F.lit("w"), k % 999)), " ").alias("text")).checkpoint()
        best = []
        for _ in range(2):
            began = time.perf_counter()
            R.chunks(rows).write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - began)
        return min(best)

    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    seconds(1000)
    assert seconds(800_000) < 3 * seconds(400_000) + 1.0


def test_interval_joins_by_bins_are_the_products(spark):
    """Spans and parts of any length, none and beyond several bins; every pair once."""
    import random

    from tarn.operators import retrieval as R

    r = random.Random(8)
    interval = lambda: (lo := r.choice([0, 8, 16, r.randrange(100)]), lo + r.choice([0, 0, 1, 3, 8, 40]))
    spans = [(k, r.randrange(3), *interval()) for k in range(60)]
    parts = [(r.randrange(3), k, *interval()) for k in range(80)]
    a = spark.createDataFrame(spans, "passage_id long, doc_id long, lo long, hi long")
    b = spark.createDataFrame(parts, "doc_id long, page_no long, span_start long, span_end long")
    got = sorted((x.passage_id, x.doc_id, x.page_no) for x in R.overlapping(a, b, "span_start", "span_end", 8).collect())
    assert got == sorted((s, d, p) for s, d, lo, hi in spans for of, p, start, end in parts if of == d and start < hi and end > lo)
    points = a.selectExpr("passage_id as point_id", "doc_id", "lo as at")
    want = {}
    for s, d, at, _ in spans:
        pages = [p for of, p, start, end in parts if of == d and start <= at <= end]
        if pages:
            want[s] = min(pages)
    assert {x.point_id: x.page_no for x in R.page_of(points, b, 8).collect()} == want


def test_sources_of_contexts(spark):
    from tarn.operators import grading as G
    from tarn.plans import evaluation_queries as E

    rows = spark.createDataFrame([(c, k) for c in ("closed_book", "rag", "oracle") for k in range(1, 7)], "cond string, kind int")
    found = {(r.cond, r.kind): (r.source, r.pays) for r in rows.select("*", G.context_source(rows.cond, rows.kind).alias("source")).select("*", G.pays_retrieval(F.col("source")).alias("pays")).collect()}
    assert {k: found["oracle", k] for k in (1, 4, 5)} == {1: ("gold_passage", False), 4: ("gold_passage_pair", False), 5: ("retrieved_chunk", True)}
    assert all(found["rag", k] == ("retrieved_top_k", True) and found["closed_book", k] == ("none", False) for k in range(1, 7))
    c = rows.select("cond", "kind", G.oracle_context(rows.kind, F.lit("g"), F.lit("s"), F.lit("t"), F.lit("id")).alias("x")).where("cond = 'oracle'")
    assert {r.kind: (r.x.source, r.x.passages, r.x.chunk_ids) for r in c.collect() if r.kind > 3} == {
        4: ("gold_passage_pair", ["g", "s"], []), 5: ("retrieved_chunk", ["t"], ["id"]), 6: ("gold_passage", ["g"], [])}
    # The grid's column is that of the rule.
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    grid = spark.sql(f"select * from {E.GRID_SPARK} g", events=events)
    assert grid.where(G.context_source(F.col("cond"), F.col("kind")) != F.col("source")).count() == 0 and grid.select("source").distinct().count() == 5


def test_blank_answers_are_not_judged(spark):
    from tarn.operators import grading as G

    rows = spark.createDataFrame([("a", " \n\u3000 ", ["1"], ["1"]), ("b", None, ["1"], ["1"])], "row_id string, answer string, context_ids array<string>, gold_ids array<string>")
    replies = spark.createDataFrame([("a", 2, 1, ["1"]), ("b", 2, 1, ["1"])], "row_id string, accuracy int, groundedness int, cited array<string>")
    assert {(r.accuracy, r.groundedness, r.citation_correct, r.judged, r.empty_output) for r in G.graded(rows, replies).collect()} == {(0, None, None, False, True)}


def test_kappa_intervals_from_counts_are_those_from_rows(spark):
    import random

    from tarn.operators import grading as G

    def kappa(pairs):
        n = len(pairs)
        same = sum(a == b for a, b in pairs) / n
        chance = sum(sum(a == g for a, _ in pairs) * sum(b == g for _, b in pairs) for g in range(3)) / n**2
        return 1.0 if chance == 1 else (same - chance) / (1 - chance)

    r = random.Random(2)
    rows = [(k, a, a if r.random() < 0.2 + 0.3 * k else r.randrange(3)) for k in range(2) for a in r.choices(range(3), k=150)] + [(2, 1, 1)] * 12 + [(0, None, 1), (0, 1, None)]
    df = spark.createDataFrame(rows, "kind int, a int, b int")
    found = {x.kind: x for x in G.kappa_interval(df, ["kind"], "a", "b").collect()}
    assert (found[2].n, found[2].kappa, found[2].low, found[2].high) == (12, 1.0, 1.0, 1.0)
    for kind in range(2):
        pairs = [(a, b) for k, a, b in rows if k == kind and a is not None and b is not None]
        draws = sorted(kappa(r.choices(pairs, k=len(pairs))) for _ in range(2000))
        assert found[kind].n == 150 and found[kind].kappa == pytest.approx(kappa(pairs))
        assert found[kind].low == pytest.approx(draws[50], abs=0.02) and found[kind].high == pytest.approx(draws[1950], abs=0.02)
    again = {x.kind: x for x in G.kappa_interval(df.repartition(3), ["kind"], "a", "b").collect()}
    assert again == found
    assert G.kappa_interval(df, [], "a", "b", 100).first().n == 312
