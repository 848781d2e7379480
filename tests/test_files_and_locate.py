import random

import duckdb
import pytest

from tarn.operators import index, locate
from tarn.operators import retrieval as R
from tarn.plans import chunk_queries, grading_queries, phases
from tarn.sources import files
from tarn.streaming import log


def segments(passage, words):
    found, coverage = locate.Document(words).segments(passage)
    return [x[1:] for x in found], coverage


def test_alignment():
    words = "a b c d e f g h i j k l m n o p".split()
    assert segments("c d e f g".split(), words) == ([(2, 6)], 1.0)
    assert segments("a b c d e X g h i j k".split(), words)[1] == pytest.approx(10 / 11)
    assert segments("c d X f g".split(), words)[1] < 1
    assert segments("a b c d e X p".split(), words)[0] == [(0, 4)]
    assert segments("a b c d e k l m n o".split(), words) == ([(0, 14)], 1.0)
    assert segments("q r s t u v".split(), words) == segments([], words) == segments("a b".split(), []) == ([], 0.0)
    far = [*words, *(f"z{k}" for k in range(500)), *"q1 q2 q3 q4 q5 q6".split()]
    assert segments("a b c d e f q1 q2 q3 q4 q5 q6".split(), far)[0] == [(0, 5), (516, 521)]


def densest(run, words):
    """The greatest density over all stretches that start at any place, by trying every start and end."""
    best = 0.0
    for first in range(len(words)):
        k = 0
        for last in range(first, len(words)):
            k += words[last] == run[k]
            if k == len(run):
                best = max(best, len(run) / (last - first + 1))
                break
    return best


def test_density_is_that_of_all_stretches():
    r = random.Random(4)
    for _ in range(300):
        words = [r.choice("abcd") if r.random() < 0.9 else "r" for _ in range(r.randint(1, 30))]
        run = [r.choice("abcd"), r.choice("abcdr"), r.choice("abcd")][: r.randint(1, 3)]
        found = locate.Document(words).tightest(run)
        counts = [words.count(t) for t in run]
        # The tightest stretch holds the rarest token at some place; around it both sides are nearest.
        assert (found[0] if found else 0.0) == pytest.approx(densest(run, words) if all(counts) else 0.0), (run, words)


def test_candidates_are_all_pairs_with_half_of_the_tokens(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    texts = {k: [r.choice(words) for _ in range(r.randint(0, 12))] for k in range(40)}
    asked = {k: [r.choice(words) for _ in range(r.randint(0, 7))] for k in range(20)}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, words array<string>")
    p = spark.createDataFrame(list(asked.items()), "passage_id long, needle array<string>")
    met = {(x.doc_id, x.passage_id) for x in locate.candidates(d, p).collect()}
    assert {(i, j) for i, t in texts.items() for j, a in asked.items() if a and 2 * len({*a} & {*t}) >= len({*a})} <= met


def test_locate_aligned(spark):
    docs = spark.createDataFrame([(1, "x y one two three four five six z"), (2, "nothing of it"), (3, "one two three, FOUR bad five six")], "doc_id long, text string")
    passages = spark.createDataFrame([(9, "One two three four five six")], "passage_id long, text string")
    found = {r.doc_id: r for r in locate.locate_aligned(docs, passages).collect()}
    assert set(found) == {1, 3} and found[1].found and (found[1].first_token, found[1].last_token) == (2, 7)


def test_few_passages_are_aligned_without_a_shuffle_of_documents(spark, monkeypatch):
    r = random.Random(3)
    word = lambda: f"w{r.randrange(60)}"
    texts = [(k // 2 if k < 6 else k, " ".join(word() for _ in range(r.choice([0, 5, 40, 200])))) for k in range(40)] + [(100, None), (None, "w1 w2 w3"), (101, "")]
    asked = [(k // 2 if k < 4 else k, " ".join(word() for _ in range(r.choice([1, 6, 12])))) for k in range(30)] + [(50, None), (51, "..."), (None, "w1 w2 w3")]
    cuts = [(k + 60, " ".join(t.split()[3:20])) for k, (_, t) in enumerate(texts) if t and len(t.split()) > 30]
    docs, passages = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(asked + cuts, "passage_id long, text string")
    rows = locate.locate_aligned(docs, passages)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    found = sorted(map(tuple, rows.collect()))
    assert {r[0] for r in found} >= {k for k, _ in cuts}
    monkeypatch.setattr(locate, "TERMS", -1)
    more = locate.locate_aligned(docs, passages)
    assert more.columns == rows.columns and sorted(map(tuple, more.collect())) == found
    assert locate.locate_aligned(docs, passages.limit(0)).count() == 0


def test_pages_and_versions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/Doc.V1.txt").write_text("\n===== PAGE 1 =====\na  \n\n\n\nb\n===== PAGE 2 =====\n\n===== PAGE 3 =====\nc")
    (tmp_path / "in/bad.txt").write_text("lead\n===== PAGE 2 =====\nx")
    docs = files.read_texts(spark, f"{tmp_path}/in")
    pages = {(r.doc_id, r.page_no): r.text for r in files.split_pages(docs).collect()}
    assert pages == {("doc.v1", 1): "a\n\nb", ("doc.v1", 2): "", ("doc.v1", 3): "c", ("bad", 2): "x"}
    assert [r.doc_id for r in files.page_faults(docs).collect()] == ["bad"]
    rows = spark.createDataFrame([(1, 1, "d1"), (1, 2, "d2")], "q int, rank int, doc string")
    folder = f"{tmp_path}/frozen"
    assert files.latest_version(spark, folder) == 0
    for v in (2, 10):
        files.freeze({"probes": rows}, folder, v)
    assert files.latest_version(spark, folder) == 10
    with pytest.raises(Exception, match="(?i)exists"):
        files.freeze({"probes": rows}, folder, 10)
    kept = spark.read.parquet(f"{folder}/v10/probes")
    assert files.verify(kept, rows, ["q", "rank", "doc"]) == "IDENTICAL"
    assert files.verify(kept.withColumn("x", kept.rank), rows.withColumn("x", rows.q), ["q", "rank", "doc"]) == "REBUILT"
    assert files.verify(kept, rows.where("rank = 1"), ["q", "rank", "doc"]) == "DRIFTED"
    assert files.latest(spark, f"{tmp_path}/in", ".*[.]txt").endswith("bad.txt")


def test_worksheet_and_jsonl(spark, tmp_path):
    rows = spark.createDataFrame([("K1", 'say "hi", ok\nthen')], "id string, answer string")
    files.write_worksheet(rows, f"{tmp_path}/w", "grade")
    assert files.read_worksheet(spark, f"{tmp_path}/w", "grade").count() == 0
    (tmp_path / "g.csv").write_text('id,answer,grade\nK1,"a, b",2\nK2,c,\n')
    assert [(r.id, r.grade) for r in files.read_worksheet(spark, f"{tmp_path}/g.csv", "grade").collect()] == [("K1", "2")]
    (tmp_path / "l.jsonl").write_text('{"a": 1, "b": "é"}\n{"a": 2}\n')
    assert [tuple(r) for r in files.read_jsonl(spark, f"{tmp_path}/l.jsonl", "a int, b string").orderBy("a").collect()] == [(1, "é"), (2, None)]


def test_log_resumes_and_windows(spark, tmp_path):
    schema = "k int, error string, ts timestamp"
    for part, sql in enumerate(["select 1 k, 'e' error, timestamp'2024-01-01 00:00:10' ts union all select 1, null, timestamp'2024-01-01 00:01:10'", "select 1 k, cast(null as string) error, timestamp'2024-01-01 00:02:10' ts union all select 2, null, timestamp'2024-01-01 00:02:20'"]):
        spark.sql(sql).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        log.append_log(stream, ["k"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == part + 1
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    q = log.windowed(stream, "ts", "1 minute", "5 minutes").writeStream.format("memory").queryName("wins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.sql("select n from wins").collect()) == [1, 1, 2]


def test_json_lines_and_replaced_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é\n"), (2, None)], "a int, b string")
    files.write_jsonl(rows, f"{tmp_path}/j")
    assert sorted((r.a, r.b) for r in files.read_jsonl(spark, f"{tmp_path}/j", "a int, b string").collect()) == [(1, "é\n"), (2, None)]
    for k in (1, 2):
        files.replace(rows.where(f"a <= {k}"), f"{tmp_path}/table")
        assert spark.read.parquet(f"{tmp_path}/table").count() == k
    # A rewrite may read what it replaces.
    files.replace(spark.read.parquet(f"{tmp_path}/table").union(rows), f"{tmp_path}/table")
    assert spark.read.parquet(f"{tmp_path}/table").count() == 4


def test_records_and_source_references(spark, tmp_path):
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes/x.md").write_text("## Q9\n- **source:** Hidden.pdf")
    (tmp_path / "Set.md").write_text("- **type:** 9\n## Q1\n- **source:** Rules.PDF\n- **type:** 4\n- **source2:** Guide.v2.pdf\r\n- **page2:** 2, 4-5\n## Q3\n- **source:** null\n- **type:** 5\n- **type:** 6")
    rows = files.read_records(spark, f"{tmp_path}")
    found = {r.qid: (r.fields["type"], r.fields.get("source2")) for r in rows.collect()}
    assert found == {"Set::Q1": ("4", "Guide.v2.pdf"), "Set::Q3": ("6", None)}
    assert [r.doc_id for r in files.source_references(rows).orderBy("doc_id").collect()] == ["guide.v2", "rules"]


def test_index_round_trip_and_universe(spark, tmp_path):
    docs = spark.createDataFrame([("a", "cat dog"), ("b", "cat cat bird"), ("c", "fish"), ("d", "dog sun"), ("e", "rain")], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "cat"), (2, "fish rain")], "query_id long, text string")
    folder = f"{tmp_path}/index"
    index.build(docs, f"{folder}/v2")
    index.build(docs.where("doc_id <> 'e'"), f"{folder}/v10")
    assert index.resolve(spark, folder).endswith("/v10")
    opened = index.open_index(spark, f"{folder}/v2")
    got = {(r.query_id, r.doc_id): r.score for r in opened.scores(queries).collect()}
    want = {(r.query_id, r.doc_id): r.score for r in R.bm25_scores(docs, queries, R.EPSILON).collect()}
    assert got == pytest.approx(want) and len(got) == 4
    spark.read.parquet(f"{folder}/v2/documents").limit(3).write.parquet(f"{folder}/broken/documents")
    for name in ("postings", "terms", "manifest"):
        spark.read.parquet(f"{folder}/v2/{name}").write.parquet(f"{folder}/broken/{name}")
    with pytest.raises(ValueError, match="universe"):
        index.open_index(spark, f"{folder}/broken")
    with pytest.raises(Exception, match="(?i)exists"):
        index.build(docs, f"{folder}/v2")


def test_phases_stop_at_a_closed_gate():
    done = []
    plan = [phases.Phase("one", lambda: done.append(1)), phases.Phase("two", lambda: done.append(2), gate=lambda: "drifted"), phases.Phase("three", lambda: done.append(3))]
    assert phases.run(plan) == [("one", "done"), ("two", "stopped: drifted")] and done == [1]
    assert phases.run(plan[:1] + plan[2:]) == [("one", "done"), ("three", "done")]


def test_published_tables_are_replaced_at_once(spark, tmp_path):
    """A reader in a loop never fails and sees whole versions; a crash leaves the old one."""
    import threading

    path = f"{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        files.current(spark, path)
    files.publish(spark.range(10).withColumn("v", R.F.lit(0)), path)
    seen, wrong, stop = [], [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                rows = [tuple(r) for r in files.read_published(spark, path).groupBy("v").count().collect()]
                seen.append(rows[0][0])
                if rows != [(rows[0][0], 10)]:
                    wrong.append(rows)
            except Exception as e:
                wrong.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 7):  # each reads the version it replaces
        files.publish(files.read_published(spark, path).withColumn("v", R.F.lit(k)), path)
    stop.set()
    reader.join()
    assert not wrong and seen == sorted(seen) and len({*seen}) > 1
    assert len([n for n in files.names(spark, path) if n != "_marks"]) == files.KEPT
    with pytest.raises(Exception, match="(?i)divi"):  # a job that fails half-way
        files.publish(spark.range(0, 1000, 1, 4).select(R.F.expr("1 div if(id = 999, 0, 1)").alias("v")), path)
    assert files.read_published(spark, path).first().v == 6
    spark.range(3).write.parquet(f"{path}/{'0' * 32}")  # written, never marked
    assert files.read_published(spark, path).count() == 10


def test_a_failed_replacement_leaves_the_old_table(spark, tmp_path):
    path = f"{tmp_path}/plain"
    files.replace(spark.range(4), path)
    with pytest.raises(Exception, match="(?i)divi"):
        files.replace(spark.range(9).select(R.F.expr("1 div (id - 8)").alias("id")), path)
    assert spark.read.parquet(path).count() == 4


def log_runs(spark, folder, parts, schema="k int, note string"):
    """One run of the log query after each further part of its input; yields the query."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        q = log.append_log(spark.readStream.schema(schema).parquet(f"{folder}/in"), ["k"], f"{folder}/log", f"{folder}/state")
        q.awaitTermination(120)
        yield q


def test_a_batch_of_the_log_costs_its_own_keys(spark, tmp_path):
    parts = [[(k, f"run{n}") for k in range(n * 500 - 5, n * 500 + 500)] for n in range(3)] + [[(7, "again"), (9999, "new")]]
    for n, q in enumerate(log_runs(spark, tmp_path, parts)):
        state = q.lastProgress["stateOperators"][0]
        done = q.lastProgress["numInputRows"]
        # Only the batch's rows are read; what is stored is what is new.
        assert done == len(parts[n]) and state["numRowsUpdated"] == (505 if n == 0 else 500 if n < 3 else 1)
        rows = {r.k: r.note for r in log.read_log(spark, f"{tmp_path}/log").collect()}
        assert len(rows) == log.read_log(spark, f"{tmp_path}/log").count() == state["numRowsTotal"]
    assert rows[7] == "run0" and rows[9999] == "new" and rows[499] == "run0"


def test_a_killed_batch_is_finished_by_the_next_run(spark, tmp_path, monkeypatch):
    whole = log.write_batch

    def killed(*args):
        whole(*args)
        raise RuntimeError("killed between write and commit")

    runs = log_runs(spark, tmp_path, [[(k, "a") for k in range(40)], [(k, "b") for k in range(30, 50)], [(k, "c") for k in range(45, 60)]])
    next(runs)
    monkeypatch.setattr(log, "write_batch", killed)
    with pytest.raises(Exception, match="killed"):
        next(runs)
    monkeypatch.setattr(log, "write_batch", whole)
    for _ in log_runs(spark, tmp_path, [[(k, "c") for k in range(45, 60)]]):
        pass
    rows = log.read_log(spark, f"{tmp_path}/log").collect()
    assert sorted(r.k for r in rows) == list(range(60))
    assert {r.k: r.note for r in rows}[45] == "b"  # the killed batch's rows, written again by its replay


def test_gold_segments(spark):
    far = " ".join(f"z{k}" for k in range(300))
    docs = spark.createDataFrame([(1, f"Head: one two, three four FIVE six. {far} alpha beta-gamma delta epsilon zeta!"), (2, "İ some “thing” to find here"), (3, None), (4, "other")], "doc_id string, text string")
    passages = spark.createDataFrame([
        (1, "1", "one two three four five six alpha beta gamma delta epsilon zeta"), (2, "2", "something tofind"), (3, "3", "one"), (4, "4", "quite different words all along"), (5, "1", None), (6, "1", "...")],
        "passage_id long, doc_id string, text string")
    text = {r.doc_id: r.text for r in docs.collect()}
    found = {(r.passage_id, r.segment): r for r in locate.gold_segments(docs, passages).collect()}
    assert sorted(found) == [(1, 0), (1, 1), (2, 0)]
    cut = {k: text[r.doc_id][r.lo : r.hi] for k, r in found.items()}
    assert cut == {(1, 0): "one two, three four FIVE six", (1, 1): "alpha beta-gamma delta epsilon zeta", (2, 0): "some “thing” to find"}
    assert found[1, 1].n_spans == 2 and found[1, 0].coverage == found[1, 0].density == 1.0


def test_blocks_of_passages_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(locate, "PASSAGES", 3)
    words = [f"a{k}" for k in range(200)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1]))], "doc_id long, text string")
    passages = spark.createDataFrame([(k, " ".join(words[k * 10 : k * 10 + 8])) for k in range(18)], "passage_id long, text string")
    rows = [r for r in locate.locate_aligned(docs, passages).collect() if r.found]
    assert sorted((r.passage_id, r.doc_id, r.first_token, r.n_spans) for r in rows) == [(k, 1, k * 10, 1) for k in range(18)]


def test_question_faults(spark, tmp_path):
    field = lambda **f: "\n".join(f"- **{k}:** {v}" for k, v in f.items())
    good = {"type": 1, "question": "What?", "answer": "a", "passage": "p", "source": "A.pdf", "page": "1-2"}
    records = [good, good | {"page": "3"}, good | {"answer": "null"}, good | {"source": "B.pdf"}, good | {"type": 4}, good | {"type": 5}, good | {"type": 5, "passage": "null", "source": "null", "page": "null"},
               good | {"type": 4, "passage2": "q", "source2": "A.pdf", "page2": "0"}, good | {"page": "null"}]
    (tmp_path / "S.md").write_text("\n".join(f"## Q{k}\n{field(**r)}" for k, r in enumerate(records)) + f"\n## Q0\n{field(**good)}")
    rows = files.questions(files.read_records(spark, f"{tmp_path}"))
    found = {}
    for r in files.question_faults(rows, spark.createDataFrame([("a", 2)], "doc_id string, n_pages int")).collect():
        found.setdefault(r.qid, set()).add(r.fault)
    assert found == {
        "S::Q0": {"repeated"}, "S::Q1": {"page out of bounds"}, "S::Q2": {"no answer"}, "S::Q3": {"unknown document"}, "S::Q4": {"no passage2", "no doc_id2"},
        "S::Q5": {"passage of nothing", "doc_id of nothing"}, "S::Q7": {"page out of bounds"}}
    first = rows.where("q_num = 7").first()
    assert (first.page_list, first.page_list2, first.doc_id2, first.passage2) == ([1, 2], [0], "a", "q") and rows.where("q_num = 1").first().passage2 is None


def test_derived_columns_are_rebuilt_in_place(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/log"
    rows = spark.createDataFrame([(1, "<think>a b</think> 42", "old"), (2, "It is not stated.", "old"), (3, "<think>x", "old"), (4, None, "old")], "qid int, raw_output string, cleaned_output string")
    files.publish(rows, path)
    old = files.read_published(spark, path)
    assert log.recompute(spark, path) == 4
    found = {r.qid: (r.cleaned_output, r.thinking_tokens, r.is_empty, r.refuses, r.derived_version) for r in files.read_published(spark, path).collect()}
    assert found == {1: ("42", 2, False, False, 1), 2: ("It is not stated.", 0, False, True, 1), 3: ("", 1, True, False, 1), 4: (None, None, None, None, 1)}
    assert {r.cleaned_output for r in old.collect()} == {"old"}  # a reader of the old version goes on
    now = files.current(spark, path)
    assert log.recompute(spark, path) == 0 and files.current(spark, path) == now
    monkeypatch.setattr(log, "DERIVED", 2)
    assert log.recompute(spark, path) == 4 and files.current(spark, path) != now
    assert {r.qid: r.cleaned_output for r in files.read_published(spark, path).collect()} == {k: v[0] for k, v in found.items()}


def test_composites_are_aligned_in_their_row(spark, tmp_path):
    """No text is shuffled or grouped by document; the segments are those of passages that are joined to their documents."""
    r = random.Random(3)
    docs = [(k, " ".join([f"A{k}", *(r.choice(["on", "the", "Übel", "x.y"]) + str(r.randrange(50)) for _ in range(220)), f"Z{k}", *(f"w{i}" for i in range(19))])) for k in range(30)]
    docs += [(90, None), (91, ""), (92, "short"), (None, docs[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = chunk_queries.composite_segments(spark, str(tmp_path))
    assert "hashpartitioning" not in found._jdf.queryExecution().toString()
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == 60 and {r[0] for r in rows} == set(range(30))
    asked = chunk_queries.composites(spark, str(tmp_path)).drop("whole")
    assert rows == sorted(map(tuple, locate.gold_segments(spark.createDataFrame(docs, "doc_id long, text string"), asked).collect()))


def test_graded_rows_are_not_joined_with_themselves(spark, tmp_path):
    """Logged rows that repeat each other are graded once each, and none is shuffled with the gold chunks of its question."""
    passage = "seven green whales sing slowly beneath the old northern harbour every winter evening"
    docs = [(k, f"start {k} {passage} end") for k in range(12)] + [(50, "other words"), (51, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "unknown")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    events = [(1, 4, "m", 1.0, '{"k": 7}'), (41, 5, "m", 1.0, '{"k": 8}'), (41, 5, "m", 1.0, '{"k": 8}'), (2, 4, None, 1.0, '{"k": 7}')]
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double, props string").selectExpr("*", "timestamp'2024-01-01' as ts").write.parquet(f"{tmp_path}/events.parquet")
    found = grading_queries.grade_rows(spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [event_id") == 1
    with duckdb.connect() as con:
        for name in ("documents", "benchmark", "events"):
            con.execute(f"create view {name} as select * from read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
        cur = con.execute(grading_queries.ORACLES["grade_rows"])
        names = [c[0] for c in cur.description]
        want = cur.fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.select(*names).collect())
    assert len(want) == 4
