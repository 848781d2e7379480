import re

import corpus_pipeline
from tokenizers import Tokenizer

from tarn.llm import exact_dedup, mixing, queries

from .test_minhash import brute


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "mix_sources", "bpe_tokens"]
    kept, columns = [docs], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(k))
        stage(spark, kept[-1], sf).write.parquet(out)
        kept.append(spark.read.parquet(out))
    rows = [{r.doc_id: r for r in d.collect()} for d in kept[:4]]
    assert all(d.columns == columns for d in kept[1:5])
    # language: every text with letters stays
    assert set(rows[1]) == {i for i, r in rows[0].items() if re.search(r"[^\W\d_]", r.text or "")}
    # exact: one of each normalised text, the longest, then the smallest id
    best = {}
    for i, r in rows[1].items():
        key = re.sub(r"[\x20\x09-\x0d]", "", r.text)
        best[key] = max(best.get(key, (-1, 0)), (len(r.text), -i))
    assert set(rows[2]) == {-i for _, i in best.values()}
    # near: the smallest id of each component
    assert set(rows[3]) == {i for i, v in brute([(i, r.text) for i, r in rows[2].items()], 5).items() if v[2]}
    # mix: the words taken
    want = {r.doc_id: r.taken for r in mixing.mix(kept[3]).collect() if r.taken}
    got = {}
    mixed = kept[4].collect()
    for r in mixed:
        assert r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r.text))
    assert got == want
    # tokens: those of the library
    library = Tokenizer.from_file(queries.tokenizer_path())
    count = sorted((r.doc_id, len(library.encode(r.text, add_special_tokens=False).ids)) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens) for r in kept[5].collect()) == count


def test_run_on_awkward_rows(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "hello there my friend", "en", None, 21),
            (4, "hello there my friend", "en", "a", 21), (5, "x" * 100_000, "en", "b", 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= {3, 5} and found
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def test_repeated_and_shared_ids_leave_one_row(spark, tmp_path):
    long = " ".join(f"word{k} hello my friend" for k in range(40))
    rows = [(1, long, "en", "a", 9), (1, long, "en", "a", 9), (1, long + " end", "en", "a", 9), (2, long, "en", "a", 9), (None, long, "en", "a", 9), (None, "another text of some words", "en", "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = stage(spark, spark.read.parquet(f"{tmp_path}/{k}"), str(tmp_path))
    left = sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert len(left) == 2 and left[1] == (None, "another text of some words") and left[0][0] == 1
