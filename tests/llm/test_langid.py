import zlib

import numpy as np

from tarn.llm import langid, queries


def test_held_out_accuracy_and_scores(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text").collect()}
    found = queries.op5_langid(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out]
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    print("held-out accuracy", right / len(held), "least score", min(r.score for r in found))
    assert right / len(held) >= 0.97
    assert min(r.score for r in found) > langid.LEAST_SCORE


def test_edge_cases(spark):
    rows = [(k, t, lang, "x") for k, (t, lang) in enumerate([
        *[("the quick brown fox jumps over the lazy dog and then sleeps", "en"), ("der schnelle braune fuchs springt", "de")] * 20,
        (None, "en"), ("", None), ("123 !?", "en"), ("the", None), ("Ω", None), ("the dog " * 300_000, None), ("xqxqxq", "en"),
    ])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    found = {r.doc_id: (r.lang_pred, r.score) for r in langid.predictions(docs).collect()}
    assert found[0][0] == "en" and found[1][0] == "de"
    assert found[40] == found[41] == found[42] == ("und", 0.0)
    assert found[43][0] == "en" and found[45][0] == "en" and found[44][0] in ("de", "en")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {40, 41, 42, 44}.isdisjoint({r.doc_id for r in kept.collect()})
    assert langid.predictions(docs.limit(0)).count() == 0
    unlabelled = docs.select("doc_id", "text").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in langid.predictions(unlabelled).collect()} == {"und"}


def test_filters_return_all_languages_of_a_gram():
    r = np.random.default_rng(1)
    for many in (3, 20, 70):
        sets = {f"l{k:02}": r.integers(0, 2**32, 500) for k in range(many)}
        model = langid.LanguageModel.build(sets)
        at = langid.positions(sets["l01"].astype(np.uint32))
        width = model.tables[0].dtype.itemsize * 8
        mask = model.tables[0][at[0]] & model.tables[0][at[1]] & model.tables[0][at[2]]
        assert ((mask >> 1) & 1).all()
        assert len(model.tables) == -(-many // width) and (model.false_rate < 1e-6).all()


def test_predictions_are_those_of_exact_sets():
    """Brute force: each n-gram is looked up in the languages' own sets, one by one."""
    r = np.random.default_rng(3)
    letters = {"aa": "etaoinshr", "bb": "enirsatdh", "cc": "esaitnrul", "dd": "qxzjkvwyp"}
    word = lambda k: "".join(r.choice(list(letters[k]), r.integers(2, 8)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    found = {k: np.unique(np.concatenate(list(langid.grams(text(k, 3000))))).astype(np.int64) for k in letters}
    model = langid.LanguageModel.build(found)
    sets = {k: set(v.tolist()) for k, v in found.items()}
    texts = [text(k, n) for k in letters for n in (1, 3, 10, 200)] + ["", "12 !", "é", None, text("aa", 5) + text("bb", 6)]
    for t in texts:
        name, score = model.predict(t)
        if not t or not any(c.isalpha() for c in t):
            assert (name, score) == ("und", 0.0)
            continue
        grams = [g for part in langid.grams(t) for g in part.tolist()]
        hits = {k: sum(g in s for g in grams) for k, s in sets.items()}
        best = max(hits.values())
        assert hits[name] == best and score <= best / len(grams) + 1e-9 and abs(score - best / len(grams)) < 1e-3
        assert name == min(k for k in hits if hits[k] == best)  # ties: the first by name
