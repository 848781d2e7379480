import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarn.llm import bpe, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
CODEC = bpe.BpeCodec.from_file(PATH)
LIBRARY = Tokenizer.from_file(PATH)

TEXTS = [
    "", " \t\n", "Hello wORLD's café café x² ½", "a" * 3000, "abab" * 500, "!!!???" * 50,
    "<|endoftext|>hi<|startoftext|>", "<|end", "ΑΣ ΑΣΑ İstanbul ẞ", "日本語 テキスト 123", "it's we'll they've I'd I'm 'tis",
    "\x00\x01\x1c\x85 　z", "🙂👍🏽 ok",
]


def expected(text):
    e = LIBRARY.encode(text, add_special_tokens=False)
    return e.ids, LIBRARY.decode(e.ids, skip_special_tokens=False)


def test_same_as_library_on_edge_cases():
    for text in TEXTS:
        ids, decoded = expected(text)
        assert CODEC.encode(text) == ids, text
        assert CODEC.decode(CODEC.encode(text)) == decoded


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F, exclude_categories=("Cs",)), max_size=80))
def test_same_as_library_on_random_text(text):
    assert CODEC.encode(text) == expected(text)[0]


def test_leftmost_rounds_agree():
    single = bpe.BpeCodec.from_file(PATH)
    assert single.at_once
    single.at_once = False
    for text in TEXTS:
        assert single.encode(text) == CODEC.encode(text)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    codec = bpe.BpeCodec.from_file(PATH)
    for text in TEXTS:
        assert codec.encode(text) == expected(text)[0]


def test_documents(spark):
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS, None, TEXTS[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    found = {r.doc_id: r for r in bpe.encode_documents(docs, PATH, ["doc_id"], with_ids=True).collect()}
    assert len(found) == len(rows)
    for k, text, _ in rows:
        ids, decoded = expected(text or "")
        assert found[k].ids == ids and found[k].n_tokens == len(ids) and found[k].decoded == decoded
        assert found[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[k].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encode_documents(docs.limit(0), PATH, ["doc_id"]).count() == 0


def test_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: r for r in queries.op1_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids, decoded = expected(d.text or "")
        assert found[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert found[d.doc_id].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
