"""Corpus pipeline over ``documents``: each stage calls one operator of ``tarn.llm``.

language -> exact copies -> near copies -> mix -> tokens. Every stage takes what its predecessor
kept and returns the columns of ``documents``; the last returns the tokens' counts and digests.
Rows of the mix repeat a document id once for each pass that takes words of it.

Edge cases: null, empty and letterless texts go in the first stage, whatever their other columns. Null and shared ids are no obstacle: of
a group of copies, exact or near, one row stays, also of rows that repeat each other whole. Null sources are a source of their own. Texts of
any length are taken whole. Additional columns stay, but for those named like the results of the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import bpe, exact_dedup, langid, minhash, mixing, queries


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a determined language; the model is trained on these documents."""
    return langid.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the longest original stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 one document stays."""
    return minhash.drop_near(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document."""
    return mixing.mixed_documents(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every row of the mix."""
    made = {"text", "n_tokens", "ids_sha256", "decoded_sha256"}
    return bpe.encode_documents(docs, queries.tokenizer_path(), [c for c in docs.columns if c.lower() not in made])


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("minhash_near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("bpe_tokens", encode_tokens),
]

#: Language models and tokens are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
