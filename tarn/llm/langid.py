"""Language identification with bit-sliced Bloom filters of n-grams.

Training counts 4-byte n-grams of lower-cased words for each language and keeps those that are
frequent in it and not much more frequent in another. All filters share their positions: the
table holds at each position one bit for each language, so the words read at an n-gram's
positions, and-ed, are the bitmask of all languages that contain it. A text's n-grams vote with
their masks; each language's count is corrected for its false-positive rate, and the largest wins.

The training sample is bounded: about ``TRAIN_DOCS`` documents of each language, chosen by a hash
of their id, and ``GRAMS`` n-grams of each language. Everything else covers all rows.

Edge cases: null texts and texts without a letter are ``und`` with score 0. Ties go to the first
language by code point; a text with letters but no known n-gram is such a tie, with score 0. Without any labelled row all texts are
``und``. Texts of any length are read whole; columns may have any names. Repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, prepare

TRAIN_DOCS = 3000
GRAMS = 8192
LEAST_SHARE = 2e-6
RIVAL = 0.25
BITS = 20
FOLDS = 5
UNDETERMINED = "und"
#: Texts with a lower score are rejected by ``keep_identified``.
LEAST_SCORE = 0.05

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)  # odd constants of multiplicative hashing
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)
_SLICE = 1 << 20


def grams(text: str) -> Iterator[np.ndarray]:
    """The 4-byte n-grams of a whole text, slice by slice; words are set apart by one space."""
    letters = _FOLD[np.frombuffer((" " + text.lower() + "   ").encode("utf-8", "surrogatepass"), np.uint8)]
    keep = np.append(True, (letters[1:] != 32) | (letters[:-1] != 32))
    letters = letters[keep]
    if len(letters) < 4:
        letters = np.append(letters, np.full(4 - len(letters), 32, np.uint8))
    for begin in range(0, len(letters) - 3, _SLICE):
        part = letters[begin : begin + _SLICE + 3].astype(np.uint32)
        yield (part[:-3] << 24) | (part[1:-2] << 16) | (part[2:-1] << 8) | part[3:]


def positions(values: np.ndarray) -> list[np.ndarray]:
    return [(values * np.uint32(m)) >> np.uint32(32 - BITS) for m in _MULTIPLIERS]


@dataclass
class LanguageModel:
    """Bit-sliced filters: ``table[p]`` has bit l set if language l occupies position p."""

    languages: list[str]
    tables: list[np.ndarray]
    false_rate: np.ndarray

    @classmethod
    def build(cls, found: dict[str, np.ndarray]) -> LanguageModel:
        languages = sorted(found)
        kind = next((t for t in (np.uint8, np.uint16, np.uint32) if np.dtype(t).itemsize * 8 >= len(languages)), np.uint64)
        width = np.dtype(kind).itemsize * 8
        tables = [np.zeros(1 << BITS, kind) for _ in range(0, len(languages), width)]
        filled = []
        for k, name in enumerate(languages):
            table, bit = tables[k // width], kind(1 << k % width)
            for p in positions(found[name].astype(np.uint32)):
                table[p] |= bit
            filled.append(np.count_nonzero(table & bit) / len(table))
        return cls(languages, tables, np.array(filled) ** len(_MULTIPLIERS))

    def counts(self, text: str) -> tuple[np.ndarray, int]:
        """Of each language the n-grams that it contains, corrected for false positives, and their number."""
        hits, total = np.zeros(len(self.languages)), 0
        for values in grams(text):
            total += len(values)
            at = positions(values)
            for first, table in enumerate(self.tables):
                mask = table[at[0]]
                for p in at[1:]:
                    mask = mask & table[p]
                width = table.dtype.itemsize * 8
                own = range(first * width, min(len(hits), (first + 1) * width))
                if width == 8:
                    seen = np.bincount(mask, minlength=256)
                    hits[own.start : own.stop] += [(seen[(np.arange(256) >> (k - own.start)) & 1 == 1]).sum() for k in own]
                else:
                    one = table.dtype.type(1)
                    hits[own.start : own.stop] += [np.count_nonzero(mask & (one << table.dtype.type(k - own.start))) for k in own]
        return np.maximum(0, (hits - total * self.false_rate) / (1 - self.false_rate)), total

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        counts, total = self.counts(text)
        best = int(np.argmax(counts))
        return self.languages[best], float(min(1.0, counts[best] / max(1, total)))


def fold(doc_id: str) -> Column:
    """crc32 of the id as text, modulo the number of folds; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learns from text and non-null language of the documents outside the held-out fold."""
    prepare(docs.sparkSession)
    rows = docs.where((fold(doc_id) != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    # One row for each language: their number is bounded.
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return LanguageModel.build({})
    share = F.create_map(*[x for name, n in sorted(sizes.items()) for x in (F.lit(name), F.lit(min(1.0, TRAIN_DOCS / n)))])
    draw = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    sample = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by.setdefault(name, []).extend(grams(t))
            for name, parts in by.items():
                values, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(values)), pa.array(values.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("lang"))
    counted = counted.withColumn("share", F.col("n") / total)
    counted = counted.withColumn("most", F.max("share").over(Window.partitionBy("gram")))
    counted = counted.where((F.col("share") >= LEAST_SHARE) & (F.col("share") >= RIVAL * F.col("most")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    chosen: dict[str, list[int]] = {}
    for r in counted.withColumn("k", rank).where(F.col("k") <= GRAMS).select("lang", "gram").toLocalIterator():
        chosen.setdefault(r["lang"], []).append(r["gram"])
    return LanguageModel.build({name: np.array(chosen.get(name, []), np.int64) for name in sizes})


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with two more columns; those of the same name are replaced."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # one table of fixed size for every 64 languages at most
    kept = docs.drop(*names) if text not in names else docs
    at = kept.columns.index(text)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields], f"{names[0]} string, {names[1]} double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, *names])

    return kept.mapInArrow(run, schema)


def predictions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    model = train(docs, doc_id, text, lang)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(fold(doc_id) == 0, F.lit(False)).alias("held_out"), F.col(text).alias("__text"))
    return identify(rows, model, "__text").drop("__text")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is determined with at least ``LEAST_SCORE``."""
    model = train(docs, doc_id, text, lang)
    name, score = fresh(docs, "lang", "score")
    found = identify(docs, model, text, (name, score))
    return found.where((F.col(name) != UNDETERMINED) & (F.col(score) >= LEAST_SCORE)).drop(name, score)
