"""Exact deduplication that no group of copies can skew.

Copies are first combined inside each task (the map side of the aggregation), then in salted
groups of one digest, then the salts' winners globally. The full text is a grouping key at each
of these stages, so two texts are one group only if they are the same, digest or not. Documents
then find their group by digest; digests that more than one text shares are told apart by the
whole text.

Edge cases: null text counts as empty and all empty texts are one group. A null id counts as the
largest long. In ``exact_groups`` rows
that share an id and a text share the verdict; ``drop_copies`` leaves one row of each group. Texts of any length are compared whole; of equally long
copies the smallest id stays. Other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGEST as _MOST
from .common import cut, one_of_each, prepare, strip_spaces, text_of

SALTS = 16
_TWO_64 = "18446744073709551616BD"


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = text_of(text)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_MOST)).alias("doc_id"), whole.alias("whole"), F.xxhash64(text).alias("tag"))
    rows = rows.select("doc_id", "tag", F.char_length("whole").alias("points"), strip_spaces(F.col("whole")).alias("content"))
    return rows.withColumn("digest", F.unhex(F.sha2("content", 256)))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, digest, keep_id, group_size) and, for reuse, the rows read.

    Of equal texts the row with the most code points, then with the smallest id stays.
    """
    prepare(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    # Most points, then smallest id, as one number: aggregation buffers of fixed width hash.
    order = F.expr(f"cast(points as decimal(20,0)) * {_TWO_64} + ({_MOST}BD - cast(doc_id as decimal(20,0)))").cast("decimal(38,0)")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    salted = rows.groupBy("digest", salt.alias("salt"), "content").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("best"))
    whole = salted.groupBy("digest", "content").agg(F.sum("n").alias("group_size"), F.max("best").alias("best"))
    keep = F.expr(f"cast({_MOST}BD - best % {_TWO_64} as bigint)").alias("keep_id")
    classes = cut(whole.select("digest", keep, "group_size"))
    shared = classes.groupBy("digest").count().where("count > 1")
    plain = rows.select("doc_id", "digest").join(classes, "digest")
    if not shared.isEmpty():
        plain = _told_apart(rows, classes, shared)
    return plain, rows


def _told_apart(rows: DataFrame, classes: DataFrame, shared: DataFrame) -> DataFrame:
    """For digests that several texts share: the class is the one whose kept row has the same text."""
    alone = classes.join(shared, "digest", "left_anti")
    tied = classes.join(shared, "digest", "left_semi")
    kept = rows.select(F.col("doc_id").alias("keep_id"), "digest", "content").join(tied, ["digest", "keep_id"])
    return (
        rows.select("doc_id", "digest").join(alone, "digest").select("doc_id", "digest", "keep_id", "group_size")
        .union(rows.join(kept, ["digest", "content"]).select("doc_id", "digest", "keep_id", "group_size"))
    )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, dropped ones too."""
    found, _ = groups(docs, doc_id, text)
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row of each group, whatever ids its rows share.

    Rows that share id and text are told apart by nothing that the order uses; any one of them stays.
    """
    found, rows = groups(docs, doc_id, text)
    best = found.where("doc_id = keep_id").select("digest", "keep_id").distinct()
    # Of the rows with the kept id those with the most code points; texts of one length by their tag.
    mine = rows.select("digest", F.col("doc_id").alias("keep_id"), "points", "tag").join(best, ["digest", "keep_id"])
    texts = mine.groupBy("digest", "keep_id", "points", "tag").agg(F.count(F.lit(1)).alias("n"))
    first = texts.groupBy("digest", "keep_id").agg(F.max(F.struct("points", -F.col("tag").cast("decimal(20,0)"), "tag", "n")).alias("x"))
    return one_of_each(docs, first.select(F.col("keep_id").alias("id"), F.col("x.tag").alias("tag"), F.col("x.n").alias("n")), doc_id, text)
