"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no task and no driver ever holds a component.
A hub's rows lie on one join key; the join carries a second key derived from the first, which
gives both sides a shuffle of their own, and those adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare


def _with_min(rows: DataFrame, least: DataFrame) -> DataFrame:
    tag = lambda c: F.pmod(F.xxhash64(c), F.lit(7))
    return rows.withColumn("tag", tag("u")).join(least.withColumn("tag", tag("u")), ["u", "tag"]).drop("tag")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or the end of one edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(0).alias("under")).union(edges.select("b", F.lit(1)))
    seen = ends.groupBy("node").agg(F.sum("under").alias("under"), F.min("under").alias("least"))
    return seen.where((F.col("under") > 1) | ((F.col("under") > 0) & (F.col("least") == 0))).isEmpty()


#: Edges of longs, a few MB, that one task may solve: fewer than a round of joins is worth.
SMALL = 100_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """The components of ``SMALL`` edges (a, b) at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        x, y = (np.concatenate(ends) for ends in zip(*parts, strict=True))
        nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
        i, j, root = place[: len(x)], place[len(x) :], np.arange(len(nodes))
        while True:
            least = root.copy()
            np.minimum.at(least, root[i], root[j])
            np.minimum.at(least, root[j], root[i])
            while (least[least] != least).any():
                least = least[least]
            if (least == root).all():
                break
            root = least
        for k in range(0, len(nodes), 10_000):
            part = slice(k, k + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[part]), pa.array(nodes[root[part]])], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def components(edges: DataFrame, a: str | Column = "a", b: str | Column = "b", python: bool = False, tasks: int | None = None) -> DataFrame:
    """``(node, component)`` of every node of an edge; the component is its smallest node.

    Self-links, repeated edges and null ends are ignored; an empty table gives an empty one. With ``python`` nodes are longs, and
    a table that a count shows to have ``SMALL`` edges at most is solved in one task; the result is the same.
    ``tasks`` bounds the partitions of the tables of each round.
    """
    prepare(edges.sparkSession)
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    now = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    now = cut(now, tasks)
    if python and now.count() <= SMALL:
        return cut(_in_one_task(now))
    while not _is_stars(now):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_min(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_min(large, least).where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        now = cut(small.union(least.select("m", "u")).distinct(), tasks)
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
