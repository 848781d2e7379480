"""Exact middles and running sums of groups of any size, without a task that holds a group.

Middles: a mergeable sketch of each group brackets its middle, one pass counts what lies below the bracket, and only the distinct values
inside it, with their counts, are put in order. Running sums: rows are dealt out by ranges of their order, each range is summed, and
the few sums of ranges are scanned for where each range begins.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.operators.retrieval import bounded
from tarn.session import scratch

#: Shares between which the middle lies, and the sketch's accuracy: its error of rank is a hundredth of the distance.
LOW, HIGH, ACCURACY = 0.49, 0.51, 10_000


def middles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """``by``, n, lower and upper: number of values that are not null and the two middle ones, the same if their number is odd.

    The sum of both over two is the median, ``upper`` the upper middle element. Groups without values have no row. Null keys are keys.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("v")).where("v is not null")
    sketch = F.percentile_approx("v", [LOW, HIGH], ACCURACY)
    found = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), sketch.alias("b")).persist()
    names = [f"_{c}" for c in by]
    of = found.select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)], "n", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi"))
    same = F.lit(True)
    for c, k in zip(by, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(k))
    met = rows.join(bounded(of, found.count()), same)
    first, last = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    counts = met.groupBy(*by, "n", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v") <= F.col("hi")).alias("upto")).persist()
    # Were a sketch ever off by more than it promises, its group would be put in order whole.
    held = (F.col("below") <= first) & (last < F.col("upto"))
    counts = counts.select(*[F.col(c).alias(k) for c, k in zip(by, names, strict=True)], "n", "lo", "hi", F.when(held, F.col("below")).otherwise(0).alias("below"), held.alias("held"))
    inside = rows.join(bounded(counts, found.count()), same).where("not held or v between lo and hi")
    values = inside.groupBy(*by, "n", "below", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    values = values.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("c"))
    at = lambda k: F.max(F.when((F.col("from") <= k) & (k < F.col("upto")), F.col("v")))
    return values.groupBy(*by, "n").agg(at(first).alias("lower"), at(last).alias("upper"))


def medians(rows: DataFrame, by: list[str], *values: str) -> DataFrame:
    """``by`` and the median of each of ``values``; groups without values have null medians."""
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("x")) for v in values])).alias("e"))
    found = middles(long.select(*by, "e.name", "e.x"), [*by, "name"], "x").withColumn("x", (F.col("lower") + F.col("upper")) / 2)
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == v, F.col("x"))).alias(v) for v in values])
    whole = rows.select(*by).distinct()
    same = [whole[c].eqNullSafe(wide[c]) for c in by]
    return whole.join(wide, same, "left").select(*[whole[c] for c in by], *values) if by else wide


def running(rows: DataFrame, by: list[str], order: list, value: str | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with ``position`` (from 0) in the order of their group, and with ``value`` also ``before``: its sum over the rows before.

    ``order`` is a total order of each group's rows. Columns named _part and _first must not be there.
    """
    spark = rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"{scratch(spark)}/running/{uuid.uuid4().hex}"
    # Written, so that both readers see one and the same dealing out, also after an executor is lost.
    rows.repartitionByRange(parts, *by, *order).withColumn("_part", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.parquet(folder)
    added = F.col(value).cast("double") if value else F.lit(0.0)
    sums = dealt.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(added), F.lit(0.0)).alias("s"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.struct(F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(earlier), F.lit(0.0)).alias("s"))
    starts = sums.select(F.col("_part").alias("_of"), *[F.col(c).alias(f"_{c}") for c in by], first.alias("_first"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = dealt.join(bounded(starts, starts.count()), same)
    within = Window.partitionBy("_part", *by).orderBy(*order)
    out = met.withColumn("position", F.row_number().over(within) - 1 + F.col("_first.n"))
    if value:
        before = F.coalesce(F.sum(added).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        out = out.withColumn("before", before + F.col("_first.s"))
    return out.select(*rows.columns, "position", *(["before"] if value else []))
