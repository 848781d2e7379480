"""What the operators of this subpackage share: checkpoints, batch sizes, text conventions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of one Arrow batch: very long texts must not gather in one batch.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches and makes sure that a reliable checkpoint folder is set.

    The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset in a local session, as in tests, checkpoints go below the warehouse folder; a cluster must name one.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return spark


def cut(df: DataFrame, tasks: int | None = None) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint, so that a lost executor costs no recomputation.

    With ``tasks`` the table has so many partitions at most: small tables are then no hundreds of files and tasks for each step that reads them.
    """
    return (df if tasks is None else df.coalesce(tasks)).checkpoint(eager=True)


def cut_and_free(df: DataFrame, table: bool = False) -> DataFrame:
    """``cut``, whose shuffle files go as soon as the rows are made; with ``table`` a Parquet table takes the place of the checkpoint, as by ``written``.

    Else they stay until the driver's garbage collection finds that no plan refers to them. Only the plan made here is told so: rows that a
    caller reads again keep theirs.
    """
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        rows = df.select("*")
        return written(rows) if table else cut(rows)
    finally:
        conf.set(name, before)


#: Documents whose derived rows (shingles, lists, pairs) are work enough for one task.
TASK_DOCS = 5_000


def tasks_for(spark: SparkSession, documents: int) -> int:
    """Tasks that tables derived from so many documents are worth, one for each core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-documents // TASK_DOCS))


def text_of(column: str | Column = "text") -> Column:
    """A text with null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def strip_spaces(column: Column) -> Column:
    """Deletes every character of ``SPACES``; plain byte search, several times faster than a regex."""
    for character in SPACES:
        column = F.replace(column, F.lit(character), F.lit(""))
    return column


def word_count(column: Column) -> Column:
    """Number of words ``WORD`` in a text; null has none."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


#: Ids that may be broadcast: of two longs each at most, a few MB.
BROADCAST_ROWS = 100_000


def semi(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among ``ids``, a cut table of distinct longs.

    The ids are broadcast if a count shows that they are few; then no row of ``rows`` is shuffled.
    """
    few = ids.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        name = f"__{name}"
        while name in taken:
            name += "_"
        taken.add(name)
        found.append(name)
    return found


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the checkpoint folder, which the driver and all executors see."""
    return f"{prepare(spark).sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table below the checkpoint folder: cuts the lineage and is far smaller than a checkpoint's rows."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Stands for a null id.
LARGEST = 9223372036854775807


def one_of_each(rows: DataFrame, kept: DataFrame, row_id: str, text: str) -> DataFrame:
    """One row of ``rows`` for each of ``kept``: distinct (id, tag, n), the tag being the text's xxhash64 and n the number of such rows.

    Rows that repeat id and text are combined inside each task before they meet, so that many repeats make no large group.
    """
    kept = written(kept)
    key, tag, n = fresh(rows, "id", "tag", "n")
    kept = kept.withColumnsRenamed({"id": key, "tag": tag, "n": n})
    same = (F.coalesce(F.col(row_id).cast("long"), F.lit(LARGEST)) == F.col(key)) & (F.xxhash64(text) == F.col(tag))
    once = rows.join(kept.where(F.col(n) == 1), same, "left_semi")
    again = kept.where(F.col(n) > 1)
    if again.isEmpty():
        return once
    return once.union(rows.join(again, same).dropDuplicates([key, tag]).select(*rows.columns))
