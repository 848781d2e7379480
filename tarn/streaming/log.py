"""Structured Streaming forms of the resumable log and of windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import text as T
from tarn.sources import files

#: Partition column of a log: the batch that wrote a row.
BATCH = "_batch"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    """Writes the rows of batch ``number`` into its own folder, which a replay of the batch overwrites."""
    batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")


def append_log(stream: DataFrame, key: list[str], path: str, checkpoint: str):
    """Starts a query that appends the first row of each new key to ``path``; a restart resumes at its checkpoint.

    The keys that are done lie in a state store on the executors' disks, with its changes in the checkpoint: a batch looks up its own keys
    there and never reads the log, so that its cost does not depend on the log's length. A run that ends between a batch's write and its commit
    replays the batch from the state before it: the same keys are new and the same folder is written again. Rows with an error count as
    done, so a resumed run does not retry them.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    new = stream.dropDuplicates(key)
    return new.writeStream.foreachBatch(lambda rows, number: write_batch(rows, number, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop(BATCH)


#: Version of the rules by which columns are derived from a raw output.
DERIVED = 1


def derived(rows: DataFrame, raw: str = "raw_output") -> DataFrame:
    """``rows`` with cleaned_output, thinking_tokens, is_empty, refuses and derived_version, made anew from the raw output alone."""
    made = {"cleaned_output": T.clean_answer(F.col(raw)), "thinking_tokens": T.thinking_tokens(F.col(raw)), "refuses": F.col(raw).rlike(T.REFUSAL)}
    rows = rows.withColumns(made)
    return rows.withColumns({"is_empty": F.col("cleaned_output") == "", "derived_version": F.lit(DERIVED)})


def recompute(spark: SparkSession, path: str, raw: str = "raw_output") -> int:
    """Derives the columns of the published log at ``path`` again where another version of the rules made them; returns how many rows that were.

    The new table becomes current by one atomic step, so readers of the old one are not disturbed, and a log that is up to date is not written again.
    All other columns, and rows with an error, whose output is null, stay as they are.
    """
    rows = files.read_published(spark, path)
    behind = F.lit(True)
    if "derived_version" in rows.columns:
        behind = ~F.col("derived_version").eqNullSafe(F.lit(DERIVED))
    count = rows.where(behind).count()
    if count:
        files.publish(derived(rows, raw), path)
    return count


def windowed(stream: DataFrame, time: str, length: str, late: str, *by: str) -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped, state is bounded by it."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *by).agg(F.count(F.lit(1)).alias("n"))
