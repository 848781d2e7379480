"""Session creation and the settings every plan relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tarn", cores: int = 8, memory: str = "20g", **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster passes its own session to the operators."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named input table below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, for work that is heavy for each row.

    A table of fewer splits than cores, a small one that is, is dealt out anew; a larger one keeps its splits, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, spread."""
    return spread(table(spark, sf_dir, "documents"))


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share: that of ``spark.checkpoint.dir``, in a local session without it one below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(folder or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/tarn"
