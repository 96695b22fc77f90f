"""Session factory and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "veristra", cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("VERISTRA_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.unionOutputPartitioning", "false")
        .getOrCreate()
    )


#: Rows that a Python worker holds at once: its memory goes by them, not by the size of a task.
BATCH_ROWS = 1000


def steady(spark: SparkSession) -> SparkSession:
    """Spark 4.1 takes a union of equally partitioned inputs as still partitioned; after adaptive coalescing it no longer is,
    and sums over it come out wrong. This turns that off for the session, and has Python workers read ``BATCH_ROWS`` rows at a time."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it comes in a few splits for many cores; a large table never does."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if 4 * df.rdd.getNumPartitions() <= cores else df


def table(spark: SparkSession, sf_dir: str, name: str, each: int | None = None) -> DataFrame:
    """``each``: rows of a task at most, about, for what is dear a row: a split of a well compressed file can hold many."""
    df = steady(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    if each is None:
        return spread(df)
    # no column is read to count
    wanted = max(-(-df.count() // each), min(spark.sparkContext.defaultParallelism, 4 * df.rdd.getNumPartitions()))
    return df.repartition(wanted) if wanted > df.rdd.getNumPartitions() else df
