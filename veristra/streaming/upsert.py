"""A stream's rows in a table, each once: repeats are dropped by key, batches are written under their number and then committed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veristra.sources.publish import Folder


def once(stream: DataFrame, key: str, ts: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark. A repeat must come within ``late`` of the first in event time."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def write_batch(rows: DataFrame, number: int, root: str) -> None:
    """Write a batch under its number, then commit it. Done twice, it leaves what it left the first time."""
    rows.write.mode("overwrite").parquet(f"{root}/batches/batch={number}")
    Folder(rows.sparkSession, root).replace(f"commits/{number}", str(number))


def start(stream: DataFrame, root: str, checkpoint: str, mode: str = "append", **trigger: object) -> StreamingQuery:
    """Write a stream into the table in ``root``. Restarted with the same checkpoint, it repeats at most its last batch."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: write_batch(rows, number, root)).trigger(**(trigger or {"availableNow": True})).start()


def committed(spark: SparkSession, root: str) -> list[int]:
    return sorted(int(n) for n in Folder(spark, root).names("commits") if n.isdigit())


def read(spark: SparkSession, root: str, key: str | None = None) -> DataFrame:
    """Rows of committed batches; with a key, a key's rows of its newest batch alone."""
    numbers = committed(spark, root)
    if not numbers:
        raise FileNotFoundError(f"no batch was committed in {root}")
    rows = spark.read.option("basePath", f"{root}/batches").parquet(*[f"{root}/batches/batch={n}" for n in numbers])
    if key is None:
        return rows.drop("batch")
    newest = F.max("batch").over(W.partitionBy(key))
    return rows.withColumn("__newest", newest).where(F.col("batch") == F.col("__newest")).drop("batch", "__newest")

