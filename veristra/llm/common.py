"""What several of the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristra import checkpoints
from veristra.checkpoints import forget, ranked
from veristra.session import steady, table

#: Characters between words: space, and tab to carriage return.
WHITE = "\\x20\\x09-\\x0D"
WORD = f"[^{WHITE}]+"
#: Rows of a table that is broadcast instead of shuffling the other side to it.
FEW = 500_000


#: Rows that a Python worker gets at once. Texts can be long, and a batch is held on both sides.
BATCH_ROWS = 1000


def thrifty(spark: SparkSession) -> SparkSession:
    steady(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the folder that the cluster shares; lost executors then cost no recomputation."""
    spark = thrifty(df.sparkSession)
    done = checkpoints.cut_lineage(df)
    # shuffles that only the cut lineage held are deleted once the driver has collected its objects
    spark.sparkContext._jvm.System.gc()
    return done


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Column names built from ``wanted`` that clash with none of ``df`` (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, most: int = FEW) -> DataFrame:
    """``df``, to be broadcast if it has at most so many rows; larger ones are left to the join's own strategy."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return table(thrifty(spark), sf_dir, name)


__all__ = ["FEW", "WHITE", "WORD", "cut_lineage", "forget", "fresh", "ranked", "read", "small", "word_count"]
