"""Cutting lineage in the folder that the cluster shares, and numbering rows between two cuts."""

from __future__ import annotations

import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups whose first places are broadcast; more are joined by a shuffle of one row a group.
FEW = 500_000


def cut_lineage(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint in ``spark.checkpoint.dir``.

    Where that is unset, a local folder serves local sessions, as in tests; a cluster's executors don't share one, so
    there it is an error.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="veristra-"))
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, groups: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """``df`` with each row's 0-based position in its group (in all of ``df`` without groups), without bringing a group into one task.

    Rows are range-partitioned by group and order, so a hot group spreads over many tasks; positions follow
    from the partitions' row counts (one row per partition is broadcast) and each group's first position.
    """
    taken = {c.lower() for c in df.columns} | {rank.lower()}
    names = iter(f"__{i}" for i in range(1 << 16) if f"__{i}" not in taken)
    at, before, pos, first, part = (next(names) for _ in range(5))
    by = [F.col(f"`{g}`") for g in groups]
    laid = cut_lineage(df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order))
    numbered = laid.withColumn(at, F.monotonically_increasing_id())
    part_of = F.shiftrightunsigned(F.col(at), 33).cast("int")
    counts = sorted((r[0], r[1]) for r in numbered.groupBy(part_of.alias(part)).count().collect())
    offsets, total = [], 0
    for number, n in counts:
        offsets.append((number, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, f"{part} int, {before} long")
    placed = (
        numbered.withColumn(part, part_of)
        .join(F.broadcast(table), part)
        .withColumn(pos, F.col(before) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(at, before, part)
    )
    if not groups:
        return placed.withColumnRenamed(pos, rank)
    named = [next(names) for _ in groups]
    starts = placed.groupBy(*[g.alias(n) for g, n in zip(by, named, strict=True)]).agg(F.min(pos).alias(first))
    if starts.limit(FEW + 1).count() <= FEW:
        starts = F.broadcast(starts)
    on = reduce(Column.__and__, [placed[f"`{g}`"].eqNullSafe(starts[n]) for g, n in zip(groups, named, strict=True)])
    return placed.join(starts, on).withColumn(rank, F.col(pos) - F.col(first)).drop(pos, first, *named)


def forget(*cut: DataFrame) -> None:
    """Delete the files of checkpointed DataFrames that nothing reads any more: what came from them must be cut off by now."""
    for df in cut:
        plan = df._jdf.queryExecution().analyzed()
        if not plan.getClass().getSimpleName() == "LogicalRDD" or plan.rdd().getCheckpointFile().isEmpty():
            raise ValueError("only a DataFrame straight from cut_lineage can be forgotten")
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
