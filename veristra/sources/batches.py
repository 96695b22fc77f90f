"""A Parquet table read in batches by row position: any run can skip what is done, and a run that broke goes on.

Files stand in order of their paths, rows in order of their place in the file, so a row's position needs no sort and
no shuffle: the rows before its file, plus its index there. A batch reads only the files that it overlaps. The driver
holds one entry a file, as Spark's own listing does. JSON lines have no row index; turn them into Parquet once.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristra.sources.publish import Folder

PROGRESS = "progress.json"


@dataclass(frozen=True)
class Files:
    """The files of a table with the position of each one's first row."""

    path: str
    starts: tuple[tuple[str, int, int], ...]

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.starts)

    def print_before(self, done: int) -> str:
        """A hash of the files that hold the first ``done`` rows, with their row counts."""
        return hashlib.sha256(json.dumps([[name, n] for name, start, n in self.starts if start < done]).encode()).hexdigest()


def files_of(spark: SparkSession, path: str) -> Files:
    """Row counts come from the files' footers: no column is read. Empty files take no place."""
    counted = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("name")).count().collect()
    out, total = [], 0
    for name, n in sorted((r[0], r[1]) for r in counted):
        out.append((name, total, n))
        total += n
    return Files(path, tuple(out))


def batch(spark: SparkSession, files: Files, skip: int, take: int, position: str = "position") -> DataFrame:
    """The rows at ``skip`` up to ``skip + take``, all columns and ``position`` (a column of that name raises).

    Beyond the table's end the batch is short or empty. A table without rows has empty batches.
    """
    if skip < 0 or take < 1:
        raise ValueError("skip is at least 0 and take at least 1")
    whole = spark.read.parquet(files.path)
    if position.lower() in {c.lower() for c in whole.columns}:
        raise ValueError(f"the table has a column {position}")
    wanted = [(name, start) for name, start, n in files.starts if start < skip + take and start + n > skip]
    if not wanted:
        return whole.limit(0).withColumn(position, F.lit(None).cast("long"))
    reader = spark.read.schema(whole.schema)
    if Folder(spark, files.path).is_folder():
        reader = reader.option("basePath", files.path)
    name, start = f"__{position}_file", f"__{position}_start"
    rows = reader.parquet(*[unquote(path) for path, _ in wanted]).select("*", F.col("_metadata.file_path").alias(name), F.col("_metadata.row_index").alias(position))
    placed = rows.join(F.broadcast(spark.createDataFrame(wanted, f"`{name}` string, `{start}` long")), name)
    placed = placed.withColumn(position, F.col(position) + F.col(start)).drop(name, start)
    return placed.where((F.col(position) >= skip) & (F.col(position) < skip + take))


def done(spark: SparkSession, root: str) -> dict:
    """What the runs over ``root`` have finished: rows, batches, and the print of the files behind them."""
    return Folder(spark, root).read_json(PROGRESS) or {"rows": 0, "batches": 0, "print": Files("", ()).print_before(0)}


def each(spark: SparkSession, path: str, root: str, size: int, handle: Callable[[DataFrame, int], None]) -> Iterator[int]:
    """Call ``handle(rows, number)`` for each batch that no run has finished, and note it in ``root`` afterwards.

    Yields the batches' numbers as they are finished. A run that breaks in ``handle`` leaves its batch undone: the next
    one gives it the same number and, if ``size`` is the same, the same rows, so ``handle`` has to replace what it wrote under a number.
    Files may be added behind the finished ones; if finished ones changed, or files came before them, the run raises.
    """
    files, folder = files_of(spark, path), Folder(spark, root)
    state = done(spark, root)
    if files.rows < state["rows"] or files.print_before(state["rows"]) != state["print"]:
        raise ValueError(f"the files behind the first {state['rows']} rows are not those that were read")
    while state["rows"] < files.rows:
        handle(batch(spark, files, state["rows"], size), state["batches"])
        rows = min(files.rows, state["rows"] + size)
        state = {"rows": rows, "batches": state["batches"] + 1, "print": files.print_before(rows)}
        folder.replace_json(PROGRESS, state)
        yield state["batches"] - 1


def copy(spark: SparkSession, path: str, root: str, size: int, change: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> int:
    """Write the changed batches below ``root``; each lies in a folder of its number. Returns how many this run wrote."""

    def handle(rows: DataFrame, number: int) -> None:
        change(rows).write.mode("overwrite").parquet(f"{root}/batches/number={number}")

    return sum(1 for _ in each(spark, path, root, size, handle))


def copied(spark: SparkSession, root: str) -> DataFrame:
    """What ``copy`` has finished, with the batch's number; a batch that is being written isn't seen. None finished raises."""
    n = done(spark, root)["batches"]
    if not n:
        raise FileNotFoundError(f"no batch is finished in {root}")
    return spark.read.option("basePath", f"{root}/batches").parquet(*[f"{root}/batches/number={i}" for i in range(n)])
