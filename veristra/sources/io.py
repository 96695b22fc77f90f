"""Readers and writers: JSON lines, CSV, chunks, manifests and report bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veristra.checkpoints import ranked


def fixture(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, a JSON array or CSV by extension; a row that doesn't fit the schema fails the read."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    if path.endswith(".jsonl"):
        return reader.json(path)
    if path.endswith(".json"):
        return reader.option("multiLine", True).json(path)
    if path.endswith(".csv"):
        return reader.option("header", True).option("enforceSchema", False).csv(path)
    raise ValueError(f"unknown kind of file: {path}")


def strict_csv(spark: SparkSession, path: str, header: tuple[str, ...]) -> DataFrame:
    """CSV files as text columns; another header, letter case and order included, or a row of another length fails the read."""
    found = tuple(spark.read.option("header", True).csv(path).columns)
    if found != header:
        raise ValueError(f"the header is {found}, not {header}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("mode", "FAILFAST").option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)


def partition_path(root: str, language: str, split: str, known: dict[str, set[str]]) -> str:
    if split not in known.get(language, set()):
        raise ValueError(f"no file for {language}, {split}")
    return f"{root}/language={language}/split={split}"


def canonical_json(*columns: str) -> Column:
    """One JSON object with sorted keys; null fields are left out."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.select(canonical_json(*df.columns).alias("value")).write.mode("overwrite").text(path)


def write_bundle(df: DataFrame, path: str) -> None:
    """JSON lines and CSV with sorted columns; nested cells as JSON in the CSV."""
    write_jsonl(df, f"{path}/jsonl")
    flat = [F.to_json(F.col(c)).alias(c) if isinstance(df.schema[c].dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(c) for c in sorted(df.columns)]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a few rows; floats to six digits, bars escaped."""
    show = lambda v: "" if v is None else f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *["| " + " | ".join(show(r.get(c)) for c in columns) + " |" for r in rows]])


def fingerprint(df: DataFrame, *columns: str) -> str:
    """Content hash that doesn't depend on order or partitions: the sum of row hashes, their count, and the schema."""
    row = F.xxhash64(*[F.col(c) for c in (columns or df.columns)])
    total, n = df.agg(F.sum(row.cast("decimal(38,0)")), F.count("*")).first()
    return f"{n}:{total}:{df.select(*(columns or df.columns)).schema.simpleString()}"


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``current`` with the rows of ``new`` in place of those of the same key. A key that ``new`` has twice raises."""
    counted = new.groupBy(key).agg(F.count("*").alias("__n")).select(key, F.assert_true(F.col("__n") == 1, F.lit("duplicate key")).alias("__ok"))
    return current.join(counted.select(key), key, "left_anti").unionByName(new.join(counted.where("__ok is null").select(key), key))


def unique_or_fail(df: DataFrame, key: Column) -> None:
    if df.groupBy(key.alias("k")).count().where("count > 1").head(1):
        raise ValueError("values repeat")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Row numbers from 0 in a total order without one task for all rows."""
    return ranked(df, [], [F.col(c) for c in order], "row_number")
