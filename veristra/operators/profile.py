"""Audit of a corpus: counts, completeness, duplicates, lengths and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veristra.functions import text as X
from veristra.operators.evaluate import distribution


def completeness(df: DataFrame) -> DataFrame:
    """(field, missing, empty, missing_rate, empty_rate) of every column in one pass: nulls, and blank texts or empty lists."""
    n = F.greatest(F.lit(1), F.count("*"))
    def blank(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.trim(c) == "" if isinstance(f.dataType, T.StringType) else F.size(c) == 0 if isinstance(f.dataType, (T.ArrayType, T.MapType)) else F.lit(False)
    each = [F.struct(F.lit(f.name).alias("field"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("missing"), F.count_if(blank(f)).alias("empty"), n.alias("n")) for f in df.schema.fields]
    rows = df.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")
    return rows.select("field", "missing", "empty", (F.col("missing") / F.col("n")).alias("missing_rate"), (F.col("empty") / F.col("n")).alias("empty_rate"))


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    """Total, different, surplus and its rate. Copies combine by a hash before anything is shuffled."""
    per = df.groupBy(key.alias("k")).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("different")).select("total", "different", (F.col("total") - F.col("different")).alias("surplus"), F.coalesce(F.try_divide(F.col("total") - F.col("different"), "total"), F.lit(0.0)).alias("rate"))


def reused(df: DataFrame, key: Column, by: str) -> DataFrame:
    """Texts that occur under more than one value of ``by``."""
    return df.groupBy(key.alias("k")).agg(F.count_distinct(by).alias("n")).where("n > 1")


def lengths(df: DataFrame, *by: str, text: str = "text") -> DataFrame:
    measured = df.select(*by, F.length(text).alias("v"))
    return (measured.groupBy(*by) if by else measured).agg(*distribution("v"))


def window_estimate(sentences: Column, size: int = 3, overlap: int = 1) -> Column:
    return F.when(sentences <= 1, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.greatest(F.lit(0), sentences - size) / (size - overlap)).cast("int") + 1))


def chunk_estimates(df: DataFrame, text: str = "text") -> DataFrame:
    """(strategy, vectors, payload_bytes) before anything is built."""
    t = F.col(text)
    s, size = X.sentence_count(t), F.octet_length(t)
    n = lambda c: F.sum(c.cast("long"))
    each = {"atomic": (F.lit(1), size), "sentence_window": (window_estimate(s), size), "parent_child": (window_estimate(s), 2 * size), "semantic_section": (F.when(s >= 4, F.greatest(F.lit(1), F.ceil(X.split_count(t) / 180).cast("int"))).otherwise(0), size)}
    # all strategies in one scan
    sums = df.where(F.length(t) > 0).agg(F.array(*[F.struct(F.lit(k).alias("strategy"), n(v).alias("vectors"), n(b).alias("payload_bytes")) for k, (v, b) in each.items()]).alias("x"))
    return sums.select(F.inline("x"))


def scale(df: DataFrame, targets: tuple[int, ...] = (10_000, 25_000, 50_000, 100_000), dimension: int = 384) -> DataFrame:
    """Vectors, bytes and seconds that larger corpora would take, from the counts of this one."""
    totals = chunk_estimates(df).agg(F.sum("vectors").alias("v"), F.sum("payload_bytes").alias("p")).join(df.agg(F.count_distinct(F.sha2("text", 256)).alias("u")), F.lit(True))
    rows = totals.select("*", F.explode(F.array(*[F.lit(t) for t in targets])).alias("target"))
    vectors = F.bround(F.col("v") / F.col("u") * F.col("target")).cast("long")
    payload = F.bround(F.col("p") / F.col("u") * F.col("target")).cast("long")
    dense, thin = vectors * dimension * 4, vectors * 2048
    return rows.where("u > 0").select("target", vectors.alias("vectors"), dense.alias("dense_bytes"), thin.alias("sparse_bytes"), payload.alias("payload_bytes"), (F.bround(dense * F.lit(1.35)).cast("long") + thin + payload).alias("store_bytes"), (vectors / 25.0).alias("embedding_seconds"), (vectors / 1000.0).alias("upsert_seconds"))


def leaf_paths(schema: T.StructType, prefix: str = "") -> dict[str, str]:
    """Dotted path and type of every leaf of a schema."""
    out: dict[str, str] = {}
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out |= leaf_paths(f.dataType, f"{prefix}{f.name}.")
        else:
            out[f"{prefix}{f.name}"] = f.dataType.simpleString()
    return out


def contract_diff(found: T.StructType, wanted: T.StructType) -> dict[str, list[str]]:
    a, b = leaf_paths(found), leaf_paths(wanted)
    return {"missing": sorted(b.keys() - a.keys()), "unexpected": sorted(a.keys() - b.keys()), "mismatched": sorted(k for k in a.keys() & b.keys() if a[k] != b[k])}


def malformed(**checks: Column) -> Column:
    """Sorted names of the checks that are true."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()])))


def label_class(label: Column) -> Column:
    as_text = F.lower(label.cast("string"))
    return F.when(as_text.isin("1", "true"), "positive").when(as_text.isin("0", "false"), "negative").otherwise("invalid")
