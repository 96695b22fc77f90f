"""Latency and log analytics: stages, outcomes, retries, histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristra.operators.evaluate import nearest_rank


def summary(value: str) -> list[Column]:
    """Samples, nearest-rank percentiles, largest and mean of measured values; missing ones are never filled."""
    return [F.count(value).alias("samples"), nearest_rank(value, 50).alias("p50"), nearest_rank(value, 70).alias("p70"), nearest_rank(value, 95).alias("p95"), F.max(value).alias("p100"), F.avg(value).alias("mean")]


def by_stage(responses: DataFrame, timings: str = "timings_ms") -> DataFrame:
    """Summary of each stage of a map of timings, with its coverage of all rows."""
    total = responses.agg(F.count("*").alias("rows"))
    each = responses.select(F.explode(timings).alias("stage", "ms")).where(F.col("ms").isNotNull() & ~F.isnan("ms"))
    found = each.groupBy("stage").agg(*summary("ms"))
    return found.join(F.broadcast(total), F.lit(True)).withColumn("coverage", F.col("samples") / F.col("rows")).drop("rows")


def subtotal(*stages: Column) -> Column:
    """Sum of all stages; null unless each is measured, finite and not negative."""
    out = F.lit(0.0)
    for s in stages:
        out = out + F.when((s >= 0) & ~F.isnan(s) & (s < float("inf")), s)
    return out


def last_samples(df: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each group. Spark drops older ones within a partition before the shuffle."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def last_known(df: DataFrame, by: str, value: Column, order: Column) -> DataFrame:
    """The last value that isn't null of each group; combines before the shuffle."""
    return df.groupBy(by).agg(F.max_by(value, F.when(value.isNotNull(), order)).alias("last"))


def sequence_gaps(df: DataFrame, by: str, number: str) -> DataFrame:
    """Rows whose number doesn't follow the one before; the first must be 0."""
    w = W.partitionBy(by).orderBy(number)
    return df.withColumn("due", F.coalesce(F.lag(number).over(w) + 1, F.lit(0))).where(F.col(number) != F.col("due"))


def backoff(attempt: Column, base_ms: float, most_ms: float) -> Column:
    return F.least(F.lit(most_ms), base_ms * F.pow(F.lit(2.0), attempt))


# Close codes, HTTP status and what follows; response states and their outcome.
def retry(close_code: Column, status: Column, error: Column) -> Column:
    """retry_with_backoff, reconnect_new_session or do_not_retry; sent audio is never replayed."""
    return (
        F.when(error == "invalid_config", "do_not_retry")
        .when((close_code == 1011) | status.isin(500, 503), "retry_with_backoff")
        .when((close_code == 1008) | (status == 408), "reconnect_new_session")
        .otherwise("do_not_retry")
    )


def outcome(state: Column, answered: Column) -> Column:
    """answered: whether an answer with citations is there."""
    return (
        F.when((state == "COMPLETED") & answered, "grounded")
        .when(state == "ABSTAINED", "abstained")
        .when(state == "NEEDS_REPEAT", "repeat")
        .when(state == "UNSAFE", "blocked")
        .when(state == "DEADLINE_FALLBACK", "fallback")
        .when(state == "DEPENDENCY_UNAVAILABLE", "unavailable")
        .otherwise("failed")
    )
