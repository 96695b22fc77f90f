"""Streams over the event table, and the same over the finished table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristra.plans.index import scratch
from veristra.plans.registry import query
from veristra.session import steady, table
from veristra.streaming import capped, recorder, upsert

IDLE, LONGEST = 6 * 3600, 15 * 3600
CAPPED = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t_us FROM events WHERE ts IS NOT NULL),
g AS (SELECT *, CASE WHEN t_us - lag(t_us) OVER (PARTITION BY user_id ORDER BY t_us) < 21600000000 THEN 0 ELSE 1 END AS new FROM e),
r AS (SELECT user_id, t_us, sum(new) OVER (PARTITION BY user_id ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS run FROM g),
starts AS (SELECT user_id, run, min(t_us) AS s FROM r GROUP BY user_id, run UNION ALL SELECT a.user_id, a.run, min(r.t_us) FROM starts a JOIN r ON r.user_id = a.user_id AND r.run = a.run AND r.t_us >= a.s + 54000000000 GROUP BY a.user_id, a.run),
spans AS (SELECT *, lead(s) OVER (PARTITION BY user_id, run ORDER BY s) AS next FROM starts),
found AS (SELECT p.user_id, s, max(t_us) AS last, count(*) AS n FROM spans p JOIN r ON r.user_id = p.user_id AND r.run = p.run AND t_us >= s AND (next IS NULL OR t_us < next) GROUP BY p.user_id, s),
sessions AS (SELECT user_id, s AS start_us, least(last + 21600000000, s + 54000000000) AS end_us, n, CASE WHEN s + 54000000000 < last + 21600000000 THEN 'longest' ELSE 'idle' END AS reason FROM found)
SELECT * FROM sessions"""


@query(CAPPED)
def capped_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users that end after six hours of silence, or fifteen hours after they began."""
    return capped.capped_sessions(table(spark, d, "events"), idle=IDLE, longest=LONGEST)


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = steady(spark).read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def run(stream: DataFrame, root: str, mode: str = "append") -> None:
    """To the end of what is there, with state in RocksDB."""
    spark, store = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        upsert.start(stream, f"{root}/table", f"{root}/checkpoint", mode).awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)


@query(CAPPED + " WHERE end_us <= (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 FROM events)")
def streamed_sessions(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream: sessions that have ended ten minutes before the newest event."""
    root = scratch(spark, "sessions")
    run(capped.stream_capped_sessions(event_stream(spark, d), idle=IDLE, longest=LONGEST), root)
    return upsert.read(spark, f"{root}/table").where("kind = 'session'").select("user_id", "start_us", "end_us", "n", "reason")


@query("SELECT event_id, user_id, event_type, value FROM events")
def streamed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Events that come twice, from two sources, and are written once."""
    root, events = scratch(spark, "events"), event_stream(spark, d)
    run(upsert.once(events.unionByName(event_stream(spark, d)), "event_id", "ts"), root)
    return upsert.read(spark, f"{root}/table", "event_id").select("event_id", "user_id", "event_type", "value")


NEWEST = """WITH k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS i, count(*) OVER (PARTITION BY event_type) AS came FROM events WHERE value IS NOT NULL)
SELECT event_type, max(came) AS came, count(*) AS samples, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.7) AS p70, quantile_disc(value, 0.95) AS p95, max(value) AS p100, round(avg(value), 6) AS mean FROM k WHERE i <= 500 GROUP BY event_type"""


@query(NEWEST)
def recorded_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Summary of the 500 newest values of each type of event."""
    return recorder.summaries(table(spark, d, "events"), "event_type", "value", "ts", "event_id", 500).withColumn("mean", F.round("mean", 6))


@query(NEWEST)
def streamed_summaries(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream with a ring of samples a type in its state."""
    root = scratch(spark, "summaries")
    run(recorder.stream_summaries(event_stream(spark, d), "event_type", "value", "ts", "event_id", 500), root, "update")
    return upsert.read(spark, f"{root}/table", "event_type").withColumn("mean", F.round("mean", 6))
