"""Jobs that write: the chunk index and the frequency state, each in a folder of its own for a run."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veristra.functions import encoders
from veristra.functions import text as X
from veristra.operators import chunking, frequency, indexing, retrieve
from veristra.plans.queries import GRAMS, HASHED, _sources
from veristra.plans.registry import ORACLE_SQL, query
from veristra.session import table
from veristra.sources import batches

ATOMIC = {"strategies": ["atomic"]}
BUCKETS = 48


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster's shared files lie; without one, as in tests, a local one for local sessions."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="veristra-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


CHUNKS = "chunks AS (SELECT doc_id, lang AS language, text, sha256(doc_id || chr(31) || 'atomic' || chr(31) || lang || chr(31) || '0' || chr(31) || length(text) || chr(31) || text) AS chunk_id, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 6))::BIGINT % 48 AS bucket FROM documents WHERE length(text) > 0)"
SUM = "sum(('0x' || substr(chunk_id, 1, 12))::BIGINT)::BIGINT"


@query("WITH " + CHUNKS + f" SELECT 'atomic' AS strategy, language, count(*) AS chunks, sum(strlen(text))::BIGINT AS bytes, {SUM} AS checksum FROM chunks GROUP BY language")
def index_build(spark: SparkSession, d: str) -> DataFrame:
    """What readers of a freshly built index find, by strategy and language."""
    root = scratch(spark, "index")
    indexing.build(_sources(spark, d), root, chunking.atomic, ATOMIC, BUCKETS)
    found = indexing.open_index(spark, root)
    return found.groupBy("strategy", "language").agg(F.count("*").alias("chunks"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), indexing.checksum(F.col("chunk_id")).alias("checksum"))


@query("WITH " + CHUNKS + f""", parts AS (SELECT bucket, count(*) AS chunks, count(DISTINCT chunk_id) AS ids, sum(strlen(text))::BIGINT AS bytes, {SUM} AS checksum FROM chunks GROUP BY bucket)
SELECT b.bucket::INT AS bucket, documents, coalesce(chunks, 0) AS chunks, coalesce(ids, 0) AS ids, coalesce(bytes, 0) AS bytes, coalesce(checksum, 0) AS checksum
FROM (SELECT ('0x' || substr(sha256(doc_id::VARCHAR), 1, 6))::BIGINT % 48 AS bucket, count(*) AS documents FROM documents GROUP BY 1) b LEFT JOIN parts USING (bucket)""")
def index_parts(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a build, a row a part, as it was published."""
    root = scratch(spark, "index")
    indexing.build(_sources(spark, d), root, chunking.atomic, ATOMIC, BUCKETS)
    parts = indexing.current(spark, root)["parts"]
    return spark.createDataFrame([(p["bucket"], p["documents"], p["chunks"], p["ids"], p["bytes"], p["checksum"]) for p in parts], "bucket int, documents long, chunks long, ids long, bytes long, checksum long")


_RUNS = """WITH keyed AS (SELECT *, ('0x' || substr(sha256(doc_id::VARCHAR), 1, 6))::BIGINT % 48 AS bucket FROM documents),
changed AS (SELECT doc_id, lang, bucket, CASE WHEN doc_id % 211 = 0 THEN upper(replace(text, 'ß', 'ss')) || '!' ELSE text END AS text FROM keyed WHERE doc_id % 307 <> 1),
touched AS (SELECT count(DISTINCT bucket) AS n FROM keyed WHERE doc_id % 211 = 0 OR doc_id % 307 = 1),
sums AS (SELECT 0 AS side, (sum(('0x' || substr(sha256(doc_id || chr(31) || 'atomic' || chr(31) || lang || chr(31) || '0' || chr(31) || length(text) || chr(31) || text), 1, 12))::BIGINT) % 9223372036854775808)::BIGINT AS checksum, count(*) AS chunks FROM keyed WHERE length(text) > 0
  UNION ALL SELECT 1, (sum(('0x' || substr(sha256(doc_id || chr(31) || 'atomic' || chr(31) || lang || chr(31) || '0' || chr(31) || length(text) || chr(31) || text), 1, 12))::BIGINT) % 9223372036854775808)::BIGINT, count(*) FROM changed WHERE length(text) > 0)
SELECT 1 AS run, count(DISTINCT bucket) AS written, 0::BIGINT AS kept, count(*) AS documents, (SELECT chunks FROM sums WHERE side = 0) AS chunks, (SELECT checksum FROM sums WHERE side = 0) AS checksum FROM keyed
UNION ALL SELECT 2, 0, count(DISTINCT bucket), count(*), (SELECT chunks FROM sums WHERE side = 0), (SELECT checksum FROM sums WHERE side = 0) FROM keyed
UNION ALL SELECT 3, (SELECT n FROM touched), count(DISTINCT bucket) - (SELECT n FROM touched), (SELECT count(*) FROM changed), (SELECT chunks FROM sums WHERE side = 1), (SELECT checksum FROM sums WHERE side = 1) FROM keyed
UNION ALL SELECT 4, 0, count(DISTINCT bucket), count(*), (SELECT chunks FROM sums WHERE side = 0), (SELECT checksum FROM sums WHERE side = 0) FROM keyed"""


@query(_RUNS)
def index_rebuilds(spark: SparkSession, d: str) -> DataFrame:
    """Four runs over one folder: new, unchanged, some documents changed and some gone, and back to the first state."""
    root, docs = scratch(spark, "index"), _sources(spark, d)
    number = F.col("parent_id").cast("long")
    edited = docs.where(number % 307 != 1).withColumn("source", F.when(number % 211 == 0, F.concat(F.upper("source"), F.lit("!"))).otherwise(F.col("source")))
    runs = [indexing.build(x, root, chunking.atomic, ATOMIC, BUCKETS, wave=BUCKETS) for x in (docs, docs, edited, docs)]
    return spark.createDataFrame([(i, r.written, r.kept, r.documents, r.chunks, r.checksum) for i, r in enumerate(runs, 1)], "run int, written long, kept long, documents long, chunks long, checksum long")


@query("WITH " + GRAMS.replace("FROM conversations)", "FROM conversations WHERE conv_id % 5 <> 0)") + " SELECT feature, df, (SELECT count(*) FROM conversations WHERE conv_id % 5 <> 0) AS documents FROM df")
def frequency_state(spark: SparkSession, d: str) -> DataFrame:
    """Frequencies of n-grams folded in two halves, saved, loaded, and with every fifth conversation taken out again."""
    turns = table(spark, d, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), X.plain_matching(F.col("text")).alias("form"))
    counted = lambda rows: frequency.of_texts(rows.select("id", "form"))
    root = scratch(spark, "state")
    frequency.save(counted(turns.where("conv_id % 2 = 0")), root)
    frequency.save(frequency.fold(frequency.load(spark, root), counted(turns.where("conv_id % 2 = 1"))), root)
    left = frequency.fold(frequency.load(spark, root), counted(turns.where("conv_id % 5 = 0")), -1)
    return left.frequency.select("feature", "df", F.lit(left.documents).cast("long").alias("documents"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns: chunk_id, parent_id (the conversation), text."""
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), F.col("conv_id").alias("parent_id"), "text")


@query("WITH " + HASHED + "SELECT query_id, rank::INT AS rank, id AS turn_id, round(score, 9) AS score FROM hranked WHERE rank <= 5")
def index_search(spark: SparkSession, d: str) -> DataFrame:
    """Turns indexed with their vectors, published, and searched under the build's encoder for all benchmark passages."""
    root, encoder = scratch(spark, "vectors"), encoders.hashed()
    tokens = lambda c: F.concat_ws(" ", X.word_tokens(F.col(c)))
    turns = _turns(spark, d).select(F.col("chunk_id").cast("string").alias("parent_id"), tokens("text").alias("text"))
    # keys as texts sort as their numbers
    indexing.build(turns, root, lambda docs: docs.withColumn("chunk_id", F.lpad("parent_id", 19, "0")), {"unit": "turn"}, BUCKETS, wave=BUCKETS, encoder=encoder)
    found = indexing.search(spark, root, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), tokens("text").alias("query")), encoder, 5)
    return found.select("query_id", "rank", F.col("parent_id").cast("long").alias("turn_id"), F.round("score", 9).alias("score"))


@query(ORACLE_SQL["hybrid_topk"])
def encoder_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The whole hybrid search as one call that takes its encoder."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = retrieve.hybrid_search(items, _turns(spark, d), encoders.hashed())
    return found.select("query_id", "rank", "parent_id", "chunk_id", F.round("score", 9).alias("score"), F.round("agreement", 9).alias("agreement"))


@query("""WITH n AS (SELECT count(*) AS rows FROM documents), s AS (SELECT rows, greatest(1, rows // 5) AS size FROM n)
SELECT coalesce(lang, '?') AS lang, count(*) AS rows, count(DISTINCT doc_id) AS documents, sum(doc_id)::BIGINT AS ids, sum(length(text))::BIGINT AS characters,
  (SELECT (rows + size - 1) // size FROM s)::BIGINT AS batches, 2::BIGINT AS first_run FROM documents GROUP BY 1""")
def resumed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents copied in batches by a run that breaks in its third batch, after writing it, and one that goes on."""
    path, root = f"{d}/documents.parquet", scratch(spark, "batches")
    size = max(1, batches.files_of(spark, path).rows // 5)

    def broken(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/batches/number={number}")
        if number == 2:
            raise InterruptedError

    first = 0
    try:
        for _ in batches.each(spark, path, root, size, broken):
            first += 1
    except InterruptedError:
        pass
    batches.copy(spark, path, root, size)
    found = batches.copied(spark, root)
    whole = F.lit(batches.done(spark, root)["batches"]).cast("long")
    return found.groupBy(F.coalesce("lang", F.lit("?")).alias("lang")).agg(
        F.count("*").alias("rows"), F.count_distinct("doc_id").alias("documents"), F.sum("doc_id").cast("long").alias("ids"), F.sum(F.length("text")).cast("long").alias("characters"), F.first(whole).alias("batches"), F.first(F.lit(first).cast("long")).alias("first_run"),
    )
