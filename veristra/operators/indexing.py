"""Building a chunk index step by step: only what changed is written, a broken run goes on, readers see whole builds.

Documents fall into buckets by a hash of their key. A bucket's print is a hash of the configuration and of all its
documents, and its chunks lie in a folder of that name, so a part never changes once it is in the ledger. A build
writes the parts that the ledger lacks in waves, then its manifest (which parts make up the index), and last one
pointer to it. Builds with equal documents and configuration have equal ids and parts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veristra.checkpoints import ranked
from veristra.functions.encoders import Encoder, encode
from veristra.operators.retrieve import dense_search
from veristra.sources.publish import Folder

LEDGER = "bucket int, print string, documents long, chunks long, ids long, bytes long, checksum long"
VERSION = 1
#: Checksums are taken modulo this, so that those of any number of chunks fit a long.
CHECKSUMS = 1 << 63


@dataclass(frozen=True)
class Build:
    """What a run did: parts written and taken over, and what the index holds."""

    build_id: str
    written: int
    kept: int
    documents: int
    chunks: int
    checksum: int


def embedded(chunk: Callable[[DataFrame], DataFrame], encoder: Encoder) -> Callable[[DataFrame], DataFrame]:
    """A chunker whose rows carry their passages' vectors."""
    return lambda docs: encode(chunk(docs), encoder)


def bucket_of(key: Column, buckets: int) -> Column:
    """A bucket from the first 24 bits of the key's SHA-256; a null key counts as empty."""
    return (F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 6), 16, 10).cast("long") % buckets).cast("int")


def checksum(ids: Column) -> Column:
    """Sum of the ids' first 48 bits modulo ``CHECKSUMS``, which no order changes; ids are hexadecimal digests."""
    total = F.sum(F.conv(F.substring(ids, 1, 12), 16, 10).cast("decimal(15,0)"))
    return F.coalesce(total % F.lit(str(CHECKSUMS)).cast("decimal(19,0)"), F.lit(0)).cast("long")


def settings_print(settings: dict) -> str:
    text = json.dumps({"version": VERSION} | settings, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()


def prints(docs: DataFrame, settings: dict, buckets: int) -> DataFrame:
    """(bucket, print, documents): two 64-bit hashes of every row are summed, so order doesn't matter and repeated rows count."""
    row = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00null")) for c in sorted(docs.columns) if c != "bucket"]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))
    found = docs.groupBy("bucket").agg(F.count("*").alias("documents"), total(1).alias("a"), total(2).alias("b"))
    # a letter first: as a folder's name it must not be taken for a number
    return found.select("bucket", F.concat(F.lit("p"), F.substring(F.sha2(F.concat_ws(":", F.lit(settings_print(settings | {"buckets": buckets})), "documents", "a", "b"), 256), 1, 32)).alias("print"), "documents")


def ledger(spark: SparkSession, root: str) -> DataFrame:
    """Parts that are complete; a part that was written twice stands once."""
    known = Folder(spark, root).names("ledger")
    if not any(n.endswith(".parquet") for n in known):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger").dropDuplicates(["bucket", "print"])


def build(docs: DataFrame, root: str, chunk: Callable[[DataFrame], DataFrame], settings: dict, buckets: int = 64, wave: int = 16, files: int = 1, key: str = "parent_id", encoder: Encoder | None = None) -> Build:
    """Bring the index in ``root`` up to date with ``docs`` and publish it.

    chunk turns documents into rows with chunk_id, <key> and text; settings name all that its results depend on
    (strategies, sizes, the encoder's name and version). A chunk id that repeats stands once. ``wave`` buckets are
    written a job and noted in the ledger before the next job starts. ``files``: files of a part. An empty table raises.
    With an encoder, chunks get their vectors as ``embedding``, and the encoder's settings belong to the build: another
    version or prefix makes other parts.
    """
    if encoder is not None:
        if "encoder" in settings:
            raise ValueError("the encoder's settings come from the encoder")
        settings, chunk = settings | {"encoder": encoder.settings()}, embedded(chunk, encoder)
    spark, folder = docs.sparkSession, Folder(docs.sparkSession, root)
    docs = docs.withColumn("bucket", bucket_of(F.col(key), buckets))
    wanted = prints(docs, settings, buckets).collect()
    if not wanted:
        raise ValueError("there are no documents to index")
    have = {(r.bucket, r["print"]) for r in ledger(spark, root).select("bucket", "print").collect()}
    missing = sorted(((r.bucket, r["print"], r.documents) for r in wanted if (r.bucket, r["print"]) not in have))
    for low in range(0, len(missing), wave):
        _write(docs, spark.createDataFrame(missing[low : low + wave], "bucket int, print string, documents long"), root, chunk, buckets, files, key)
    listed = sorted((r.bucket, r["print"]) for r in wanted)
    build_id = hashlib.sha256(json.dumps([settings_print(settings), listed]).encode()).hexdigest()[:32]
    parts = ledger(spark, root).join(F.broadcast(spark.createDataFrame(listed, "bucket int, print string")), ["bucket", "print"]).orderBy("bucket").collect()
    manifest = {"version": VERSION, "build_id": build_id, "settings": settings, "buckets": buckets, "parts": [p.asDict() for p in parts]}
    if len(parts) != len(listed):
        raise RuntimeError("the ledger lacks parts that were just written")
    folder.replace_json(f"manifests/{build_id}.json", manifest)
    folder.replace("current", build_id)
    return Build(build_id, len(missing), len(listed) - len(missing), sum(p.documents for p in parts), sum(p.chunks for p in parts), sum(p.checksum for p in parts) % CHECKSUMS)


def _write(docs: DataFrame, parts: DataFrame, root: str, chunk: Callable[[DataFrame], DataFrame], buckets: int, files: int, key: str) -> None:
    """One wave: its buckets' documents are read and cut, its parts written anew, read back and noted in the ledger."""
    spark = docs.sparkSession
    chunks = chunk(docs.join(F.broadcast(parts.select("bucket")), "bucket", "left_semi").drop("bucket"))
    placed = chunks.withColumn("bucket", bucket_of(F.col(key), buckets)).withColumn("__file", F.pmod(F.xxhash64("chunk_id"), F.lit(files)))
    once = placed.repartition("bucket", "__file").dropDuplicates(["bucket", "__file", "chunk_id"]).drop("__file").join(F.broadcast(parts.select("bucket", "print")), "bucket")
    once.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "print").parquet(f"{root}/parts")
    paths = [f"{root}/parts/bucket={p.bucket}/print={p['print']}" for p in parts.collect()]
    there = [p for p in paths if Folder(spark, p).exists("")]
    note = measured(spark.read.option("basePath", f"{root}/parts").parquet(*there)) if there else spark.createDataFrame([], "bucket int, print string, chunks long, ids long, bytes long, checksum long")
    zero = {"chunks": 0, "ids": 0, "bytes": 0, "checksum": 0}
    row = parts.join(note, ["bucket", "print"], "left").fillna(zero)
    row.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in LEDGER.split(", ")]).coalesce(1).write.mode("append").parquet(f"{root}/ledger")


def measured(chunks: DataFrame) -> DataFrame:
    """(bucket, print, chunks, ids, bytes, checksum) of chunks as they lie in the index."""
    return chunks.groupBy(F.col("bucket").cast("int").alias("bucket"), F.col("print").cast("string").alias("print")).agg(F.count("*").alias("chunks"), F.count_distinct("chunk_id").alias("ids"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes"), checksum(F.col("chunk_id")).alias("checksum"))


def current(spark: SparkSession, root: str) -> dict:
    """The manifest of the published build."""
    folder = Folder(spark, root)
    build_id = folder.read("current")
    if build_id is None:
        raise FileNotFoundError(f"no build was published in {root}")
    found = folder.read_json(f"manifests/{build_id}.json")
    if found is None or found["version"] != VERSION:
        raise ValueError(f"build {build_id} has no manifest of version {VERSION}")
    return found


def open_index(spark: SparkSession, root: str, manifest: dict | None = None) -> DataFrame:
    """The chunks of the published build (or of a manifest's), whatever is being written meanwhile."""
    found = manifest or current(spark, root)
    paths = [f"{root}/parts/bucket={p['bucket']}/print={p['print']}" for p in found["parts"] if p["chunks"]]
    if not paths:
        raise ValueError("the build has no chunks")
    return spark.read.option("basePath", f"{root}/parts").parquet(*paths)


def search(spark: SparkSession, root: str, queries: DataFrame, encoder: Encoder, k: int, where: Column | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, parent_id, score): the k chunks of the published build nearest to each query.

    queries: query_id (a whole number), query. ``where`` narrows the chunks before the search. A build without vectors,
    or with those of another encoder, raises. Ties go to the smaller chunk_id.
    """
    manifest = current(spark, root)
    bound = manifest["settings"].get("encoder")
    if bound != encoder.settings():
        raise ValueError(f"the build's vectors are of {bound}, not of {encoder.settings()}")
    chunks = open_index(spark, root, manifest)
    chunks = chunks if where is None else chunks.where(where)
    base = ranked(chunks.select("chunk_id", "parent_id", "embedding"), [], [F.col("chunk_id")], "place")
    asked = encode(queries.select(F.col("query_id").alias("place"), "query"), encoder, text="query", role="query")
    found = dense_search(asked, base.select("place", "embedding"), k, key="place", same=True)
    # k rows a query meet the chunks' names
    return found.join(base.select("place", "chunk_id", "parent_id"), "place").select("query_id", "rank", "chunk_id", "parent_id", "score")


def damaged(spark: SparkSession, root: str) -> DataFrame:
    """(bucket, print) of parts that no longer hold what the manifest says; parts that are missing fail the read."""
    found = current(spark, root)
    said = spark.createDataFrame([(p["bucket"], p["print"], p["chunks"], p["ids"], p["bytes"], p["checksum"]) for p in found["parts"] if p["chunks"]], "bucket int, print string, chunks long, ids long, bytes long, checksum long")
    return said.exceptAll(measured(open_index(spark, root, found))).select("bucket", "print")


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete parts and manifests that the published build doesn't name, and their ledger lines; returns how many parts went."""
    folder, found = Folder(spark, root), current(spark, root)
    keep = {(p["bucket"], p["print"]) for p in found["parts"]}
    lines = [r for r in ledger(spark, root).collect() if (r.bucket, r["print"]) in keep]
    # first the ledger forgets, then files go: a part that the ledger names is always there
    spark.createDataFrame(lines, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{root}/ledger")
    gone = 0
    for bucket in folder.names("parts"):
        if bucket.startswith("bucket="):
            for part in folder.names(f"parts/{bucket}"):
                if (int(bucket.split("=")[1]), part.split("=")[-1]) not in keep:
                    folder.delete(f"parts/{bucket}/{part}")
                    gone += 1
    for name in folder.names("manifests"):
        if name.endswith(".json") and name != f"{found['build_id']}.json":
            folder.delete(f"manifests/{name}")
    return gone
