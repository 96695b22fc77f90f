"""Retrieval ablation: every configuration judged on the same queries, from one search of each part of an index.

A part holds the chunks of one strategy and language. The best of several parts are among the best of each, so each part
is searched once and configurations only choose among hits: their number costs no search.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristra.checkpoints import cut_lineage, forget
from veristra.config import SETTINGS
from veristra.functions import encoders
from veristra.functions import language as L
from veristra.functions import text as X
from veristra.operators import evaluate, parts, reports, retrieve


@dataclass(frozen=True)
class Configuration:
    """What a configuration searches. None: what the query's plan says; routed: strategies and weights are the plan's too."""

    name: str
    strategies: tuple[str, ...] | None = None
    languages: tuple[str, ...] | None = None
    sparse: bool = False
    routed: bool = False


# The configurations that a report covers, and the weights of both branches where no plan says them.
CONFIGURATIONS = (
    Configuration("atomic_dense_english", ("atomic",), ("en",)),
    Configuration("atomic_dense_hindi", ("atomic",), ("hi",)),
    Configuration("bilingual_paired_dense", ("bilingual_paired",), (L.MIXED,)),
    Configuration("sentence_window_dense", ("sentence_window",)),
    Configuration("atomic_sentence_parent_dense", ("atomic", "sentence_window", "parent_child")),
    Configuration("dense_sparse_fusion", ("atomic", "sentence_window", "parent_child"), sparse=True),
    Configuration("all_routed", sparse=True, routed=True),
)
DENSE, SPARSE = 0.65, 0.35

#: Parts that are searched one by one.
PARTS_MOST = 64


def contract(configurations: tuple[Configuration, ...] = CONFIGURATIONS) -> str:
    """SHA-256 of what the configurations say: reports are comparable only under one contract."""
    return hashlib.sha256(reports.canonical({c.name: asdict(c) for c in configurations}).encode()).hexdigest()


def plans(queries: DataFrame, configurations: tuple[Configuration, ...] = CONFIGURATIONS) -> DataFrame:
    """(config, query_id, strategies, languages, <branch>_weight, <branch>_limit): a row a configuration and query.

    queries: query_id, plan, as ``retrieve.route`` gives it.
    """
    plan = F.col("plan")
    words = lambda ws: F.array(*[F.lit(w) for w in ws])

    def one(c: Configuration):
        return F.struct(
            F.lit(c.name).alias("config"),
            (plan["strategies"] if c.routed or c.strategies is None else words(c.strategies)).alias("strategies"),
            (plan["languages"] if c.languages is None else words(c.languages)).alias("languages"),
            (plan["dense_weight"] if c.routed else F.lit(DENSE if c.sparse else 1.0)).cast("double").alias("dense_weight"),
            (plan["sparse_weight"] if c.routed else F.lit(SPARSE if c.sparse else 0.0)).cast("double").alias("sparse_weight"),
            plan["dense_limit"].alias("dense_limit"),
            plan["sparse_limit"].alias("sparse_limit"),
        )

    return queries.select("query_id", F.explode(F.array(*[one(c) for c in configurations])).alias("c")).select("c.config", "query_id", "c.strategies", "c.languages", "c.dense_weight", "c.sparse_weight", "c.dense_limit", "c.sparse_limit")


def search_parts(queries: DataFrame, chunks: DataFrame, encoder: encoders.Encoder, depth: int = 2 * max(SETTINGS.dense_limit, SETTINGS.sparse_limit), planned: DataFrame | None = None) -> DataFrame:
    """(query_id, source, strategy, language, chunk_id, parent_id, score): the ``depth`` best of every part, densely and sparsely.

    queries: query_id, query. chunks: chunk_id (a key), parent_id, strategy, language, text; ids of queries and chunks are
    whole numbers. N-grams are as rare as in all chunks, whatever the part, so scores of parts compare. Rows without id,
    strategy or language are left out, null texts find nothing and are not found; no chunks give no rows. planned: of
    ``plans``; with it only what some plan may take is looked for: parts by the branches that ask them, as deep as limits go.
    """
    spark = chunks.sparkSession
    asked = queries.where("query_id IS NOT NULL").select("query_id", "query")
    known = chunks.where("chunk_id IS NOT NULL AND strategy IS NOT NULL AND language IS NOT NULL").select("chunk_id", "parent_id", "strategy", "language", "text")
    names = known.select("strategy", "language").distinct().limit(PARTS_MOST + 1).collect()
    if len(names) > PARTS_MOST:
        raise ValueError(f"an index of more than {PARTS_MOST} strategies and languages")
    if not names:
        return cut_lineage(spark.createDataFrame([], "query_id long, source string, strategy string, language string, chunk_id long, parent_id string, score double"))
    table = spark.createDataFrame([(at, *name) for at, name in enumerate(names)], "part int, strategy string, language string")
    wanted = {"dense": list(range(len(names))), "sparse": list(range(len(names)))}
    if planned is not None:
        kinds = planned.groupBy("strategies", "languages").agg(*[F.max(F.when(F.col(f"{s}_weight") > 0, F.col(f"{s}_limit"))).alias(s) for s in wanted])
        limits = table.join(kinds, retrieve.allowed(F.col("strategy"), F.col("language"), F.struct("strategies", "languages"))).groupBy("part").agg(*[F.max(s).alias(s) for s in wanted]).collect()
        wanted = {s: [r.part for r in limits if r[s]] for s in wanted}
        depth = max([r[s] for r in limits for s in wanted if r[s]], default=depth)
    tokens = lambda c: F.concat_ws(" ", X.word_tokens(F.col(c)))
    vectors = lambda df, text, role: encoders.encode(df.withColumn("text", tokens(text)), encoder, role=role)
    form = lambda df, key, text: df.select(F.col(key), X.plain_matching(F.col(text)).alias("form"))
    numbered = parts.together(known.join(F.broadcast(table), ["strategy", "language"]).select("chunk_id", "part", "text"))
    frequency = cut_lineage(parts.frequencies(parts.forms(numbered)))
    total = known.count()
    asked_vectors = cut_lineage(vectors(asked, "query", "query").select(F.col("query_id").cast("long").alias("query_id"), "embedding"))
    dense = parts.dense_parts(asked_vectors, vectors(numbered.where(F.col("part").isin(wanted["dense"])), "text", "passage"), depth)
    asked_forms = form(asked, "query_id", "query")
    weights = cut_lineage(retrieve.gram_weights(retrieve.gram_features(asked_forms, "query_id"), frequency, total, "query_id"))
    if retrieve.few(frequency):
        sparse = [parts.gram_parts(weights, parts.forms(numbered.where(F.col("part").isin(wanted["sparse"]))), depth, frequency, total)]
    else:
        one = lambda p: retrieve.gram_search(asked_forms, form(numbered.where(F.col("part") == p), "chunk_id", "text"), depth, "chunk_id", state=(frequency, total))
        sparse = [one(p).select("query_id", F.lit(p).alias("part"), "chunk_id", "score") for p in wanted["sparse"]]
    found = [dense.withColumn("source", F.lit("dense")), *[hits.withColumn("source", F.lit("sparse")) for hits in sparse]]
    parents = known.select("chunk_id", F.col("parent_id").cast("string").alias("parent_id"))
    hits = reduce(DataFrame.unionByName, found).join(F.broadcast(table), "part").join(parents, "chunk_id")
    hits = cut_lineage(hits.select("query_id", "source", "strategy", "language", "chunk_id", "parent_id", "score"))
    forget(frequency, asked_vectors, weights)
    return hits


def rankings(planned: DataFrame, hits: DataFrame) -> DataFrame:
    """(config, query_id, source, rank, weight, chunk_id, parent_id): each configuration's branches, from the hits of its parts.

    planned: of ``plans``. hits: of ``search_parts``, at least as deep as the plans' limits. Ties go to the smaller chunk_id.
    """
    dense = F.col("source") == "dense"
    weight = F.when(dense, F.col("dense_weight")).otherwise(F.col("sparse_weight"))
    limit = F.when(dense, F.col("dense_limit")).otherwise(F.col("sparse_limit"))
    plan = F.struct("strategies", "languages")
    usable = hits.join(planned, "query_id").where(retrieve.allowed(F.col("strategy"), F.col("language"), plan)).select("config", "query_id", "source", weight.alias("weight"), limit.alias("limit"), "chunk_id", "parent_id", "score").where("weight > 0")
    place = W.partitionBy("config", "query_id", "source").orderBy(F.when(F.col("source") == "dense", F.round("score", 12)).otherwise(F.round("score", 9)).desc(), F.col("chunk_id"))
    return usable.withColumn("rank", F.row_number().over(place)).where("rank <= limit").drop("limit", "score")


def ablate(planned: DataFrame, hits: DataFrame, relevant: DataFrame, limit: int = SETTINGS.final_limit) -> DataFrame:
    """(config, query_id, hits, agreement, <metrics>): every query under every configuration.

    relevant: query_id, parent_id. Metrics look at the ten first parents, so ``limit`` is at least 10. A query that finds
    nothing has 0 hits and metrics of 0; agreement is null where only one branch was asked.
    """
    if limit < 10:
        raise ValueError("metrics at ten need ten parents a query")
    both = cut_lineage(rankings(planned, hits).withColumn("query_id", F.struct("config", "query_id")).drop("config"))
    parents = both.select("query_id", "chunk_id", "parent_id").distinct()
    fused = retrieve.fuse(both).join(parents, ["query_id", "chunk_id"])
    first = retrieve.one_per_parent(fused, limit, F.round("score", 12).desc(), F.col("parent_id"), F.col("chunk_id"))
    near = retrieve.agreement(both.where("source = 'dense'"), both.where("source = 'sparse'")).select("query_id.*", "agreement")
    ranked = cut_lineage(first.select("query_id.*", "rank", F.col("parent_id").alias("doc_id")))
    count = ranked.groupBy("config", "query_id").agg(F.count("*").alias("hits"))
    queries = planned.select("config", "query_id", (F.col("dense_weight") > 0).alias("d"), (F.col("sparse_weight") > 0).alias("s"))
    found = evaluate.per_query(ranked, relevant.select("query_id", F.col("parent_id").cast("string").alias("doc_id")), queries.select("config", "query_id"), by=("config",))
    key = ["config", "query_id"]
    out = queries.join(count, key, "left").join(near, key, "left").join(found, key)
    return out.select(*key, F.coalesce("hits", F.lit(0)).alias("hits"), F.when(F.col("d") & F.col("s"), F.coalesce("agreement", F.lit(0.0))).alias("agreement"), *evaluate.METRICS)


def report(judged: DataFrame, chunks: DataFrame, configurations: tuple[Configuration, ...] = CONFIGURATIONS, least: int = 500) -> DataFrame:
    """One row a configuration: queries, answered, coverage, agreement, average metrics, chunks and bytes, qualified, contract.

    judged: of ``ablate``. chunks and bytes: what the configuration can reach, all of it where the plan decides. qualified:
    at least ``least`` queries, each with hits. A configuration without queries has none of them and metrics of 0.
    """
    parts = chunks.groupBy("strategy", "language").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    spark = chunks.sparkSession
    names = spark.createDataFrame([(c.name, list(c.strategies or ()), list(c.languages or ())) for c in configurations], "config string, ss array<string>, ls array<string>")
    fits = ((F.size("ss") == 0) | F.array_contains("ss", F.col("strategy"))) & ((F.size("ls") == 0) | F.array_contains("ls", F.col("language")))
    size = parts.join(F.broadcast(names), fits).groupBy("config").agg(F.sum("n").alias("chunks"), F.sum("b").alias("bytes"))
    means = judged.groupBy("config").agg(F.count("*").alias("queries"), F.count_if(F.col("hits") > 0).alias("answered"), F.avg("agreement").alias("agreement"), *[F.avg(m).alias(m) for m in evaluate.METRICS])
    both = names.select("config").join(means, "config", "left").join(size, "config", "left")
    zero = {c: 0 for c in ("queries", "answered", "chunks", "bytes")} | dict.fromkeys(evaluate.METRICS, 0.0)
    filled = both.fillna(zero).withColumn("coverage", F.coalesce(F.try_divide("answered", "queries"), F.lit(0.0)))
    return filled.select("config", "queries", "answered", "coverage", "agreement", *evaluate.METRICS, "chunks", "bytes", ((F.col("queries") >= least) & (F.col("answered") == F.col("queries"))).alias("qualified"), F.lit(contract(configurations)).alias("contract"))


def paired(left: DataFrame, right: DataFrame) -> DataFrame:
    """(config, fault, <metrics>): how much better ``right`` did than ``left``, two reports of two encoders.

    fault: missing, contract, queries or incomplete, the first that keeps a configuration's rows from being compared; its
    differences are null then.
    """
    names = ["config", "queries", "answered", "contract", *evaluate.METRICS]
    a, b = left.select(*names).withColumn("l", F.lit(True)), right.select("config", *[F.col(n).alias(f"r_{n}") for n in names[1:]]).withColumn("r", F.lit(True))
    fault = (
        F.when(F.col("l").isNull() | F.col("r").isNull(), "missing")
        .when(F.col("contract") != F.col("r_contract"), "contract")
        .when(F.col("queries") != F.col("r_queries"), "queries")
        .when((F.col("answered") < F.col("queries")) | (F.col("r_answered") < F.col("r_queries")), "incomplete")
    )
    return a.join(b, "config", "full").select("config", fault.alias("fault"), *[F.when(fault.isNull(), F.col(f"r_{m}") - F.col(m)).alias(m) for m in evaluate.METRICS])
