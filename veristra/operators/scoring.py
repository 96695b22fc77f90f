"""Development scores: what retrieval says of queries that are known to be answerable or not, as calibration reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristra.checkpoints import cut_lineage
from veristra.config import SETTINGS
from veristra.functions import encoders
from veristra.operators import gates, retrieve


def development_scores(queries: DataFrame, chunks: DataFrame, encoder: encoders.Encoder, depth: int = SETTINGS.dense_limit, limit: int = SETTINGS.final_limit) -> DataFrame:
    """(query_id, answerable, language, category, top, second, margin, agreement, dense_hits, sparse_hits, fused_hits, encoder).

    queries: query_id (a key), query, answerable. chunks: chunk_id, parent_id, text; as ``hybrid_search`` takes them. Every
    query with an id has a row: one that finds nothing has no top and margin, an agreement of 0 and no hits. ``encoder`` is
    the fingerprint of what the scores depend on. The result goes into ``evaluate.calibrate`` as it is.
    """
    routed = retrieve.route(queries.where("query_id IS NOT NULL").select("query_id", "query", "answerable"))
    asked = cut_lineage(routed.select("query_id", "query", "answerable", "plan.language", "plan.category", F.col("plan.dense_weight").alias("dense_weight"), F.col("plan.sparse_weight").alias("sparse_weight")))
    dense, sparse = retrieve.both_branches(asked, chunks, encoder, depth)
    hits, near = retrieve.hybrid(asked, dense, sparse, chunks.select("chunk_id", "parent_id"), limit)
    hits = cut_lineage(hits)
    count = lambda df, name: df.groupBy("query_id").agg(F.count("*").alias(name))
    found = asked
    for df in (gates.evidence_scores(hits).drop("n"), near, count(dense, "dense_hits"), count(sparse, "sparse_hits"), count(hits, "fused_hits")):
        found = found.join(df, "query_id", "left")
    filled = found.fillna(0, ["agreement", "dense_hits", "sparse_hits", "fused_hits"])
    return filled.select("query_id", "answerable", "language", "category", "top", "second", "margin", "agreement", "dense_hits", "sparse_hits", "fused_hits", F.lit(encoder.fingerprint()).alias("encoder"))
