"""Mixing sources to target weights by systematic sampling.

Targets: each source's share of all words by weight, held at ``cap`` times its own words; what a held source
can't take is shared again by weight until none is above. Within a source every document has the same expected
number of copies, target over size. The running sum of these in the source's order (largest documents first),
moved by one random offset a source, gives a document one copy for each integer it crosses. As sizes fall along
the order, the taken words differ from the target by about the source's largest document at most.

Positions come from ``ranked``, so a hot source is spread over many tasks, and targets (a row a source) are broadcast
where sources are few; the offset comes from a hash of seed and source, so reruns agree. The loop that shares targets works on one row a source, in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage, ranked, small, word_count

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
SEED = 2026


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target), a row a source. sized: (source, size).

    Weights repeat over the sources by code point, null last.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    each = F.array(*[F.lit(float(w)) for w in weights])
    placed = ranked(sums, [], [F.col("source").asc_nulls_last()], "place")
    sources = cut_lineage(placed.withColumn("weight", F.element_at(each, (F.col("place") % len(weights) + 1).cast("int"))).drop("place"))
    ceiling = F.col("source_size") * F.lit(float(cap))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, None
    while level != before:
        # what a weight of 1 gets when all sources above their ceiling at the last level are held there
        held = F.col("weight") * F.lit(level) > ceiling
        left, share = sources.agg(F.lit(float(total)) - F.sum(F.when(held, ceiling).otherwise(0.0)), F.sum(F.when(held, 0.0).otherwise(F.col("weight")))).first()
        before, level = level, (left / share if share else level)
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(level), ceiling))


def plan_mixture(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, seed: int = SEED, text: str = "text", source: str = "source", key: str = "doc_id", keep: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row a document.

    size: words of the text; null and empty texts have none and are taken 0 times over in words. A null source is
    a source. Ties of size stand by key, then content hash; repeated rows are documents of their own. keep: pass
    the text on, for ``mix``.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if keep else []
    sized = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"), F.xxhash64(F.col(f"`{text}`")).alias("tie"), *row)
    narrow = cut_lineage(sized)
    targets = source_targets(narrow, weights, cap)
    placed = ranked(narrow, ["source"], [F.col("size").desc(), F.col("doc_id"), F.col("tie")], "place")
    goals = small(targets.select(F.col("source").alias("goal"), "source_size", "target"))
    joined = placed.join(goals, placed["source"].eqNullSafe(goals["goal"])).drop("goal")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # 53 bits of a hash, as a fraction
    offset = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("source")), 11) / F.lit(float(1 << 53))
    # rate times place, and not a running sum, so that no rounding gathers
    copies = F.floor((F.col("place") + 1) * rate + offset) - F.floor(F.col("place") * rate + offset)
    return joined.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).drop("place", "tie")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture: whole rows of ``docs``, each as often as it was drawn. Rows without words are drawn like others of their source."""
    drawn = plan_mixture(docs, keep=True, **options).where(F.col("copies") > 0)
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
