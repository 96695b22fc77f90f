"""Guardrails as nullable reason columns; the first that isn't null decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristra.checkpoints import cut_lineage
from veristra.config import SETTINGS
from veristra.functions import text as X

# Patterns of the gates, negations and words without content.
INJECTION = (
    "ignore (?:all |the )?(?:(?:previous|prior) )?(?:system )?instructions",
    "reveal (?:the )?(?:system prompt|hidden instructions|developer message)",
    "act as (?:the )?system",
    "override (?:your |the )?(?:rules|guardrails|instructions)",
    "पिछले निर्देश(?:ों)? को (?:भूल|नज़रअंदाज़)",
)
UNSAFE = (
    "\\b(?:build|make|assemble) (?:a )?(?:bomb|explosive device)\\b",
    "\\b(?:poison|kill) (?:someone|a person) without (?:being caught|detection)\\b",
    "\\bsteal (?:a )?(?:password|credit card|identity)\\b",
    "(?:बम|विस्फोटक) (?:कैसे )?(?:बनाएँ|बनाना)",
)
FRESH = (
    "\\b(?:today|currently|current|latest|right now|live price|present president|present prime minister)\\b",
    "\\b(?:आज|अभी|वर्तमान|नवीनतम|ताज़ा|लाइव कीमत|मौजूदा)\\b",
)
NEGATIONS = "no not never neither without न नहीं नही मत".split()
EMPTY_WORDS = "a an and as at be became did for in is it of on the to was were है था थी में का की के और".split()


def _matches(text: Column, patterns: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.coalesce(text, F.lit("")).rlike(f"(?iu){p}")
    return found


def injection(text: Column) -> Column:
    return F.when(_matches(text, INJECTION), "prompt_injection")


def unsafe(text: Column) -> Column:
    return F.when(_matches(text, UNSAFE), "unsafe_request")


def stale(text: Column) -> Column:
    return F.when(_matches(text, FRESH), "stale_corpus")


def low_confidence(confidence: Column) -> Column:
    return F.when(confidence < SETTINGS.minimum_confidence, "low_confidence")


def audio(size: Column, stats: Column) -> Column:
    """Reason to ask again, from a byte count and ``pcm_stats``."""
    return F.when(F.coalesce(size, F.lit(0)) == 0, "silence").when(size % 2 != 0, "invalid_audio").when(stats["duration_ms"] < 250, "audio_too_short").when(stats["rms"] < 80, "silence")


def evidence_scores(hits: DataFrame) -> DataFrame:
    """(query_id, top, second, margin, n): of the dense scores if any hit has one, else of the fused."""
    scored = hits.groupBy("query_id").agg(F.array_sort(F.transform(F.array_compact(F.collect_list("dense_score")), lambda x: -x)).alias("d"), F.array_sort(F.transform(F.collect_list("score"), lambda x: -x)).alias("s"))
    used = F.when(F.size("d") > 0, F.col("d")).otherwise(F.col("s"))
    top, second = -F.try_element_at(used, F.lit(1)), F.coalesce(-F.try_element_at(used, F.lit(2)), F.lit(0.0))
    return scored.select("query_id", top.alias("top"), second.alias("second"), (top - second).alias("margin"), F.size(used).alias("n"))


def answerability(top: Column, margin: Column, n: Column, score: float = SETTINGS.minimum_score, least: float = SETTINGS.minimum_margin) -> Column:
    """The serving rule: the margin is waived for a high score and for a single one."""
    weak = (top < score) | ((top < SETTINGS.margin_waiver) & (n > 1) & (margin < least))
    return F.when(n.isNull() | (n == 0) | weak, "no_relevant_evidence")


def calibration_accepts(top: Column, margin: Column, near: Column, score: Column, least: Column, floor: Column) -> Column:
    """The calibration rule, which waives nothing."""
    return (top >= score) & (margin >= least) & (near >= floor)


def disagreement(near: Column, floor: float = SETTINGS.minimum_agreement) -> Column:
    return F.when(near < floor, "retrieval_disagreement")


def claim_features(text: Column) -> Column:
    """struct<content, numbers, negated> of the matching form."""
    tokens = F.filter(F.split(X.plain_matching(text), " "), lambda t: t != "")
    content = F.array_distinct(F.filter(tokens, lambda t: ~t.isin(*EMPTY_WORDS, *NEGATIONS)))
    found = F.array_distinct(F.regexp_extract_all(X.plain_matching(text), F.lit("\\d+(?:[.,:/-]\\d+)*"), 0))
    return F.struct(content.alias("content"), found.alias("numbers"), F.exists(tokens, lambda t: t.isin(*NEGATIONS)).alias("negated"))


def conflicts(hits: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, left_id, right_id, conflict, overlap): the first conflicting pair among a query's top hits.

    At most ``most`` hits a query are paired. hits: query_id, rank, chunk_id, parent_id, text.
    """
    top = hits.where(F.col("rank") <= most).select("query_id", "rank", "chunk_id", "parent_id", claim_features(F.col("text")).alias("f"))
    top = cut_lineage(top)
    side = lambda n: top.select("query_id", *[F.col(c).alias(f"{n}_{c}") for c in ("rank", "chunk_id", "parent_id", "f")])
    pairs = side("l").join(side("r"), "query_id").where("l_rank < r_rank and l_parent_id <> r_parent_id")
    l, r = F.col("l_f"), F.col("r_f")
    shared = F.size(F.array_intersect(l["content"], r["content"]))
    overlap = shared / F.least(F.size(l["content"]), F.size(r["content"]))
    differ = (F.size(l["numbers"]) > 0) & (F.size(r["numbers"]) > 0) & ~F.arrays_overlap(l["numbers"], r["numbers"])
    kind = F.when(l["negated"] != r["negated"], "opposite_negation").when(differ, "incompatible_numbers")
    found = pairs.where((F.size(l["content"]) > 0) & (F.size(r["content"]) > 0) & (shared >= 2) & (overlap >= 0.6)).withColumn("conflict", kind).withColumn("overlap", overlap).where("conflict is not null")
    first = found.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy("l_rank", "r_rank"))).where("n = 1")
    return first.select("query_id", F.col("l_chunk_id").alias("left_id"), F.col("r_chunk_id").alias("right_id"), "conflict", "overlap")


def cascade(*gates: tuple[str, Column]) -> Column:
    """struct<gate, reason> of the first gate with a reason; null if all pass."""
    return F.coalesce(*[F.when(reason.isNotNull(), F.struct(F.lit(name).alias("gate"), reason.alias("reason"))) for name, reason in gates])


def outcome(reason: Column) -> Column:
    return F.when(reason.isNull(), "answered").when(reason == "unsafe_request", "unsafe").when(reason.isin("silence", "invalid_audio", "audio_too_short", "low_confidence"), "needs_repeat").otherwise("abstained")
