"""Evidence windows, extractive answers with citations, and their verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristra.config import SETTINGS
from veristra.functions import text as X
from veristra.operators import chunking


def terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(X.plain_matching(text), " "), lambda t: t != ""))


def evidence(queries: DataFrame, hits: DataFrame, limit: int = SETTINGS.evidence_limit) -> DataFrame:
    """The best window of each retrieved parent, then the first ``limit`` of a query.

    queries: query_id, query, preferred (language or null). hits: query_id, chunk_id, parent_id, language, text,
    parent_text (or null), span_start, score. Only retrieved texts are split. Spans are those of the parent text, or
    move by the chunk's start where only its own text is known.
    """
    source = hits.withColumn("source", F.coalesce("parent_text", "text"))
    cut = chunking.late_windows(source).join(queries.select("query_id", "query", "preferred"), "query_id")
    asked, found = terms(F.col("query")), terms(F.col("window_text"))
    lexical = F.size(F.array_intersect(asked, found)) / F.greatest(F.lit(1), F.size(asked))
    number = F.when(F.col("query").rlike("\\p{Nd}") & F.col("window_text").rlike("\\p{Nd}"), 0.1).otherwise(0.0)
    language = F.when(F.col("preferred") == F.col("language"), 0.05).when((F.col("preferred") == "hi-en") & F.col("language").isin("hi-en", "hi", "en"), 0.025).otherwise(0.0)
    move = F.when(F.col("parent_text").isNull(), F.col("span_start")).otherwise(0)
    scored = cut.select(
        "query_id", "parent_id", "language", "source", F.col("chunk_id").alias("from_chunk"), X.sha_id(F.col("chunk_id"), F.lit("late"), F.col("start").cast("string"), F.col("end").cast("string")).alias("chunk_id"),
        F.col("window_text").alias("text"), (F.col("start") + move).alias("span_start"), (F.col("end") + move).alias("span_end"), (0.65 * F.col("score") + 0.35 * lexical + number + language).alias("score"),
    )
    order = [F.round("score", 12).desc(), F.col("parent_id"), F.col("span_start")]
    first = scored.withColumn("n", F.row_number().over(W.partitionBy("query_id", "parent_id").orderBy(*order))).where("n = 1")
    return first.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).drop("n")


def first_sentence(chosen: DataFrame) -> DataFrame:
    """``chosen`` with sentence, sentence_start, sentence_end and source_hash: the first sentence of each window, in source places."""
    s = F.try_element_at(X.sentence_spans(F.col("text")), F.lit(1))
    found = chosen.withColumn("__s", s).where("__s is not null")
    inside = F.col("source").substr(F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) == F.col("text")
    move = F.when(inside, F.col("span_start")).otherwise(0)
    return found.select("*", F.col("__s.text").alias("sentence"), (F.col("__s.start") + move).alias("sentence_start"), (F.col("__s.end") + move).alias("sentence_end"), F.when(inside, "parent").otherwise("chunk").alias("coordinates"), F.sha2("source", 256).alias("source_hash")).drop("__s")


def extract(chosen: DataFrame, most: int = 2) -> DataFrame:
    """(query_id, answer, citations): first sentences of the two best windows, joined by a space."""
    order = [F.round("score", 12).desc(), F.col("parent_id"), F.col("span_start")]
    top = chosen.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("place") <= most)
    cited = first_sentence(top).select("query_id", F.struct("place", "chunk_id", "parent_id", "sentence", "sentence_start", "sentence_end", "coordinates", "source_hash").alias("c"))
    listed = cited.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("citations"))
    return listed.select("query_id", F.array_join(F.transform("citations", lambda c: c["sentence"]), " ").alias("answer"), "citations")


def verify(answers: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query_id, grounded): every citation resolves exactly in the evidence, and they spell the answer."""
    cited = answers.select("query_id", F.explode("citations").alias("c"))
    held = chosen.select("query_id", F.col("chunk_id").alias("id"), "source", "text", F.sha2("source", 256).alias("hash"))
    at = F.col("c.sentence_start")
    place = F.when(F.col("c.coordinates") == "parent", F.col("source")).otherwise(F.col("text"))
    exact = (place.substr(at + 1, F.col("c.sentence_end") - at) == F.col("c.sentence")) & (F.col("hash") == F.col("c.source_hash"))
    both = cited.join(held.withColumnRenamed("query_id", "q"), (F.col("query_id") == F.col("q")) & (F.col("c.chunk_id") == F.col("id")), "left")
    ok = both.groupBy("query_id").agg(F.bool_and(F.coalesce(exact, F.lit(False))).alias("exact"))
    spelled = F.array_join(F.transform("citations", lambda c: c["sentence"]), " ") == F.col("answer")
    return answers.join(ok, "query_id", "left").select("query_id", (spelled & F.coalesce("exact", F.lit(False)) & (F.size("citations") > 0)).alias("grounded"))


def fallback(chosen: DataFrame) -> DataFrame:
    """(query_id, answer, decision): the first sentence of the best window, for a run out of time."""
    return extract(chosen, 1).select("query_id", "answer", F.lit("warn").alias("decision"))


def validate_claims(claims: DataFrame, evidence_: DataFrame) -> DataFrame:
    """(claim_id, valid, reason): known evidence, exact quotes, 1 to 3 citations, numbers backed by the quotes.

    claims: query_id, claim_id, claim, citations array<struct<chunk_id, quote>>. evidence: query_id, chunk_id, text.
    """
    n = F.size("citations")
    each = claims.select("query_id", "claim_id", "claim", n.alias("n"), F.explode_outer("citations").alias("c"))
    known = evidence_.select(F.col("query_id").alias("q"), F.col("chunk_id").alias("id"), F.col("text").alias("source"))
    joined = each.join(known, (F.col("query_id") == F.col("q")) & (F.col("c.chunk_id") == F.col("id")), "left")
    summed = joined.groupBy("query_id", "claim_id", "claim", "n").agg(
        F.bool_and(F.col("id").isNotNull()).alias("known"), F.bool_and(F.coalesce(X.exact_quote(F.col("c.quote"), F.col("source")), F.lit(False))).alias("exact"), F.array_join(F.sort_array(F.collect_list("c.quote")), " ").alias("quotes"), F.count_distinct("c.chunk_id").alias("different"),
    )
    reason = F.when(~F.col("n").between(1, 3) | (F.col("different") != F.col("n")), "citations").when(~F.col("known"), "unknown_evidence").when(~F.col("exact"), "inexact_quote").when(~X.numbers_supported(F.col("claim"), F.col("quotes")), "unsupported_number")
    return summed.select("query_id", "claim_id", reason.isNull().alias("valid"), reason.alias("reason"))
