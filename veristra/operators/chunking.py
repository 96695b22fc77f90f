"""Chunk strategies: rows with exact spans of their source. Sentences come from an Arrow UDF, the rest are Columns."""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristra.config import SETTINGS
from veristra.functions import encoders
from veristra.functions import text as X

# Fixed value: what stands between the two texts of a pair.
SEPARATOR = "\n[EN] "

CHUNK = ["chunk_id", "parent_id", "language", "strategy", "text", "span_start", "span_end"]


def _finish(df: DataFrame, strategy: str | Column, text: Column | None = None) -> DataFrame:
    text = F.col("source").substr(F.col("span_start") + 1, F.col("span_end") - F.col("span_start")) if text is None else text
    named = df.withColumn("text", text).withColumn("strategy", F.lit(strategy))
    ident = X.sha_id("parent_id", "strategy", "language", F.col("span_start").cast("string"), F.col("span_end").cast("string"), F.col("text"))
    return named.withColumn("chunk_id", ident).select(*CHUNK)


def atomic(docs: DataFrame) -> DataFrame:
    """docs: parent_id, language, source. Empty sources make no chunk."""
    return _finish(docs.where("length(source) > 0").withColumn("span_start", F.lit(0)).withColumn("span_end", F.length("source")), "atomic")


def with_sentences(docs: DataFrame) -> DataFrame:
    return docs.where("length(source) > 0").withColumn("s", X.sentence_spans(F.col("source")))


def window_spans(s: Column, total: Column, size: int, overlap: int) -> Column:
    """Windows of sentences; one ends the series once it reaches the last sentence. A single sentence is the whole text."""
    step = size - overlap
    # the first window that holds the last sentence is the last window
    last = F.greatest(F.lit(0), F.ceil((F.size(s) - size) / step).cast("int"))
    spans = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.element_at(s, k * step + 1)["start"].alias("start"), F.element_at(s, F.least(k * step + size, F.size(s)))["end"].alias("end")))
    return F.when(F.size(s) <= 1, F.array(F.struct(F.lit(0).alias("start"), total.alias("end")))).otherwise(spans)


def _spans(df: DataFrame, spans: Column, strategy: str) -> DataFrame:
    found = df.withColumn("w", F.explode(spans))
    return _finish(found.withColumn("span_start", F.col("w.start")).withColumn("span_end", F.col("w.end")), strategy)


def sentence_windows(docs: DataFrame, size: int = SETTINGS.window_sentences, overlap: int = SETTINGS.window_overlap, strategy: str = "sentence_window") -> DataFrame:
    return _spans(with_sentences(docs), window_spans(F.col("s"), F.length("source"), size, overlap), strategy)


def parent_children(docs: DataFrame) -> DataFrame:
    """The same windows under ids of their own; their parents are returned with them."""
    return sentence_windows(docs, strategy="parent_child")


def sections(sentences: list[dict], vectors: list[list[float]] | None, quantile: float, most: int) -> list[tuple[int, int]]:
    """Spans of sections: a break where neighbours' similarity is in the lowest share, and where the words run over."""
    words = [len(s["text"].split()) for s in sentences]
    meaty = [s for s, n in zip(sentences, words, strict=True) if n >= 3]
    v = np.asarray(vectors, float)
    size, dots = np.sqrt((v * v).sum(1)), (v[:-1] * v[1:]).sum(1)
    size = size[:-1] * size[1:]
    sims = np.where(size > 0, dots / np.where(size > 0, size, 1.0), 0.0)
    limit = np.sort(sims)[int((len(sims) - 1) * quantile)]
    breaks = {meaty[i + 1]["start"] for i in np.flatnonzero(sims <= limit)}
    out, first, last, held = [], None, None, 0
    for s, n in zip(sentences, words, strict=True):
        if first is not None and (held + n > most or s["start"] in breaks):
            out.append((first, last))
            first, held = None, 0
        if n > most:
            at = [(m.start(), m.end()) for m in re.finditer(r"\S+", s["text"])]
            out += [(s["start"] + at[i][0], s["start"] + at[min(i + most, n) - 1][1]) for i in range(0, n, most)]
            continue
        first = s["start"] if first is None else first
        last, held = s["end"], held + n
    if first is not None:
        out.append((first, last))
    return out


#: Encoder of sections for when no model is at hand.
HASHED = encoders.hashed(unit=False, fold=True)
#: Sentences that are encoded together at least, but for the last of a batch.
TOGETHER = 1024


def section_spans(found: list[list[dict]], encoder: encoders.Encoder, least: int, quantile: float, most: int) -> list[list[tuple[int, int]]]:
    """``sections`` of many texts' sentences; none for a text of fewer than ``least`` sentences of three words."""
    out: list[list[tuple[int, int]]] = []
    waiting: list[tuple[list[dict], list[str]]] = []

    def flush() -> None:
        vectors = encoders.encode_list(encoder, [t for _, meaty in waiting for t in meaty])
        at = 0
        for sentences, meaty in waiting:
            mine, at = vectors[at : at + len(meaty)], at + len(meaty)
            out.append(sections(sentences, mine, quantile, most) if meaty else [])
        waiting.clear()

    held = 0
    for sentences in found:
        meaty = [s["text"] for s in sentences if len(s["text"].split()) >= 3]
        waiting.append((sentences, meaty if len(meaty) >= max(2, least) else []))
        held += len(waiting[-1][1])
        if held >= TOGETHER:
            flush()
            held = 0
    flush()
    return out


def windows_of(sentences: list[dict], total: int, size: int, overlap: int) -> list[tuple[int, int]]:
    """``window_spans`` of one text."""
    if len(sentences) <= 1:
        return [(0, total)]
    step = size - overlap
    last = max(0, math.ceil((len(sentences) - size) / step))
    return [(sentences[k * step]["start"], sentences[min(k * step + size, len(sentences)) - 1]["end"]) for k in range(last + 1)]


PIECES = "array<struct<kind:int,start:int,end:int,text:string>>"


def pieces(texts: list[str], spans: list[list[tuple[int, int, int]]]) -> pa.Array:
    """Lists of (kind, start, end) with their texts, cut here: Spark would read a source from its start for each of its spans."""
    ends = np.concatenate(([0], np.cumsum([len(x) for x in spans]))).astype(np.int32)
    kinds, starts, stops = (pa.array([s[i] for x in spans for s in x], pa.int32()) for i in range(3))
    cut = pa.array([t[s[1] : s[2]] for t, x in zip(texts, spans, strict=True) for s in x], pa.string())
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([kinds, starts, stops, cut], names=["kind", "start", "end", "text"]))


def _pieces(docs: DataFrame, spans: Column, strategies: Column) -> DataFrame:
    """(parent_id, language, span_start, span_end, text, strategies): the texts of ``PIECES`` with the strategies of their kind."""
    found = docs.where("length(source) > 0").select("parent_id", "language", F.explode(spans).alias("w"))
    return found.select("parent_id", "language", F.col("w.start").alias("span_start"), F.col("w.end").alias("span_end"), F.col("w.text").alias("text"), strategies.alias("strategies"))


def _each(found: DataFrame) -> DataFrame:
    """A chunk for every strategy of a piece."""
    return _finish(found.withColumn("strategy", F.explode("strategies")), F.col("strategy"), F.col("text"))


def sentences_of(texts: list[str]) -> list[list[dict]]:
    return [[{"text": t, "start": a, "end": b} for t, a, b in X.split_sentences(x)] for x in texts]


def semantic_sections(docs: DataFrame, encoder: encoders.Encoder = HASHED, least: int = SETTINGS.semantic_sentences, quantile: float = SETTINGS.semantic_quantile, most: int = SETTINGS.semantic_words) -> DataFrame:
    """Sections of texts with at least ``least`` sentences of three words. Sentences of many texts are encoded together."""

    @F.arrow_udf(PIECES)
    def spans(source: pa.Array) -> pa.Array:
        texts = source.to_pylist()
        return pieces(texts, [[(0, a, b) for a, b in x] for x in section_spans(sentences_of(texts), encoder, least, quantile, most)])

    return _each(_pieces(docs, spans(F.col("source")), F.array(F.lit("semantic_section"))))


def bilingual_pairs(docs: DataFrame, most: int = SETTINGS.pair_characters) -> DataFrame:
    """Pieces of both texts side by side; the shorter list repeats its last piece. docs: parent_id, source, translated, language."""
    half = (most - len(SEPARATOR)) // 2
    cut = X.fixed_spans(half)
    both = docs.where("length(source) > 0 and length(translated) > 0").withColumn("a", cut("source")).withColumn("b", cut("translated"))
    at = lambda name, i: F.element_at(F.col(name), F.least(i + 1, F.size(name)))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("a"), F.size("b")) - 1), lambda i: F.struct(i.alias("i"), at("a", i).alias("a"), at("b", i).alias("b")))
    rows = both.withColumn("p", F.explode(pairs)).withColumn("text", F.concat("p.b.text", F.lit(SEPARATOR), "p.a.text"))
    rows = rows.withColumn("strategy", F.lit("bilingual_paired")).withColumn("span_start", F.col("p.a.start")).withColumn("span_end", F.col("p.a.end"))
    ident = X.sha_id("parent_id", "strategy", "language", F.col("p.i").cast("string"), F.col("text"))
    return rows.withColumn("chunk_id", ident).select(*CHUNK, F.col("p.b.start").alias("other_start"), F.col("p.b.end").alias("other_end"))


def all_pieces(docs: DataFrame, encoder: encoders.Encoder = HASHED) -> DataFrame:
    """What every strategy makes of one-language documents, a text that two strategies share once: see ``_pieces``.

    A strategy is in one set of strategies alone. Sentences are found once for all.
    """
    c = SETTINGS

    @F.arrow_udf(PIECES)
    def spans(source: pa.Array) -> pa.Array:
        texts = source.to_pylist()
        found = sentences_of(texts)
        parts = section_spans(found, encoder, c.semantic_sentences, c.semantic_quantile, c.semantic_words)
        windows = [windows_of(x, len(t), c.window_sentences, c.window_overlap) for t, x in zip(texts, found, strict=True)]
        return pieces(texts, [[*((0, *s) for s in w), *((1, *s) for s in p)] for w, p in zip(windows, parts, strict=True)])

    kinds = F.when(F.col("w.kind") == 0, F.array(F.lit("sentence_window"), F.lit("parent_child"))).otherwise(F.array(F.lit("semantic_section")))
    whole = docs.where("length(source) > 0").select("parent_id", "language", F.lit(0).alias("span_start"), F.length("source").alias("span_end"), F.col("source").alias("text"), F.array(F.lit("atomic")).alias("strategies"))
    return whole.unionByName(_pieces(docs, spans(F.col("source")), kinds))


def all_chunks(docs: DataFrame, encoder: encoders.Encoder = HASHED) -> DataFrame:
    """Every strategy of one-language documents in one table."""
    return _each(all_pieces(docs, encoder))


def chunk_metrics(docs: DataFrame) -> DataFrame:
    """(strategy, language, chunks, chars, words, bytes, repeated) of all chunks, with totals: those of strategies that share texts are worked out once."""
    sums = {"chunks": F.count("*"), "chars": F.sum(F.length("text")), "words": F.sum(X.split_count(F.col("text"))), "bytes": F.sum(F.octet_length("text"))}
    per = all_pieces(docs).groupBy("strategies", "language", F.unhex(F.sha2("text", 256)).alias("h")).agg(*[v.alias(k) for k, v in sums.items()])
    total = F.grouping_id() == 3
    # in the total of all strategies a piece counts once for each of its strategies
    per = per.withColumns({f"{k}_all": F.col(k) * F.size("strategies") for k in sums})
    own = {k: F.when(total, F.sum(f"{k}_all")).otherwise(F.sum(k)) for k in sums}
    found = per.rollup("strategies", "language").agg(*[v.alias(k) for k, v in own.items()], F.count_distinct("h").alias("texts"))
    return found.select(F.explode_outer("strategies").alias("strategy"), "language", *sums, (F.col("chunks") - F.col("texts")).alias("repeated"))


def late_windows(parents: DataFrame, size: int = SETTINGS.late_sentences) -> DataFrame:
    """``parents`` (with ``source``) exploded to windows that begin at every sentence: window_text, start, end."""
    s = F.col("s")
    spans = F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: F.struct(F.element_at(s, i)["start"].alias("start"), F.element_at(s, F.least(i + (size - 1), F.size(s)))["end"].alias("end")))
    found = with_sentences(parents).where(F.size("s") > 0).withColumn("w", F.explode(spans)).drop("s")
    return found.select("*", F.col("source").substr(F.col("w.start") + 1, F.col("w.end") - F.col("w.start")).alias("window_text"), F.col("w.start").alias("start"), F.col("w.end").alias("end")).drop("w")
