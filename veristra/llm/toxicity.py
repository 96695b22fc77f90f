"""Toxicity by a factorization machine over hashed terms.

Terms of a text: its distinct words (letter runs, lower case) and the first 4 and 5 letters of longer words, hashed
to 40 bits. The score is a logistic of bias, one weight a term and, for each pair of terms, the product of
their factors, so that two terms can mean more together than each alone. Weights and factors are fitted together.

The model is fitted from a bounded sample of labelled rows: at most POSITIVES and NEGATIVES of either label, the
least by hash of doc_id, so the same rows each time. Spark counts the terms of the sample's whole texts by label; only
terms that go with toxicity take part, so that a long text doesn't gather noise: those that do so alone (``telling``),
at most TERMS of them, and those that do so together though each alone may be common in clean texts (``meeting``),
sought among the CANDIDATES terms of most toxic rows. Rows reach the driver as lists of such terms, four bytes each.
Every document is then scored over its whole text in one scan without a shuffle; the model's size depends on the
sample alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import fresh

POSITIVES, NEGATIVES = 3000, 7000
#: Terms that a model may know, the most telling first.
TERMS = 20_000
#: A telling term: in so many rows, of a likelihood ratio (twice its log) and a lower bound of its share of toxic rows.
LEAST_ROWS, LEAST_RATIO, LEAST_SHARE = 3, 12.0, 0.3
#: Terms whose pairs are tried. Each of two terms must raise the share of toxic rows among those of the other, by a
#: likelihood ratio that chance reaches in one of 2 * 10^7 pairs, to a share of which this is the lower bound.
CANDIDATES, PAIR_RATIO, PAIR_SHARE = 2048, 32.0, 0.5
FACTORS = 4
ROUNDS, BATCH = 12, 64
RATE, FACTOR_RATE, L1, L2 = 0.7, 0.1, 1.0, 0.02
THRESHOLD = 0.7
SEED = 11
#: Words whose terms a worker keeps.
CACHE = 200_000

_letters = re.compile(r"[^\W\d_]+")


def term(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=5).digest(), "big")


def word_terms(word: str) -> list[int]:
    found = [term(word)]
    found += [term(f"^{word[:n]}") for n in (4, 5) if len(word) > n]
    return found


def distinct_words(text: str | None) -> set[str]:
    return set(_letters.findall(text.lower())) if text else set()


def text_terms(text: str | None) -> set[int]:
    return {x for w in distinct_words(text) for x in word_terms(w)}


@dataclass
class FactorizationMachine:
    bias: float
    terms: dict[int, int]
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self) -> None:
        self._words: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_words"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state, _words={})

    def rows(self, text: str | None) -> list[int]:
        known = self._words
        if len(known) > CACHE:
            known.clear()
        found: set[int] = set()
        for w in distinct_words(text):
            at = known.get(w)
            if at is None:
                at = known[w] = tuple(self.terms[t] for t in word_terms(w) if t in self.terms)
            if at:
                found.update(at)
        return sorted(found)

    def score(self, text: str | None) -> float:
        at = self.rows(text)
        margin = self.bias
        if at:
            v = self.factors[at]
            margin += float(self.weights[at].sum()) + 0.5 * float((v.sum(0) ** 2 - (v * v).sum(0)).sum())
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def train(rows: list[tuple[int, np.ndarray]]) -> FactorizationMachine:
    """Fit on (label, terms). Without both labels there is nothing to tell them apart: the score is the same for all."""
    labels = np.array([y for y, _ in rows], np.float32)
    if not 0 < labels.sum() < len(labels):
        p = (float(labels.sum()) + 1) / (len(labels) + 20)
        return FactorizationMachine(float(np.log(p / (1 - p))), {}, np.zeros(0, np.float32), np.zeros((0, FACTORS), np.float32))
    names, at = np.unique(np.concatenate([t for _, t in rows]).astype(np.int64), return_inverse=True)
    first = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
    m, rng = len(names), np.random.default_rng(SEED)
    w, z, gw = np.zeros(m), np.zeros(m), np.zeros(m)
    v, gv = rng.normal(0, 0.01, (m, FACTORS)), np.ones((m, FACTORS))
    bias = float(np.log(labels.mean() / (1 - labels.mean())))
    gb = 1.0
    for _ in range(ROUNDS):
        for batch in np.array_split(rng.permutation(len(rows)), -(-len(rows) // BATCH)):
            sizes = first[batch + 1] - first[batch]
            row = np.repeat(np.arange(len(batch)), sizes)
            entries = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[batch][row]
            own, local = np.unique(at[entries], return_inverse=True)
            wo, vo = w[own], v[own]
            va = vo[local]
            total = lambda values: np.bincount(row, values, len(batch))  # noqa: B023, E731
            sums = np.stack([total(va[:, f]) for f in range(FACTORS)], 1)
            squares = np.stack([total(va[:, f] ** 2) for f in range(FACTORS)], 1)
            margin = bias + total(wo[local]) + 0.5 * (sums**2 - squares).sum(1)
            off = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - labels[batch]
            slope = off[row]
            dv = np.stack([np.bincount(local, slope * (sums[row, f] - va[:, f]), len(own)) for f in range(FACTORS)], 1) + L2 * vo
            gv[own] += dv**2
            v[own] -= FACTOR_RATE / np.sqrt(gv[own]) * dv
            # follow the regularised leader for the weights: exact zeros where the evidence is below L1
            dw = np.bincount(local, slope, len(own))
            grown = gw[own] + dw**2
            zo = z[own] + dw - (np.sqrt(grown) - np.sqrt(gw[own])) / RATE * wo
            w[own] = np.where(np.abs(zo) > L1, -(zo - np.sign(zo) * L1) / ((1 + np.sqrt(grown)) / RATE), 0)
            z[own], gw[own] = zo, grown
            gb += off.sum() ** 2
            bias -= RATE / np.sqrt(gb) * off.sum()
    return FactorizationMachine(float(bias), {int(t): i for i, t in enumerate(names.tolist())}, w.astype(np.float32), v.astype(np.float32))


def telling(counts: DataFrame, positives: int, total: int) -> DataFrame:
    """(term, ratio): terms that go with toxicity. counts: (term, toxic, n), rows of the sample that hold the term.

    ratio: G, twice the log likelihood ratio of label and term against independence. A term also needs LEAST_ROWS
    rows, and a share of toxic rows whose lower bound (Wilson, 95 % one-sided) is LEAST_SHARE.
    """
    a, n = F.col("toxic").cast("double"), F.col("n").cast("double")
    p, rest = F.lit(positives / total), F.lit((total - positives) / total)
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    ratio = 2 * (part(a, n * p) + part(n - a, n * rest) + part(positives - a, (total - n) * p) + part(total - positives - n + a, (total - n) * rest))
    z = 1.645
    low = (a / n + z * z / 2 / n - z * F.sqrt(a / n * (1 - a / n) / n + z * z / 4 / n / n)) / (1 + z * z / n)
    return counts.where((F.col("n") >= LEAST_ROWS) & (ratio >= LEAST_RATIO) & (low >= LEAST_SHARE)).select("term", ratio.alias("ratio"))


def together(rows: list[tuple[int, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two n by n arrays: toxic and clean rows that hold both terms. rows: (label, places of its terms below n)."""
    found = np.zeros((2, n, n), np.float32)
    for y in (1, 0):
        some = [at for label, at in rows if label == y]
        for low in range(0, len(some), 1024):
            part = some[low : low + 1024]
            held = np.zeros((len(part), n), np.float32)
            for row, at in enumerate(part):
                held[row, at] = 1
            found[1 - y] += held.T @ held
    return found[0], found[1]


def meeting(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Whether each term is one of a pair that goes with toxicity beyond either term alone.

    toxic, clean: from ``together``. A pair counts if in the rows of either term the other raises the share of toxic
    rows, with G (twice the log likelihood ratio) of PAIR_RATIO both ways, and the lower bound of the share of toxic
    rows among those with both (Wilson, 95 % one-sided) is PAIR_SHARE.
    """
    z, out = 1.645, np.zeros(len(toxic), bool)
    own = (np.diag(toxic).astype(float), np.diag(clean).astype(float))

    def raised(a: np.ndarray, b: np.ndarray, both_toxic: np.ndarray, both_clean: np.ndarray) -> np.ndarray:
        # a, b: toxic and clean rows of the one term; the other's presence against the label there
        cells = np.stack([both_toxic, both_clean, a - both_toxic, b - both_clean])
        with_it, without = cells[0] + cells[1], cells[2] + cells[3]
        every = np.maximum(with_it + without, 1)
        due = np.stack([with_it * a, with_it * b, without * a, without * b]) / every
        ratio = 2 * (cells * np.log(np.where(cells > 0, cells / np.where(due > 0, due, 1), 1))).sum(0)
        return np.where(cells[0] > due[0], ratio, 0)

    for low in range(0, len(toxic), 128):
        part = slice(low, low + 128)
        t, c = toxic[part].astype(float), clean[part].astype(float)
        one = raised(own[0][part, None], own[1][part, None], t, c)
        other = raised(own[0][None, :], own[1][None, :], t, c)
        n = np.maximum(t + c, 1)
        share = (t / n + z * z / 2 / n - z * np.sqrt(t / n * (1 - t / n) / n + z * z / 4 / n / n)) / (1 + z * z / n)
        out[part] = ((np.minimum(one, other) >= PAIR_RATIO) & (share >= PAIR_SHARE)).any(1)
    return out


def fit(docs: DataFrame, labels: DataFrame, held_out: Callable[[Column], Column], text: str = "text", key: str = "doc_id", label: str = "toxic") -> FactorizationMachine:
    """Fit on labelled rows that ``held_out`` (a Column function of the key) leaves.

    Null labels and keys are left out; a key that is labelled more than once is toxic if one label says so; a document
    that occurs more than once counts as often. Null and empty texts count as rows without terms. Without rows of
    both labels all texts get one score. Other columns play no part.
    """
    known = labels.select(F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").cast("double").alias("label"))
    known = known.where(F.col("label").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).groupBy("id").agg((F.max("label") > 0).cast("int").alias("y"))
    draw = lambda y, n: known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n)
    # at most POSITIVES + NEGATIVES rows of two numbers
    sample = F.broadcast(draw(1, POSITIVES).unionByName(draw(0, NEGATIVES)))
    source = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").cast("string").alias("t")).join(sample, "id").select("y", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(t, y) for y, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for t in text_terms(raw)]
            names, of = np.unique(np.array([t for t, _ in found], np.int64), return_inverse=True)
            toxic = np.bincount(of, [y for _, y in found], len(names)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(toxic), pa.array(np.bincount(of, minlength=len(names)), pa.int64())], names=["term", "toxic", "n"])

    rows_by_label = {r[0]: r[1] for r in source.groupBy("y").count().collect()}
    positives, total = rows_by_label.get(1, 0), sum(rows_by_label.values())
    if not 0 < positives < total:
        return train([(y, np.zeros(0, np.int64)) for y, n in rows_by_label.items() for _ in range(n)])
    counted = source.mapInArrow(count, "term long, toxic long, n long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    by_ratio = telling(counted, positives, total).orderBy(F.col("ratio").desc(), "term").limit(TERMS).select("term", F.lit(True).alias("alone"))
    by_count = counted.where((F.col("toxic") >= LEAST_ROWS) & (F.col("n") >= LEAST_ROWS)).orderBy(F.col("toxic").desc(), "term").limit(CANDIDATES).select("term", F.lit(False).alias("alone"))
    # one job: both read the counts from one shuffle
    picked = by_ratio.unionByName(by_count).collect()
    alone, frequent = {r.term for r in picked if r.alone}, sorted(r.term for r in picked if not r.alone)
    # candidates stand first
    names = np.array(frequent + sorted(alone - set(frequent)), np.int64)
    place = {t: i for i, t in enumerate(names.tolist())}

    def to_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted(place[x] for x in text_terms(t) if x in place), "<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["y", "places"])

    rows = [(r[0], np.frombuffer(r[1], "<i4")) for r in source.mapInArrow(to_places, "y int, places binary").collect()]
    n = len(frequent)
    paired = meeting(*together([(y, at[at < n]) for y, at in rows], n))
    chosen = np.array([t in alone for t in names.tolist()], bool)
    chosen[:n] |= paired
    return train(sorted(((y, np.sort(names[at[chosen[at]]])) for y, at in rows), key=lambda r: (r[0], r[1].tobytes())))


def score(docs: DataFrame, model: FactorizationMachine, text: str = "text", to: str = "score") -> DataFrame:
    """``docs`` less its text, with a score from 0 to 1. Null and empty texts, and words without a weight, leave the bias.

    A column of ``docs`` named as ``to`` is replaced; all others pass through.
    """
    kept = [c for c in docs.columns if c.lower() not in (text.lower(), to.lower())]
    (content,) = fresh(docs, "content")
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(content))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], f"`{to}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = held.value.score
        for batch in batches:
            values = pa.array([scored(t) for t in batch.column(batch.num_columns - 1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], values], names=[*kept, to])

    return source.mapInArrow(run, schema)


def third(key: Column) -> Column:
    """The third of rows that is held out; never for a null key."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))
