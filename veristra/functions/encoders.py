"""Dense encoders as arguments: a model that workers load once, run over Arrow batches, and that indexes are bound to.

An ``Encoder`` says how a model is loaded and what its vectors depend on. Its settings go into an index's manifest, so
that vectors of one encoder are never searched with queries of another.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], Sequence[Sequence[float]]]


@dataclass(frozen=True)
class Encoder:
    """``load`` is called in a worker and gives a function from texts to vectors; it may open files that all workers see.

    name, version, dimension, prefixes and ``unit`` are what vectors depend on; ``batch`` is only how many texts the
    model gets at once. ``unit``: vectors are scaled to norm 1 (a norm of 0 stays).
    """

    name: str
    version: str
    dimension: int
    load: Callable[[], Model]
    query_prefix: str = ""
    passage_prefix: str = ""
    unit: bool = True
    batch: int = 64

    def settings(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("load", "batch")}

    def fingerprint(self) -> str:
        return hashlib.sha256(json.dumps(self.settings(), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def prefix(self, role: str) -> str:
        if role not in ("query", "passage"):
            raise ValueError(f"a text is a query or a passage, not {role}")
        return self.query_prefix if role == "query" else self.passage_prefix


#: Models of this worker by fingerprint. Workers outlive tasks, so a model is loaded once for many.
_models: dict[str, Model] = {}


def model_of(encoder: Encoder) -> Model:
    key = encoder.fingerprint()
    if key not in _models:
        _models[key] = encoder.load()
    return _models[key]


def encode_list(encoder: Encoder, texts: Sequence[str], role: str = "passage") -> np.ndarray:
    """One row a text. Equal texts are encoded once; texts of like length go to the model together.

    A model that returns another number of vectors, another dimension, or what is not finite raises.
    """
    out = np.zeros((len(texts), encoder.dimension))
    if not len(texts):
        return out
    model, prefix = model_of(encoder), encoder.prefix(role)
    distinct = sorted(set(texts), key=lambda t: (len(t), t))
    place = {t: i for i, t in enumerate(distinct)}
    found = np.zeros((len(distinct), encoder.dimension))
    for low in range(0, len(distinct), encoder.batch):
        some = distinct[low : low + encoder.batch]
        vectors = np.asarray(model([prefix + t for t in some]), float)
        if vectors.shape != (len(some), encoder.dimension) or not np.isfinite(vectors).all():
            raise ValueError(f"{encoder.name} {encoder.version} gave {vectors.shape} for {len(some)} texts, or values that are not finite; due are {encoder.dimension} each")
        found[low : low + len(some)] = vectors
    if encoder.unit:
        size = np.sqrt((found * found).sum(1))
        found /= np.where(size > 0, size, 1.0)[:, None]
    out[:] = found[[place[t] for t in texts]]
    return out


def vector_of(text: Column, encoder: Encoder, role: str = "passage") -> Column:
    """array<double>; null for a null text. An empty text is encoded like any other."""
    encoder.prefix(role)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            there = texts.notna().to_numpy()
            vectors = encode_list(encoder, texts[there].tolist(), role)
            at = np.cumsum(there) - 1
            yield pd.Series([vectors[i] if known else None for i, known in zip(at, there, strict=True)], dtype=object)

    return run(text.cast("string"))


def encode(df: DataFrame, encoder: Encoder, text: str = "text", to: str = "embedding", role: str = "passage") -> DataFrame:
    """``df`` with a column of vectors; a column of that name is replaced. No shuffle: each task encodes what it reads."""
    return df.withColumn(to, vector_of(F.col(f"`{text}`"), encoder, role))


#: Tokens whose places a model keeps.
KNOWN = 100_000


def signed_hashes(dimension: int, fold: bool) -> Model:
    """Each white-space token adds 1 or -1 at a place that its SHA-256 gives: vectors for when no model is at hand."""
    known: dict[str, int] = {}

    def model(texts: list[str]) -> np.ndarray:
        rows = [(t.lower() if fold else t).split() for t in texts]
        words = list(chain.from_iterable(rows))
        if len(known) >= KNOWN:
            known.clear()
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            digests = np.frombuffer(b"".join([hashlib.sha256(w.encode()).digest()[:5] for w in new]), np.uint8).reshape(-1, 5)
            places = digests[:, :4].copy().view(">u4")[:, 0].astype(np.int64) % dimension
            known.update(zip(new, (places * 2 + digests[:, 4] % 2).tolist(), strict=True))
        found = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        at = np.repeat(np.arange(len(rows)) * dimension, [len(r) for r in rows]) + found // 2
        return np.bincount(at, found % 2 * 2.0 - 1, len(texts) * dimension).reshape(-1, dimension)

    return model


def hashed(dimension: int = 64, unit: bool = True, fold: bool = False) -> Encoder:
    """The deterministic encoder of tests and of sections; ``fold``: tokens in lower case."""
    return Encoder("signed-hashes-folded" if fold else "signed-hashes", "1", dimension, lambda: signed_hashes(dimension, fold), unit=unit)
