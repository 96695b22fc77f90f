"""Vector functions as Columns, in double precision."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; the shorter vector wins."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + F.coalesce(x, F.lit(0.0)))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / size)


def unit(v: Column) -> Column:
    """Scaled to norm 1; a norm of 0 counts as 1."""
    size = F.when(norm(v) == 0, 1.0).otherwise(norm(v))
    return F.transform(_double(v), lambda x: x / size)


def valid(v: Column, dimension: int) -> Column:
    return F.coalesce((F.size(v) == dimension) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def valid_sparse(indices: Column, values: Column, space: int = 1 << 20) -> Column:
    """Sorted, unique, in range, finite and of equal length."""
    ok = (F.size(indices) == F.size(values)) & (F.array_sort(F.array_distinct(indices)) == indices)
    return F.coalesce(ok & F.forall(indices, lambda i: i.between(0, space - 1)) & F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def hashed_embedding(tokens: Column, dimension: int = 64) -> Column:
    """A deterministic embedding: each token adds 1 or -1 at a place that its SHA-256 gives; then norm 1."""

    @F.pandas_udf("array<double>")
    def encode(lists: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, float]] = {}
        out = []
        for words in lists:
            v = np.zeros(dimension)
            for w in words if words is not None else ():
                if w not in known:
                    digest = hashlib.sha256(w.encode()).digest()
                    known[w] = (int.from_bytes(digest[:4], "big") % dimension, 1.0 if digest[4] % 2 else -1.0)
                place, sign = known[w]
                v[place] += sign
            out.append(v / (np.sqrt((v * v).sum()) or 1.0))
        return pd.Series(out)

    return encode(tokens)
