"""Approximate nearest neighbours by inner product: a forest of sorted hash strings.

Rows are dealt at random to blocks of about BLOCK vectors, and each block holds a forest of its own: TREES sorted arrays of
BITS-bit hash strings (signs of random hyperplanes). Inner product becomes an angle by one more coordinate that
lifts every vector of a block to one norm. A query descends in each tree to the longest prefix that any row
shares with its string, then all trees ascend together, one bit at a time, until the ranges that share the prefix
hold enough different candidates. These are scored on the original vectors, and each block hands over its best.

Blocks are random, so neither a dense region nor a vector that a third of all rows share makes one larger. Queries
meet every block, in chunks large enough that building a block's forest costs little beside asking it. ``share``: of a
block's rows that count as enough; it holds for blocks of every size. Where vectors are spread evenly over a
sphere of many dimensions, near and far hardly differ, and only a large share finds nine in ten; ``looked_at`` tells
how many rows were scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from veristra.llm.common import cut_lineage

TREES, BITS = 256, 32
BLOCK, CHUNK = 16384, 8192
SHARE = 1 / 3
#: Rows looked at for each neighbour asked for, at least: where neighbours are a large part of few rows, a third of these misses too many.
PER_NEIGHBOUR = 12
SEED = 5


class Forest:
    """Sorted hash strings of one block's vectors."""

    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = SEED):
        self.vectors = vectors
        self.bits = bits
        norms = (vectors**2).sum(1)
        lift = np.sqrt(np.maximum(norms.max(initial=0.0) - norms, 0))
        self.planes = np.random.default_rng(seed).normal(size=(trees, vectors.shape[1] + 1, bits))
        lifted = np.column_stack([vectors, lift])
        self.order = np.empty((trees, len(vectors)), np.int32)
        self.strings = np.empty((trees, len(vectors)), np.uint32)
        for t, plane in enumerate(self.planes):
            code = self._code(lifted, plane)
            self.order[t] = np.argsort(code, kind="stable")
            self.strings[t] = code[self.order[t]]

    def _code(self, vectors: np.ndarray, plane: np.ndarray) -> np.ndarray:
        signs = np.packbits(vectors @ plane > 0, axis=1)
        padded = np.zeros((len(vectors), 4), np.uint8)
        padded[:, : signs.shape[1]] = signs
        return padded.view(">u4")[:, 0].astype(np.uint32)

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place, by tree and query, of strings that share ``depth`` bits with the query's."""
        rest = np.uint32(((1 << (32 - depth)) - 1) & 0xFFFFFFFF)
        low, high = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        for t in range(len(codes)):
            low[t] = np.searchsorted(self.strings[t], codes[t] & ~rest, "left")
            high[t] = np.searchsorted(self.strings[t], codes[t] | rest, "right")
        return low, high

    def candidates(self, queries: np.ndarray, enough: int):
        """For each query, the rows found when the ascent stops."""
        n = len(self.vectors)
        flat = np.column_stack([queries, np.zeros(len(queries))])
        codes = np.stack([self._code(flat, plane) for plane in self.planes])
        shift = (np.arange(len(codes)) * n)[:, None]
        order = self.order.ravel()
        open_ = np.arange(len(queries))
        for depth in range(self.bits, -1, -1):
            if not len(open_):
                return
            low, high = self.ranges(codes[:, open_], depth)
            sizes, starts = (high - low).T, (low + shift).T
            left = np.ones(len(open_), bool)
            # the ranges overlap, so fewer rows than their sum differ: no need to look where even the sum is too small
            for i in np.flatnonzero((sizes.sum(1) >= min(enough, n)) | (depth == 0)):
                count = sizes[i]
                places = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts[i], count)
                seen = np.zeros(n, bool)
                seen[order[places]] = True
                if depth == 0 or np.count_nonzero(seen) >= enough:
                    left[i] = False
                    yield int(open_[i]), np.flatnonzero(seen)
            open_ = open_[left]


def best_of(forest: Forest, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, share: float) -> tuple[list[tuple], int]:
    """(query id, id, score) of each query's k best candidates, and how many rows were scored."""
    out, looked_at = [], 0
    for q, rows in forest.candidates(queries, max(PER_NEIGHBOUR * k, int(np.ceil(share * len(ids))))):
        looked_at += len(rows)
        rows = rows[ids[rows] != query_ids[q]]
        if not len(rows):
            continue
        rough = forest.vectors[rows] @ queries[q]
        if len(rows) > k:
            # matrix products may round equal vectors apart; all that tie with the last are looked at again
            rows = rows[rough >= np.partition(rough, -k)[-k] - 1e-9 * max(1.0, np.abs(rough).max())]
        exact = (forest.vectors[rows] * queries[q]).sum(1)
        order = np.lexsort((ids[rows], -exact))[:k]
        out += [(int(query_ids[q]), int(i), float(s)) for i, s in zip(ids[rows[order]], exact[order], strict=True)]
    return out, looked_at


def valid(vector: Column) -> Column:
    """Not null, without null or non-finite components, not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(base: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE, vector: str = "embedding", key: str = "vec_id", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of ``base`` found, of another key than its own.

    Ties go to the smaller key; a key that occurs more than once may take several ranks. Rows whose vector isn't
    ``valid``, or whose key is null, take no part; a query meets only vectors of its own length. Other columns
    are dropped. An empty side gives no rows.
    """

    def plain(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`")
        usable = df.where(valid(v) & F.col(f"`{key}`").isNotNull())
        return usable.select(F.col(f"`{key}`").cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"))

    rows, asked = cut_lineage(plain(base)), cut_lineage(plain(queries))
    blocks, parts = max(1, round(rows.count() / block)), max(1, -(-asked.count() // CHUNK))
    mark = lambda df, name, n: df.withColumn(name, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int")).withColumn("size", F.size("v"))
    dealt = mark(rows, "block", blocks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = mark(asked, "part", parts).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = "query_id long, vec_id long, score double"

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        values = table.column("v").combine_chunks()
        return table.column("id").to_numpy(), np.asarray(values.flatten()).reshape(len(values), -1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids, vectors = matrix(left.sort_by("id"))
            found, _ = best_of(Forest(vectors), ids, *matrix(right), k, share)
        a, b, c = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    keys = ["block", "part", "size"]
    found = dealt.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, schema)
    # at most k rows a block reach this window for a query
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
