"""Minimax contiguous partition of documents into shards.

Equal texts form one atomic group. Groups stand in the order of a 63-bit content hash; a shard is a range of
that order, so a row's shard follows from its own text and ``n_shards - 1`` cut keys, without any join. The cut
keys belong to the smallest capacity at which a greedy walk over the ordered groups needs at most ``n_shards``
shards, found by binary search; under that capacity they are moved towards equal shares.

The walk never sees all groups at once. The driver holds a summary of the order: blocks of adjacent groups (all
keys with the same leading bits) with their bytes. A walk that may cut inside a block bounds the optimum from
below, one that may not bounds it from above; only blocks where the two can differ are split further. Each level
collects at most ``SUMMARY`` rows, whatever the input, and levels stop when every block that matters is a single
group, so the result is exactly that of the search over all groups.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage, ranked

KEY_BITS = 63
#: Bits of the first summary, and those that one more level adds.
FIRST_BITS, MORE_BITS = 12, 8
#: Rows that a level may send to the driver.
SUMMARY = 1 << 18


def content_key(text: Column) -> Column:
    """Place of a text in the order of groups; null counts as the empty text."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 64 - KEY_BITS)


class _Summary:
    """Blocks of adjacent groups in order: first key, key bits, bytes, groups."""

    def __init__(self, blocks: list[tuple[int, int, int, int]]):
        self.blocks = sorted(blocks)
        self.ends = list(accumulate(b[2] for b in self.blocks))
        self.total = self.ends[-1] if self.ends else 0

    def walk(self, capacity: int, shards: int, inside: bool) -> list[int] | None:
        """Greedy walk: the block of each cut, or None beyond ``shards``. inside: blocks of several groups may be cut anywhere."""
        at, cuts = 0, []
        while at + capacity < self.total:
            i = bisect_right(self.ends, at + capacity)
            to = at + capacity if inside and self.blocks[i][3] > 1 else self.ends[i] - self.blocks[i][2]
            if to <= at or len(cuts) == shards - 1:
                return None
            cuts.append(i)
            at = to
        return cuts

    def least(self, shards: int, inside: bool) -> int:
        """Binary search for the smallest capacity at which the walk succeeds."""
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.walk(middle, shards, inside) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def even(self, capacity: int, shards: int) -> list[int]:
        """Cuts under a feasible capacity, each as near as it may be to an equal share of what is left.

        A greedy walk fills the first shards and leaves the last short; here a cut may stand anywhere from the
        place that a walk from the end needs (so the rest still fits) to the place that the capacity allows.
        """
        starts = [0, *self.ends]
        needed = [self.total]
        for _ in range(shards - 1):
            needed.append(starts[bisect_left(starts, needed[-1] - capacity)] if needed[-1] > capacity else 0)
        at, cuts = 0, []
        for k in range(1, shards):
            if at >= self.total:
                break
            wish = at + (self.total - at) / (shards - k + 1)
            first, last = bisect_left(starts, max(needed[shards - k], at)), bisect_right(starts, at + capacity) - 1
            i = bisect_left(starts, wish)
            i = i - 1 if i and (i == len(starts) or wish - starts[i - 1] <= starts[i] - wish) else i
            i = min(max(i, first), last)
            if starts[i] > at and i < len(self.blocks):
                cuts.append(i)
            at = max(at, starts[i])
        return cuts

    def undecided(self, low: int, high: int, shards: int) -> list[int]:
        """Blocks of several groups in which a cut of a capacity from low to high can lie."""
        late = self.walk(high, shards, inside=True) or []
        at, early = 0, []
        while at + low < self.total and len(early) < shards - 1:
            i = bisect_right(self.ends, at + low)
            early.append(i)
            at = max(at, self.ends[i] - self.blocks[i][2])
        found: set[int] = set()
        for k, i in enumerate(early):
            last = late[k] if k < len(late) else len(self.blocks) - 1
            found.update(j for j in range(i, last + 1) if self.blocks[j][3] > 1)
        return sorted(found, key=lambda j: -self.blocks[j][2])[: SUMMARY >> MORE_BITS]


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[int], int]:
    """First keys of the shards after the first, and the capacity. groups: (key long, bytes long), a row a group."""

    def blocks(bits: int, of: Column | None = None) -> list[tuple[int, int, int, int]]:
        prefix = F.shiftrightunsigned(F.col("key"), KEY_BITS - bits)
        rows = groups if of is None else groups.where(of)
        found = rows.groupBy(prefix.alias("b")).agg(F.sum("bytes"), F.count("*"), F.min("key")).collect()
        return [(r[3] if r[2] == 1 else r[0] << (KEY_BITS - bits), bits, r[1], r[2]) for r in found]

    summary = _Summary(blocks(FIRST_BITS))
    while True:
        low, high = summary.least(shards, inside=True), summary.least(shards, inside=False)
        if low == high:
            return [summary.blocks[i][0] for i in summary.even(high, shards)], high
        chosen = summary.undecided(low, high, shards)
        kept = [b for i, b in enumerate(summary.blocks) if i not in set(chosen)]
        for bits in sorted({summary.blocks[i][1] for i in chosen}):
            prefix = F.shiftrightunsigned(F.col("key"), KEY_BITS - bits)
            of = [summary.blocks[i][0] >> (KEY_BITS - bits) for i in chosen if summary.blocks[i][1] == bits]
            kept += blocks(min(KEY_BITS, bits + MORE_BITS), prefix.isin(of))
        summary = _Summary(kept)


def shard_of(key: Column, cuts: list[int]) -> Column:
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (key >= F.lit(cut)).cast("int")
    return shard


def plan_shards(docs: DataFrame, shards: int = 16, text: str = "text") -> DataFrame:
    """``docs`` without its text, and with size, text_crc32, key, shard and slot.

    size: UTF-8 bytes of the text and 1; a null text counts as an empty one, also for its group. Equal texts,
    and so repeated rows, share a shard. slot: gapless from 0 in a shard, by key. Other columns pass through;
    columns of ``docs`` with one of these names are replaced. An empty table gives no rows.
    """
    new = {"size", "text_crc32", "key", "shard", "slot"}
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in new]
    sized = cut_lineage(docs.select(*kept, (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content).alias("text_crc32"), content_key(content).alias("key")))
    groups = cut_lineage(sized.groupBy("key").agg(F.sum("size").alias("bytes")))
    cuts, _ = minimax_cuts(groups, shards)
    # after the key, equal keys may stand in any order: columns that can be sorted make it the same each time
    plain = [F.col(f"`{c}`") for c, kind in sized.dtypes if kind in ("bigint", "int", "string") and c not in new]
    return ranked(sized.withColumn("shard", shard_of(F.col("key"), cuts)), ["shard"], [F.col("key"), *plain], "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 16, text: str = "text") -> None:
    """Write whole rows into a folder a shard; the shard is computed from each row's text, so texts aren't joined."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    groups = cut_lineage(docs.select(content_key(content).alias("key"), (F.octet_length(content) + 1).cast("long").alias("n")).groupBy("key").agg(F.sum("n").alias("bytes")))
    cuts, _ = minimax_cuts(groups, shards)
    docs.withColumn("shard", shard_of(content_key(F.col(f"`{text}`")), cuts)).write.partitionBy("shard").parquet(path)
