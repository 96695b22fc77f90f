"""Near-duplicate documents: MinHash, banding, verification on full sets, connected components.

1. Each text's set of word shingles is hashed to 64 bits; equal sets fall together by a 128-bit fingerprint and
   go on as one class, so copies cost nothing further.
2. A class gets BANDS * ROWS minima of universal hashes. Classes that share a band's minima share a bucket.
   Two sets of similarity 0.8 share none with a probability of 3e-6.
3. First each member of a bucket is paired with the class there that meets most others, which is linear in the bucket. Pairs
   are confirmed on full sets, and confirmed links give components by large-star and small-star.
4. Then only members of one bucket in different components can hide a link. Those pairs are compared by
   signature and, where sets are small, by their sets at 32 bits an element, in blocks of at most BLOCK members,
   each pair in the first band that it shares; what comes near the threshold is confirmed on full sets too. A bucket beyond the block size is dealt to pairs of blocks.

No bucket is cut short. Only (class, class) pairs that pass the signatures become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage, forget, fresh, small
from veristra.llm.components import connected_components
from veristra.llm.wordhash import chunks, mix, window_hashes, word_hashes

BANDS, ROWS = 32, 5
SEED = 20_26
BLOCK = 256
#: Pairs whose signatures agree in less than the threshold less this share are not confirmed: 5 deviations of 160 minima at
#: 0.8, which a pair at the threshold falls short of with a probability of 2e-6 (of 160 at 0.8, 102 or fewer agree).
SLACK = 0.16
WORDS, PERCENT = 5, 80
#: Elements of a set that travels with its signature.
BRIEF = 2048
#: Ids that are broadcast instead of shuffling all texts to them: 8 bytes each.
FEW = 500_000


def _families() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return (rng.integers(0, 1 << 32, n, np.uint64) | np.uint64(1)).astype(np.uint32), rng.integers(0, 1 << 32, n, np.uint64).astype(np.uint32)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: runs of k words, A-Z lower-cased, or all words if there are fewer."""
    hashes, first = word_hashes(texts, lower=True)
    runs = window_hashes(hashes, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


SIGNED = "id long, n long, f1 long, f2 long, bands array<long>, signature binary"


def sign(docs: DataFrame, k: int) -> DataFrame:
    """SIGNED rows of (id, text): set size, fingerprint, band hashes, and a byte of each minimum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult, add = _families()
        order = np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
        band = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for batch in batches:
            for low, high in chunks(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(low, high - low), k)
                size = np.array([len(s) for s in sets])
                full = np.flatnonzero(size)
                f1, f2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
                minima = np.zeros((len(full), BANDS * ROWS), np.uint32)
                if len(full):
                    flat = np.concatenate([sets[i] for i in full])
                    starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
                    f1[full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), starts)
                    f2[full] = np.bitwise_xor.reduceat(mix(flat + np.uint64(0x14057B7EF767814F)), starts)
                    short = (flat >> np.uint64(32)).astype(np.uint32)
                    # in stretches of whole sets that stay in the processor's cache
                    edges = np.unique(np.searchsorted(starts, np.arange(0, len(flat) + 1, 1 << 16)))
                    edges = [0, *[e for e in edges.tolist() if 0 < e < len(full)], len(full)]
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        x = short[starts[a] : starts[b] if b < len(full) else None]
                        at = starts[a:b] - starts[a]
                        for i in range(BANDS * ROWS):
                            minima[a:b, i] = np.minimum.reduceat(x * mult[i] + add[i], at)
                hashed = mix((minima.reshape(len(full), BANDS, ROWS).astype(np.uint64) * order).sum(2, dtype=np.uint64) + band)
                signature = (minima & np.uint32(255)).astype(np.uint8)
                bands: list = [None] * len(sets)
                bytes_: list = [None] * len(sets)
                for row, i in enumerate(full.tolist()):
                    bands[i] = hashed[row].view(np.int64)
                    bytes_[i] = signature[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(size, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())],
                    names=["id", "n", "f1", "f2", "bands", "signature"],
                )

    return docs.mapInArrow(run, SIGNED)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose full sets reach the similarity."""
    a, b = sets.select(F.col("id").alias("u"), F.col("set").alias("a")), sets.select(F.col("id").alias("v"), F.col("set").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                most = min(len(x), len(y))
                if 100 * most < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _near(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): classes of one bucket in different components whose signatures come near the threshold.

    members: bucket, id, component, size (of the bucket), bands, signature, n, brief. Small sets travel along in
    brief, so that only pairs that are links, or nearly, become rows.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    other = F.sequence(F.lit(0), blocks - 1)
    dealt = members.withColumn("mine", mine).withColumn("other", F.explode(other))
    dealt = dealt.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    least = int(np.floor((percent / 100 - SLACK) * BANDS * ROWS))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, part = table.column("id").to_numpy(), table.column("component").to_numpy()
        found = []
        if len(np.unique(part)) > 1:
            bucket, i, j = (x.as_py() for x in key)
            mine = table.column("mine").to_numpy()
            bands = np.array(table.column("bands").to_pylist(), np.int64)
            at = int(np.flatnonzero(bands[0] == bucket)[0])
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
            # members of the most common component only meet those of others, so others are walked through
            common = np.unique(part, return_counts=True)
            outside = np.flatnonzero(part != common[0][common[1].argmax()])
            brief = [None if x is None else np.frombuffer(x, np.uint32) for x in table.column("brief").to_pylist()]
            small = np.array([x is not None for x in brief])
            size = table.column("n").to_numpy()
            rank = np.full(len(ids), -1)
            rank[outside] = np.arange(len(outside))
            for a in outside.tolist():
                # each pair once: two walked members meet at the first of them
                can = (part != part[a]) & ((rank < 0) | (rank > rank[a])) & ((mine != mine[a]) | (i == j))
                b = np.flatnonzero(can)
                b = b[(signature[b] == signature[a]).sum(1) >= least]
                if at and len(b):
                    b = b[~(bands[b, :at] == bands[a, :at]).any(1)]
                if brief[a] is not None and small[b].any():
                    rest, b = b[~small[b]], b[small[b]]
                    flat = np.concatenate([brief[x] for x in b])
                    starts = np.concatenate([[0], np.cumsum([len(brief[x]) for x in b])[:-1]])
                    place = np.minimum(np.searchsorted(brief[a], flat), len(brief[a]) - 1)
                    # two elements of a set may share 32 bits, hence the 2
                    both = np.add.reduceat(brief[a][place] == flat, starts, dtype=np.int64) + 2
                    b = np.concatenate([rest, b[100 * both >= percent * (size[a] + size[b] - both)]])
                found.append(np.stack([np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])], 1))
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pa.table({"u": pa.array(found[:, 0], pa.int64()), "v": pa.array(found[:, 1], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``; other columns are dropped.

    component_id: the smallest doc_id that links reach, itself included; kept: it is the document's own. Null or
    empty texts, and texts without a word, have no shingles and no links. A row without a doc_id gets no component
    and is kept. Rows that repeat a doc_id share its component.
    """
    return _near_duplicates(docs, k, percent, text, key)[0]


def _near_duplicates(docs: DataFrame, k: int, percent: int, text: str, key: str) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``near_duplicates``, and the checkpoints that it is read from."""
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    signed = cut_lineage(sign(source, k))
    print_ = ["n", "f1", "f2"]
    some = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = cut_lineage(some.groupBy(*print_).agg(F.min("id").alias("class"), F.min_by("bands", "id").alias("bands"), F.min_by("signature", "id").alias("signature")))
    banded = classes.select(F.col("class").alias("id"), F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut_lineage(banded.join(sizes, "bucket"))
    # the member that meets most others in all its buckets is the text that the others are copies of
    fame = shared.groupBy("id").agg(F.sum("size").alias("fame"))
    famous = cut_lineage(shared.join(fame, "id"))
    forget(shared)
    hubs = famous.groupBy("bucket").agg(F.max(F.struct("fame", (-F.col("id")).alias("minus"))).alias("top"))
    members = cut_lineage(famous.join(hubs, "bucket").select("bucket", "id", "size", (-F.col("top.minus")).alias("hub")))
    forget(famous)
    wanted = cut_lineage(members.select("id").distinct())

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in chunks(batch.column(1)):
                sets = shingle_sets(batch.column(1).slice(low, high - low), k)
                brief = [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() if len(s) <= BRIEF else None for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(brief, pa.binary())], names=["id", "set", "n", "brief"])

    sets = cut_lineage(source.join(small(wanted, FEW), "id", "left_semi").mapInArrow(to_sets, "id long, set binary, n long, brief binary").dropDuplicates(["id"]))
    links = cut_lineage(_confirm(members.where("id <> hub").select(F.col("hub").alias("u"), F.col("id").alias("v")).distinct(), sets, percent))
    forget(wanted)
    parts = cut_lineage(connected_components(links))

    # links that no pair with a hub has shown
    label = parts.select(F.col("node").alias("id"), "component")
    named = members.join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    open_ = named.join(mixed, "bucket", "left_semi").join(classes.select(F.col("class").alias("id"), "bands", "signature"), "id").join(sets.select("id", "n", "brief"), "id")
    more = cut_lineage(_confirm(_near(open_.select("bucket", "id", "component", "size", "bands", "signature", "n", "brief"), percent).distinct(), sets, percent))
    if more.head(1):
        first, parts = parts, cut_lineage(connected_components(links.unionByName(more)))
        forget(first)
    forget(members, sets, links, more)

    component = classes.select(*print_, "class").join(parts, F.col("class") == F.col("node"), "left").select(*[F.col(c).alias(f"_{c}") for c in print_], F.coalesce("component", "class").alias("component"))
    same = (F.col("n") == F.col("_n")) & (F.col("f1") == F.col("_f1")) & (F.col("f2") == F.col("_f2"))
    found = signed.select("id", *print_).join(component, same, "left")
    least = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    result = found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), least.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return result, [signed, classes, parts]


def keep_first(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of ``docs`` for each component: that of its least doc_id, and one only where rows repeat id and text.

    Rows without a doc_id are compared like all others and come after those that have one; they go by their text, so
    repeated ones are one row too. Different texts under one doc_id are not repeats and share its fate.
    """
    id_, print_, gone_ = fresh(docs, "id", "print", "gone")
    # ids from 2 ** 62 on, by text, for rows without
    own = F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(F.col(f"`{text}`").cast("string")), 2))
    named = docs.withColumns({print_: F.xxhash64(F.col(f"`{text}`").cast("string")), id_: own})
    kept, read_from = _near_duplicates(named.select(F.col(id_).alias("doc_id"), F.col(f"`{text}`").alias("text")), k, percent, "text", "doc_id")
    gone = kept.where(~F.col("kept")).select("doc_id").distinct().withColumn("gone", F.lit(True))
    rows = named.groupBy(F.col(id_).alias("doc_id"), F.col(print_).alias("print")).agg(F.count("*").alias("n"))
    fate = cut_lineage(rows.join(gone, "doc_id", "left").where("gone or n > 1").select(F.col("doc_id").alias(id_), F.col("print").alias(print_), F.coalesce("gone", F.lit(False)).alias(gone_)))
    forget(*read_from)
    single = named.join(fate.select(id_, print_), [id_, print_], "left_anti")
    repeated = named.join(fate.where(~F.col(gone_)).select(id_, print_), [id_, print_], "left_semi").dropDuplicates([id_, print_])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
