"""Removal of word windows that occur more than once, by level-wise doubling.

A window of ``length`` words can only repeat if all parts of it do. Level 1 looks at windows of a quarter of the length,
level 2 at those of half, level 3 at the full length: each level counts only what lies in a full window whose parts
repeated at the level before. Of the parts in a full window it is enough to look at one that the words themselves
choose (the least hash), as equal full windows choose the same; at level 1 that is about one position in fourteen.
What is removed is settled at the full length. ``longest_repeats`` goes on from there: windows of twice the length are
put together from two that both repeat, until no candidates survive.

Texts of the same words are one class from the start. All words of a class of several documents are covered
(if they fill a window), so only its first document goes on, for the sake of others that share windows with it.

Counts combine before they are shuffled. A window that a large share of rows has is found by a broadcast of the hot
windows, of which there are at most HOT_KEYS, and all others by a shuffle (``_among``). The only lists are those of one
document. Texts are told apart by 128-bit hash, windows by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage, forget, fresh, small
from veristra.llm.wordhash import _powers, chunks, mix, window_hashes, word_hashes

LENGTH = 35
#: Text hashes that are broadcast instead of shuffling all texts to them: 8 bytes each.
FEW = 500_000
#: A key is hot if it has more than HOT rows and more than one in HOT_KEYS of all; so at most HOT_KEYS are.
HOT, HOT_KEYS = 4096, 50_000
EMPTY = hashlib.sha256(b"").hexdigest()


def _among(rows: DataFrame, counted: DataFrame, *by: str) -> DataFrame:
    """Those of ``rows`` whose key is in ``counted`` (key, n: its number of rows), without bringing a hot key to one task."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    limit = max(HOT, total // HOT_KEYS)
    hot = F.broadcast(counted.where(F.col("n") > limit).select(*by))
    cold = counted.where(F.col("n") <= limit).select(*by)
    return rows.join(hot, list(by), "left_semi").unionByName(rows.join(hot, list(by), "left_anti").join(cold, list(by), "left_semi"))


class Windows:
    """The full windows of the texts of one chunk, and the parts that each chooses."""

    def __init__(self, texts: pa.Array, length: int):
        self.length = length
        self.words, self.first = word_hashes(texts, lower=False)
        self.n = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        count = max(0, len(self.words) - length + 1)
        self.start = np.flatnonzero(self.doc[:count] == self.doc[length - 1 :][:count])

    def hashes(self, k: int) -> np.ndarray:
        return window_hashes(self.words, k)

    def chosen(self, hashes: np.ndarray, k: int, start: np.ndarray) -> np.ndarray:
        """Place of the part of k words with the least hash in each full window that begins at ``start``."""
        out = np.empty(len(start), np.int64)
        if len(start):
            choice = np.lib.stride_tricks.sliding_window_view(hashes, self.length - k + 1)
            for a in range(0, len(start), 1 << 15):
                s = start[a : a + (1 << 15)]
                out[a : a + (1 << 15)] = choice[s].argmin(1) + s
        return out

    def wanted(self, k: int, sets: pa.Array) -> np.ndarray:
        """Of each full window, whether the part of k words that it chooses is in its text's set."""
        hashes = self.hashes(k)
        part = hashes[self.chosen(hashes, k, self.start)] if len(self.start) else np.zeros(0, np.uint64)
        edges = np.searchsorted(self.start, self.first)
        out = np.zeros(len(self.start), bool)
        for i, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if b > a:
                out[a:b] = np.isin(part[a:b], np.asarray(sets[i].values).view(np.uint64))
        return out

    def lists(self, places: np.ndarray, hashes: np.ndarray) -> list[pa.Array]:
        """Of each text: the distinct hashes at these places, and those that stand at two of them."""
        places = np.unique(places)
        values, doc = hashes[places].view(np.int64), self.doc[places]
        order = np.lexsort((values, doc))
        values, doc = values[order], doc[order]
        same = (values[1:] == values[:-1]) & (doc[1:] == doc[:-1])
        first = np.append(True, ~same)[: len(values)]
        again = first & np.append(same, False)[: len(values)]
        edges = np.arange(len(self.n) + 1)
        return [pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[keep], edges), pa.int32()), pa.array(values[keep], pa.int64())) for keep in (first, again)]


def _pieces(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high in chunks(batch.column(text)):
            yield batch.slice(low, high - low)


def _first_level(docs: DataFrame, length: int) -> DataFrame:
    """(id, n, s1, s2, sha, k1, k2, parts, again): words, hash of the word sequence, hash of the words joined by a
    space, distinct chosen parts, and those that the text has more than once."""
    k = -(-length // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _pieces(batches):
            texts = some.column(1)
            w = Windows(texts, length)
            s1, s2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            if len(w.words):
                local = np.arange(len(w.words)) - w.first[:-1][w.doc]
                up, _ = _powers(1 << max(21, len(w.words).bit_length()))
                some_words = np.flatnonzero(w.n)
                at = w.first[:-1][some_words]
                s1[some_words] = np.add.reduceat(w.words * up[local], at)
                s2[some_words] = np.add.reduceat(mix(w.words ^ mix(local.astype(np.uint64))), at)
            hashes = w.hashes(k)
            lists = w.lists(w.chosen(hashes, k, w.start), hashes)
            sha = [hashlib.sha256(b" ".join(t.encode().split())).hexdigest() if t else EMPTY for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(w.n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(sha), some.column(2), some.column(3), *lists], names=["id", "n", "s1", "s2", "sha", "k1", "k2", "parts", "again"])

    return docs.mapInArrow(run, "id long, n long, s1 long, s2 long, sha string, k1 long, k2 long, parts array<long>, again array<long>")


def _halves(candidates: DataFrame, length: int) -> DataFrame:
    """(tid, parts, again): halves that the full windows of candidates (tid, text, wanted) choose, if their part of level 1 is wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = -(-length // 2)
        for some in _pieces(batches):
            w = Windows(some.column("text"), length)
            middle = w.hashes(half)
            at = w.start[w.wanted(-(-length // 4), some.column("wanted"))]
            lists = w.lists(w.chosen(middle, half, at), middle)
            yield pa.RecordBatch.from_arrays([some.column("tid"), *lists], names=["tid", "parts", "again"])

    return candidates.select("tid", "text", "wanted").mapInArrow(run, "tid long, parts array<long>, again array<long>")


def _full_windows(candidates: DataFrame, length: int) -> DataFrame:
    """(tid, alone, starts, windows) of candidates (tid, text, alone, wanted, halves): full windows whose parts are wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _pieces(batches):
            w = Windows(some.column("text"), length)
            keep = w.wanted(-(-length // 4), some.column("wanted")) & w.wanted(-(-length // 2), some.column("halves"))
            at = w.start[keep]
            cuts = pa.array(np.searchsorted(at, w.first), pa.int32())
            starts = pa.ListArray.from_arrays(cuts, pa.array(at - w.first[:-1][w.doc[at]], pa.int32()))
            windows = pa.ListArray.from_arrays(cuts, pa.array(w.hashes(length)[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([some.column("tid"), some.column("alone"), starts, windows], names=["tid", "alone", "starts", "windows"])

    return candidates.select("tid", "alone", "text", "wanted", "halves").mapInArrow(run, "tid long, alone boolean, starts array<int>, windows array<long>")


def _without(found: DataFrame, length: int) -> DataFrame:
    """(tid, removed, kept_text, kept_sha) of (tid, text, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts"), strict=True):
                ws = text.encode().split()
                edge = np.zeros(len(ws) + 1, np.int64)
                at = np.asarray(starts.values)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                covered = np.cumsum(edge[:-1]) > 0
                kept = b" ".join(x for x, c in zip(ws, covered.tolist(), strict=True) if not c)
                out.append((int(covered.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
            removed, texts, shas = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(shas, pa.string())], names=["tid", "removed", "kept_text", "kept_sha"])

    return found.select("tid", "text", "starts").mapInArrow(run, "tid long, removed long, kept_text string, kept_sha string")


def text_keys(content: Column) -> tuple[Column, Column]:
    """128 bits of a text, as two hashes of different seeds; of a null text too."""
    return F.xxhash64(content), F.xxhash64(F.lit(LENGTH), content)


@dataclass(frozen=True)
class Found:
    """What is known of a table: a row each of ``rows`` (level 1); ``classes`` of equal texts (s1, s2, n, several, id, k1, k2);
    ``chosen``: first documents of classes that can share a window, with a number (tid, id, k1, k2, alone); their
    ``candidates`` (tid, alone, text); and ``windows`` of theirs that repeat (tid, alone, start, window), from the ``level``
    (tid, alone, starts, windows) and ``full`` (window, n). All but ``windows`` are checkpoints."""

    rows: DataFrame
    classes: DataFrame
    chosen: DataFrame
    candidates: DataFrame
    level: DataFrame
    full: DataFrame
    windows: DataFrame


def _repeated(lists: DataFrame, by: list[str], count: DataFrame) -> DataFrame:
    """(*by, wanted): of each row of ``lists`` (*by, parts), the parts that are in ``count``."""
    return _among(lists.select(*by, F.explode("parts").alias("part")), count, "part").groupBy(*by).agg(F.collect_set("part").alias("wanted"))


def find_repeats(docs: DataFrame, length: int, text: str, key: str) -> Found:
    content = F.col(f"`{text}`").cast("string")
    k1, k2 = text_keys(content)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), content.alias("text"), k1.alias("k1"), k2.alias("k2"))
    rows = cut_lineage(_first_level(source, length))
    long_ = rows.where(F.col("n") >= length)
    again = lambda of: of.select(F.explode("again").alias("part")).distinct().withColumn("twice", F.lit(True))
    # a part repeats if two different texts have it, or one has it twice; copies of a text count as one
    shared = long_.select("s1", F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("n"), F.min("s1").alias("a"), F.max("s1").alias("b"))
    counted = cut_lineage(shared.join(again(long_), "part", "left").where("a <> b or twice").select("part", "n"))
    wanted = _repeated(long_, ["k1", "k2"], counted)
    first = F.min(F.struct("id", "k1", "k2")).alias("rep")
    classes = cut_lineage(long_.groupBy("s1", "s2", "n").agg(F.count("*").alias("copies"), first).select("s1", "s2", "n", (F.col("copies") > 1).alias("several"), "rep.*"))
    reps = classes.select("id", "k1", "k2", (~F.col("several")).alias("alone"))
    listed = cut_lineage(reps.join(wanted, ["k1", "k2"]))
    chosen = listed.withColumn("tid", F.monotonically_increasing_id())
    forget(counted)
    # only texts that can share a window are shuffled
    near = source.join(small(chosen.select("k1").distinct(), FEW), "k1", "left_semi")
    same = (near["k1"] == chosen["k1"]) & (near["k2"] == chosen["k2"]) & near["id"].eqNullSafe(chosen["id"])
    candidates = cut_lineage(near.join(chosen, same).select("tid", "alone", near["text"], "wanted").dropDuplicates(["tid"]))
    halves = cut_lineage(_halves(candidates, length))
    counted = halves.select(F.explode("parts").alias("part")).groupBy("part").agg(F.count("*").alias("n"))
    counted = cut_lineage(counted.join(again(halves), "part", "left").where("n > 1 or twice").select("part", "n"))
    both = candidates.join(_repeated(halves, ["tid"], counted).select("tid", F.col("wanted").alias("halves")), "tid")
    level = cut_lineage(_full_windows(both, length))
    forget(halves, counted)
    pairs = F.inline(F.arrays_zip(F.col("starts").alias("start"), F.col("windows").alias("window")))
    full = cut_lineage(level.select(F.explode("windows").alias("window")).groupBy("window").agg(F.count("*").alias("n")).where("n > 1"))
    lean = cut_lineage(chosen.drop("wanted"))
    forget(listed)
    return Found(rows, classes, lean, candidates, level, full, _among(level.select("tid", "alone", pairs), full, "window"))


def _left(found: Found, length: int) -> DataFrame:
    """(tid, removed, kept_text, kept_sha) of single documents that lose words."""
    starts = found.windows.where("alone").groupBy("tid").agg(F.collect_list("start").alias("starts"))
    return _without(found.candidates.select("tid", "text").join(starts, "tid"), length)


def repeated_words(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of ``docs``; other columns are dropped.

    A word is removed if a window of ``length`` words that covers it also starts anywhere else, in this or another
    row. Null and empty texts, and those of fewer words than a window, lose nothing. Repeated rows are copies of
    each other and lose every word. A null doc_id stays null. An empty table gives no rows.
    """
    found = find_repeats(docs, length, text, key)
    left = cut_lineage(_left(found, length).join(found.chosen, "tid").select("k1", "k2", "removed", "kept_sha"))
    forget(found.chosen, found.candidates, found.level, found.full)
    of = found.classes.join(left, ["k1", "k2"], "left").where("several or removed is not null").select(*[F.col(c).alias(f"_{c}") for c in ("s1", "s2", "n")], "several", "removed", "kept_sha")
    same = (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")) & (F.col("n") == F.col("_n"))
    all_ = found.rows.select(F.col("id").alias("doc_id"), "n", "s1", "s2", "sha").join(of, same, "left")
    removed = F.when(F.col("several"), F.col("n")).otherwise(F.coalesce("removed", F.lit(0)))
    kept = F.when(F.col("several"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha", "sha"))
    return all_.select("doc_id", F.col("n").alias("n_words"), removed.cast("long").alias("n_removed"), kept.alias("kept_sha256"))


def longest_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, longest), a row for each document of ``length`` words and more that has a repeated window: the greatest of
    length, twice that, and so on at which it has one.

    A window of twice the length repeats only if both its halves do, so it is put together from two windows that repeat;
    levels go on until none is left. Copies repeat as a whole. Null and short texts have no row; repeated rows have one each.
    """
    found = find_repeats(docs, length, text, key)
    now, size, reached = cut_lineage(found.windows.select("tid", "start", "window")), length, []
    while now.head(1):
        reached.append(now.select("tid", F.lit(size).alias("longest")).distinct())
        next_ = now.select("tid", (F.col("start") - size).alias("start"), F.col("window").alias("follows"))
        joined = cut_lineage(now.join(next_, ["tid", "start"]).select("tid", "start", F.xxhash64("window", "follows").alias("window")))
        counted = cut_lineage(joined.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"))
        now, size = cut_lineage(_among(joined, counted, "window")), 2 * size
    none = found.chosen.select("tid", F.lit(0).alias("longest")).limit(0)
    most = reduce(DataFrame.unionByName, reached, none).groupBy("tid").agg(F.max("longest").alias("longest"))
    of = found.classes.join(most.join(found.chosen, "tid").select("k1", "k2", "longest"), ["k1", "k2"], "left").select("s1", "s2", "n", "several", "longest")
    whole = (length * F.pow(F.lit(2.0), F.floor(F.log2(F.col("n") / length)))).cast("int")
    all_ = found.rows.select(F.col("id").alias("doc_id"), "s1", "s2", "n").join(of, ["s1", "s2", "n"])
    return all_.select("doc_id", F.when(F.col("several"), whole).otherwise(F.col("longest")).alias("longest")).where("longest is not null")


def drop_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with repeated windows taken out of the texts; rows of which nothing is left go.

    Texts that lose words have one space between those left; all other texts stay as they are, null and empty ones too.
    Repeated rows of a window's length or more are copies of each other, so none of them is left.
    """
    found = find_repeats(docs, length, text, key)
    k1, k2, kept = fresh(docs, "k1", "k2", "kept_text")
    several = found.classes.where("several").select("s1", "s2", "n")
    whole = found.rows.select("s1", "s2", "n", "k1", "k2").join(several, ["s1", "s2", "n"]).select("k1", "k2", F.lit("").alias("kept_text")).distinct()
    left = _left(found, length).join(found.chosen, "tid").select("k1", "k2", "kept_text")
    fate = cut_lineage(whole.unionByName(left).toDF(k1, k2, kept))
    forget(found.rows, found.classes, found.chosen, found.candidates, found.level, found.full)
    a, b = text_keys(F.col(f"`{text}`").cast("string"))
    joined = docs.withColumns({k1: a, k2: b}).join(fate, [k1, k2], "left").where(F.coalesce(F.col(kept) != "", F.lit(True)))
    return joined.select(*[F.coalesce(F.col(kept), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
