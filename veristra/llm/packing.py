"""Packing documents into windows of a fixed number of tokens.

A document's ids are cut into full windows and a rest, and that into pieces of at most ``PIECE_MOST``. These are
dealt at random into batches of about ``BATCH`` and packed batch by batch: Karmarkar-Karp differencing over as many windows as their tokens need
merges partial partitions with opposing imbalances, so that windows come out nearly equal; if the largest
exceeds the capacity, the count rises by one and the batch is packed again. A batch is bounded, so no task
depends on the size of the table, and a repeated document is only one more row.

Tokens come from a BPE file of the ``tokenizers`` library with white space between words dropped (normalised
by NFC and lower case, split into letter runs, digits and other runs). A batch of texts is reduced to its
different words and these to their different parts, whose ids a worker keeps in a bounded cache. New parts made of
Latin letters, digits and signs are encoded together by array operations that apply the merges in rank order, all
other words by the library itself.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage

WINDOW = 4096
END = 2
#: A rest is cut into pieces of at most so many tokens: small pieces even out, at the price of more cuts.
PIECE_MOST = 512
#: Pieces of rests a batch.
BATCH = 2048
#: Parts of words, and words of other signs, that a worker keeps, of some 200 bytes each.
CACHE = 600_000
#: Bytes of texts that are encoded together.
TOGETHER = 1 << 22
SPECIALS = "<|"
#: Kinds of signs: letters, digits, line ends between words, others.
LETTER, DIGIT, BREAK, OTHER = 1, 2, 3, 4


class Recent:
    """The ids of at most ``most`` keys: those used last, by halves."""

    def __init__(self, most: int):
        self.half, self.new, self.old = most // 2, {}, {}

    def of(self, keys: list, make: Callable[[list], list[bytes]]) -> list[bytes]:
        """Ids of different keys; ``make`` gives those of keys that are not held."""
        found = list(map(self.new.get, keys))
        rest = [k for k, x in zip(keys, found, strict=True) if x is None]
        if not rest:
            return found
        again = list(map(self.old.get, rest))
        missing = [k for k, x in zip(rest, again, strict=True) if x is None]
        if missing:
            made = iter(make(missing))
            again = [next(made) if x is None else x for x in again]
        if len(self.new) + len(rest) > self.half:
            self.new, self.old = {}, self.new
        # one batch alone may exceed the half
        self.new.update(zip(rest[: self.half], again))
        late = iter(again)
        return [next(late) if x is None else x for x in found]


def listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def spans(held: pa.LargeBinaryArray) -> np.ndarray:
    """Where each value begins in the data, and the end."""
    return np.frombuffer(held.buffers()[1], np.int64)[held.offset : held.offset + len(held) + 1]


def sliced(data: pa.Buffer | None, ends: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends, np.int64)), data or pa.py_buffer(b"")])


class WordEncoder:
    """Ids of texts, word by word."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        signs = self._byte_signs()
        self.plain = np.array([vocab[c] for c in signs], np.int64)
        self.final = np.array([vocab[c + suffix] for c in signs], np.int64)
        pairs = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        rank = np.arange(len(merges))
        # an open hash table of pairs: rank and id by probing
        self.bits = int(np.ceil(np.log2(len(merges)))) + 3
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, 1 << 30, np.int64)
        self.made = np.zeros(size, np.int64)
        left, at = np.arange(len(pairs)), self._slot(pairs)
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(at[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at[put]], self.ranks[at[put]], self.made[at[put]] = pairs[left[put]], rank[left[put]], made[left[put]]
            rest = np.setdiff1d(np.arange(len(left)), put)
            left, at = left[rest], (at[rest] + 1) % size
        # signs whose words are encoded here, and the kind of each sign that these have in lower case
        self.fast = np.zeros(0x251, bool)
        for low, high in ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0x24F)):
            self.fast[low : high + 1] = True
        lower = {c for x in np.flatnonzero(self.fast).tolist() for c in chr(x).lower()}
        self.kind = np.full(max(map(ord, lower)) + 1, OTHER, np.int8)
        for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}")):
            self.kind[[ord(c) for c in lower if regex.fullmatch(pattern, c)]] = kind
        self.fast[10], self.kind[10] = True, BREAK
        self.words, self.parts = Recent(CACHE // 4), Recent(CACHE - CACHE // 4)

    @staticmethod
    def _byte_signs() -> list[str]:
        """The printable sign of each byte in byte-level BPE files: itself, or the next unused code point from 256."""
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = iter(range(256, 512))
        return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (1 << 30 if none) and merged id of pairs."""
        pair = (a << 20) | b
        at = self._slot(pair)
        rank, made = np.full(len(pair), 1 << 30, np.int64), np.zeros(len(pair), np.int64)
        todo = np.arange(len(pair))
        while len(todo):
            found = self.keys[at] == pair[todo]
            rank[todo[found]], made[todo[found]] = self.ranks[at[found]], self.made[at[found]]
            on = ~found & (self.keys[at] != -1)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return rank, made

    def _merge(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts of like length: in each round, every part merges its leftmost pair of lowest rank."""
        n, lengths = len(parts), np.array([len(p) for p in parts])
        width = int(lengths.max())
        filled = np.arange(width)[None, :] < lengths[:, None]
        raw = np.zeros((n, width), np.int64)
        raw[filled] = np.frombuffer(b"".join(parts), np.uint8)
        ids = np.where(filled, self.plain[raw], -1)
        ids[np.arange(n), lengths - 1] = self.final[raw[np.arange(n), lengths - 1]]
        rank = np.full((n, width), 1 << 30, np.int32)
        made = np.zeros((n, width), np.int32)
        pairs = filled[:, 1:]
        if width > 1:
            rank[:, :-1][pairs], made[:, :-1][pairs] = self._lookup(ids[:, :-1][pairs], ids[:, 1:][pairs])
        ids = ids.astype(np.int32)
        out: list[bytes] = [b""] * n
        rows = np.arange(n)
        while True:
            at = rank.argmin(1)
            live = rank[np.arange(len(rows)), at] < 1 << 30
            done = np.flatnonzero(~live)
            if len(done):
                held, step = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for i, (row, size) in enumerate(zip(rows[done].tolist(), lengths[done].tolist(), strict=True)):
                    out[row] = held[i * step : i * step + 4 * size]
            if not live.any():
                return out
            rows, lengths, at = rows[live], lengths[live] - 1, at[live]
            ids, rank, made = ids[live], rank[live], made[live]
            line = np.arange(len(rows))
            ids[line, at] = made[line, at]
            # close the gap after the merged pair
            later = np.arange(ids.shape[1] - 1)[None, :] > at[:, None]
            for m in (ids, rank, made):
                np.copyto(m[:, :-1], m[:, 1:].copy(), where=later)
            rank[line, lengths - 1] = 1 << 30
            for shift in (-1, 0):
                k = at + shift
                ok = (k >= 0) & (k + 1 < lengths)
                if ok.any():
                    l, k = line[ok], k[ok]
                    rank[l, k], made[l, k] = self._lookup(ids[l, k].astype(np.int64), ids[l, k + 1].astype(np.int64))
            width = int(lengths.max())
            if width < ids.shape[1]:
                ids, rank, made = ids[:, :width], rank[:, :width], made[:, :width]

    def _library(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(words, add_special_tokens=False)]

    def _new_parts(self, parts: list[bytes]) -> list[bytes]:
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(lengths, kind="stable")
        out: list[bytes] = [b""] * len(parts)
        like = (lengths[order] + 3) // 4
        for same in np.split(order, np.flatnonzero(np.diff(like)) + 1):
            step = max(1, (1 << 20) // int(lengths[same[-1]]))
            for low in range(0, len(same), step):
                some = same[low : low + step].tolist()
                for i, ids in zip(some, self._merge([parts[i] for i in some]), strict=True):
                    out[i] = ids
        return out

    def _starts(self, codes: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """Where parts begin: contractions such as 's, runs of letters, single digits, runs of other signs; line ends part words."""
        begins = np.ones(len(codes), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | (kind[1:] == BREAK)
        quotes = np.flatnonzero((codes == ord("'")) & begins)
        if len(quotes):
            # a line end is last, so that two signs follow each quote or their place doesn't matter
            one, two = codes[quotes + 1], codes[np.minimum(quotes + 2, len(codes) - 1)]
            size = np.where(np.isin(one, [ord(c) for c in "stmd"]), 2, 0)
            for a, b in ("re", "ve", "ll"):
                size[(one == ord(a)) & (two == ord(b))] = 3
            quotes, size = quotes[size > 0], size[size > 0]
            begins[quotes + 1] = False
            begins[quotes + size] = True
        return np.flatnonzero(begins)

    def _even(self, words: list[str]) -> pa.LargeBinaryArray:
        """Ids of words of Latin letters, digits and signs."""
        text = "\n".join(words).lower() + "\n"
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.kind[codes]
        at = self._starts(codes, kind)
        ends = np.append(at, len(codes))
        if not text.isascii():
            ends = np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800))])[ends]
        parts = sliced(pa.py_buffer(text.encode()), ends).dictionary_encode()
        held = self.parts.of(listed(parts.dictionary), lambda new: [b"" if p == b"\n" else x for p, x in zip(new, self._new_parts(new), strict=True)])
        ids = pa.array(held, pa.large_binary()).take(parts.indices)
        return sliced(ids.buffers()[2], spans(ids)[np.concatenate([[0], np.flatnonzero(kind[at] == BREAK)])])

    def _of_words(self, words: list[str]) -> pa.LargeBinaryArray:
        """Ids of different words without white space of ASCII."""
        text = "\n".join(words)
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
        strange = np.flatnonzero(~self.fast[np.minimum(codes, len(self.fast) - 1)])
        if not len(strange):
            return self._even(words)
        odd = np.unique(np.searchsorted(np.flatnonzero(codes == 10), strange))
        even = np.delete(np.arange(len(words)), odd)
        held = pa.array(self.words.of([words[i] for i in odd.tolist()], self._library), pa.large_binary())
        if len(even):
            held = pa.concat_arrays([held, self._even([words[i] for i in even.tolist()])])
        return held.take(pa.array(np.argsort(np.concatenate([odd, even]))))

    def _together(self, texts: pa.LargeStringArray) -> list[bytes]:
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        ids = self._of_words(listed(words.dictionary)).take(words.indices)
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False))])
        return listed(sliced(ids.buffers()[2], spans(ids)[ends]))

    def encode(self, texts: list[str | None] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        # signs of special tokens may be part of one
        whole = pc.fill_null(pc.match_substring(texts, SPECIALS), False).to_numpy(zero_copy_only=False)
        # taken, not masked: if_else of pyarrow 23 mixes up the texts of a cast slice
        parted = texts.take(pa.array(np.flatnonzero(~whole))).cast(pa.large_string())
        sizes = pc.fill_null(pc.binary_length(parted), 0).to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero(np.diff(np.cumsum(sizes) // TOGETHER)) + 1).tolist()
        found = (x for low, high in zip([0, *cuts], [*cuts, len(parted)], strict=True) for x in self._together(parted.slice(low, high - low)))
        return [self._library([texts[i].as_py()])[0] if odd else next(found) for i, odd in enumerate(whole.tolist())]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def karmarkar_karp(sizes: np.ndarray, windows: int) -> np.ndarray:
    """Window of each size. Partial partitions are lists of loads; the two of largest spread merge, heavy to light.

    Loads are kept sorted and less their least, so merging adds one list to the other reversed. Members of a
    window are chained: each merge joins the chains of the two windows that it adds.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    follow = np.full(n, -1, np.int64)
    loads: list[np.ndarray] = []
    heads: list[np.ndarray] = []
    tails: list[np.ndarray] = []
    heap = []
    for i, size in enumerate(sizes):
        load = np.zeros(windows, np.int64)
        load[-1] = size
        chain = np.full(windows, -1, np.int64)
        chain[-1] = i
        loads.append(load)
        heads.append(chain)
        tails.append(chain.copy())
        heap.append((-int(size), i))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        load = loads[a] + loads[b][::-1]
        head_a, tail_a, head_b, tail_b = heads[a], tails[a], heads[b][::-1], tails[b][::-1]
        both = (head_a >= 0) & (head_b >= 0)
        follow[tail_a[both]] = head_b[both]
        head = np.where(head_a >= 0, head_a, head_b)
        tail = np.where(head_b >= 0, tail_b, tail_a)
        order = np.argsort(load, kind="stable")
        loads[a] = load[order] - load[order[0]]
        heads[a], tails[a] = head[order], tail[order]
        loads[b] = heads[b] = tails[b] = None
        heapq.heappush(heap, (-int(loads[a][-1]), a))
    out = np.zeros(n, np.int64)
    for k, i in enumerate(heads[heap[0][1]]):
        while i >= 0:
            out[i] = k
            i = follow[i]
    return out


def pack_rests(sizes: np.ndarray, window: int) -> np.ndarray:
    """Window of each rest; the window count rises until the largest load fits."""
    windows = max(1, -(-int(sizes.sum()) // window))
    while True:
        at = karmarkar_karp(sizes, windows)
        if np.bincount(at, sizes).max(initial=0) <= window:
            return at
        windows += 1


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, batch long, part long"


def pack_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW, batch: int = BATCH, most: int = PIECE_MOST, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), a row a piece; with ``ids`` the ids too.

    Each document ends with id 2; a null or empty text is that id alone. A null key stays null. Repeated rows
    are packed as often as they occur; other columns are dropped. An empty table gives no rows. Sequence ids
    are unique, not consecutive: batch number times 2^24 plus the window in the batch.
    """
    schema = PIECE + (", ids binary" if ids else "")
    end = np.array([END], "<u4").tobytes()
    names = [x.split()[0] for x in schema.split(", ")]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for got in batches:
            for low in range(0, got.num_rows, 512):
                some = got.slice(low, 512)
                rows: list[tuple] = []
                for doc, raw in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    raw += end
                    total = len(raw) // 4
                    whole = total - total % window
                    for part, start in enumerate((*range(0, whole, window), *range(whole, total, most))):
                        piece = raw[4 * start : 4 * min(total, start + (window if start < whole else most))]
                        rows.append((doc, start, len(piece) // 4, zlib.crc32(piece), total, 0, part, *([piece] if ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    cut = cut_lineage(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(pieces, schema))
    full, rests = cut.where(F.col("length") == window), cut.where(F.col("length") < window)
    batches = max(1, round(rests.count() / batch))
    # dealt by hash, salted with the row's place so that copies of one document part
    dealt = rests.withColumn("batch", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(batches)))

    def packed(_: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_numpy()
        at = pack_rests(sizes, window)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.searchsorted(at[order], at[order])
        before = np.where(first > 0, ends[first - 1], 0)
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - before
        sequence = (table.column("batch").to_numpy() << 24) + at
        return table.drop_columns(["batch", "part"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    out = schema.replace("batch long, part long", "") + ", sequence_id long, offset long"
    out = ", ".join(x.strip() for x in out.split(",") if x.strip())
    small = dealt.groupBy("batch").applyInArrow(packed, out)
    # full windows stand alone, numbered by place after all batches
    alone = full.withColumn("sequence_id", F.shiftleft(F.lit(batches).cast("long"), 24) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).drop("batch", "part")
    return small.unionByName(alone)
