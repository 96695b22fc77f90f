"""64-bit hashes of the words of many texts at once, by array operations over their bytes.

A word's hash is its polynomial value modulo 2**64 (differences of running sums, moved back to the word's
start), then mixed. The hashes are the same in every process.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are hashed at once; a longer text makes a chunk of its own.
CHUNK = 1 << 20

_white = np.zeros(256, bool)
_white[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, BASE, np.uint64), np.full(n, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    low, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > low and held + n > CHUNK:
            yield low, i
            low, held = i, 0
        held += n
    if low < len(lengths):
        yield low, len(lengths)


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, first word of each text and the number of words at the end). Null: no words."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    base, n = int(ends[0]), int(ends[-1] - ends[0])
    ends = ends - base
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[base : base + n]
    black = ~_white[raw]
    first = np.zeros(n + 1, bool)
    first[ends[:-1]] = True  # a text's first byte begins a word even after the text before
    first = first[:n]
    begins = black.copy()
    begins[1:] &= ~black[:-1] | first[1:]
    stops = np.ones(n, bool)
    stops[:-1] = ~black[1:] | first[1:]
    starts, stop = np.flatnonzero(begins), np.flatnonzero(stops & black) + 1
    size = max(CHUNK + 1, 1 << int(n).bit_length())
    up, down = _powers(size)
    values = (_lower[raw] if lower else raw).astype(np.uint64)
    values += np.uint64(1)
    values *= up[:n]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values, out=sums[1:])
    return mix((sums[stop] - sums[starts]) * down[starts]), np.searchsorted(starts, ends)


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words; runs may cross texts, and the caller leaves those out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, power = np.zeros(n, np.uint64), 1
    if k <= 8:
        for j in range(k):
            out += words[j : j + n] * np.uint64(power)
            power = power * BASE % (1 << 64)
        return mix(out)
    up, down = _powers(max(CHUNK + 1, 1 << len(words).bit_length()))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[:n])
