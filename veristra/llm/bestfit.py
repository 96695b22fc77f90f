"""Best-fit packing under several capacities at once.

A piece asks for tokens, for one of a sequence's places for documents, and for attention, the square of its length (as
pieces don't look at each other). In batches, pieces are taken from the largest, and each goes into the open sequence
that can hold it in every respect and fits it best: the one left with the least weighted norm, or the one whose residual
has the largest weighted dot product with what the piece asks for. Where none can, a new one opens.

Documents are cut only where they exceed a sequence. Batches are bounded and dealt at random; sequences that a round
leaves with much room are opened again and their pieces dealt to the next round's fewer batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage
from veristra.llm.packing import encoder

END = 0


class Capacities(NamedTuple):
    """What a sequence holds: tokens, documents, and squared lengths; by default only the tokens can run out."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


#: How much each residual counts, as a share of its capacity.
WEIGHTS = (1.0, 0.05, 0.05)
#: Pieces a batch.
BATCH = 2048
#: Rounds, and the share of a sequence's tokens that may stay free before it is opened again in the next one.
ROUNDS, SLACK = 3, 1 / 128


def demands(lengths: np.ndarray) -> np.ndarray:
    lengths = lengths.astype(np.int64)
    return np.stack([lengths, np.ones_like(lengths), lengths * lengths], 1)


def best_fit(lengths: np.ndarray, capacities: Capacities = Capacities(), weights: tuple[float, ...] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """Sequence of each piece; lengths in descending order. No piece may exceed a capacity alone. Ties go to the sequence opened first."""
    limits, asks = np.array(capacities, np.int64), demands(lengths)
    scale = np.array(weights) / limits
    room = np.zeros((len(lengths), 3), np.int64)
    at, opened, first = np.zeros(len(lengths), np.int64), 0, 0
    least = asks.min(0, initial=1 << 62)
    for i, ask in enumerate(asks):
        # sequences that can hold no piece at all drop out from the front
        while first < opened and (room[first] < least).any():
            first += 1
        free = room[first:opened]
        fits = np.flatnonzero((free >= ask).all(1))
        if not len(fits):
            room[opened] = limits - ask
            at[i], opened = opened, opened + 1
            continue
        if rule == "norm":
            left = (free[fits] - ask) * scale
            chosen = fits[np.argmin((left * left).sum(1))]
        else:
            chosen = fits[np.argmax(((free[fits] * scale) * (ask * scale)).sum(1))]
        at[i] = first + chosen
        room[first + chosen] -= ask
    return at


def piece_most(capacities: Capacities) -> int:
    """The longest piece that an empty sequence can hold."""
    most = min(capacities.tokens, int(np.sqrt(capacities.attention)))
    if most < 1 or capacities.documents < 1:
        raise ValueError("a sequence must hold a piece of one token at least")
    return most


PIECE = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(), "ids": pa.binary()}
DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}


def cut_pieces(docs: DataFrame, tokenizer: str, most: int, end: int = END, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the ids of each text and an end id, in pieces of ``most`` and a rest."""
    last = np.array([end], "<u4").tobytes()
    fields = {n: t for n, t in PIECE.items() if ids or n != "ids"}

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for got in batches:
            for low in range(0, got.num_rows, 512):
                some = got.slice(low, 512)
                rows: list[tuple] = []
                for doc, raw in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    raw += last
                    for number, start in enumerate(range(0, len(raw) // 4, most)):
                        piece = raw[4 * start : 4 * (start + most)]
                        rows.append((doc, number, start, len(piece) // 4, zlib.crc32(piece), piece)[: len(fields)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), fields.values(), strict=True)], names=list(fields))

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(pieces, ", ".join(f"{n} {DDL[t]}" for n, t in fields.items()))


def pack_pieces(pieces: DataFrame, capacities: Capacities = Capacities(), weights: tuple[float, ...] = WEIGHTS, rule: str = "norm", batch: int = BATCH, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """``pieces`` (doc_id, start, length, ids_crc32, any others) with sequence_id and offset.

    pieces must be cut off from their lineage: places in it salt the dealing, so that copies of one piece part. Pieces
    that leave less room than one token has a sequence each. Every round but the last opens sequences with more than
    ``slack`` of their tokens free again, so only the last one's few batches leave an ill-filled sequence each.
    """
    most, many = piece_most(capacities), 1 << 24
    if batch > many:
        raise ValueError(f"a batch may have {many} pieces")
    names = pieces.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long, free long"

    def packed(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = table.column("length").to_numpy()
        at = best_fit(sizes, capacities, weights, rule)
        order = np.argsort(at, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.searchsorted(at[order], at[order])
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - np.where(first > 0, ends[first - 1], 0)
        free = capacities.tokens - np.bincount(at, sizes)[at].astype(np.int64)
        return table.select(names).append_column("sequence_id", pa.array(key[0].as_py() * many + at)).append_column("offset", pa.array(offset)).append_column("free", pa.array(free))

    whole = F.col("length") == most
    done = [pieces.where(whole).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    rest = pieces.where(~whole)
    numbered = 0
    for turn in range(rounds):
        batches = max(1, round(rest.count() / batch))
        number = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(batches)) + numbered
        got = rest.withColumn("__batch", number).groupBy("__batch").applyInArrow(packed, schema)
        if turn + 1 < rounds and batches > 1:
            got = cut_lineage(got)
            rest = got.where(F.col("free") > slack * capacities.tokens).select(*names)
            done.append(got.where(F.col("free") <= slack * capacities.tokens).drop("free"))
            numbered += batches
        else:
            done.append(got.drop("free"))
            break
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def pack_best_fit(docs: DataFrame, tokenizer: str, capacities: Capacities = Capacities(), weights: tuple[float, ...] = WEIGHTS, rule: str = "norm", end: int = END, text: str = "text", key: str = "doc_id", ids: bool = False, batch: int = BATCH, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece; with ``ids`` the ids too.

    A null or empty text is its end id alone. A null key stays null. Repeated rows are packed as often as they occur;
    other columns are dropped. An empty table gives no rows. Sequence ids are unique, not consecutive.
    """
    cut = cut_lineage(cut_pieces(docs, tokenizer, piece_most(capacities), end, text, key, ids))
    return pack_pieces(cut, capacities, weights, rule, batch, rounds)
