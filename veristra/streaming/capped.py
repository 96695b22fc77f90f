"""Sessions that end after a silence or at a longest length, as a stream with event-time timers and over finished tables.

An event belongs to the running session until ``end_of`` it; the next event after that starts a new one. In a stream,
events wait in state until the watermark has passed them, and are then taken in order, so the order of arrival doesn't
matter. What arrives behind the watermark changes no session and comes out as a row of kind ``late``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veristra.config import SETTINGS

SECOND = 1_000_000
SESSION = ["start_us", "end_us", "n", "reason"]


def end_of(start: int, last: int, idle: int, longest: int) -> tuple[int, str]:
    """When a session ends, in microseconds, and why; a silence that ends with the longest length counts as silence."""
    return (start + longest, "longest") if start + longest < last + idle else (last + idle, "idle")


def take(session: tuple[int, int, int] | None, at: int, idle: int, longest: int) -> tuple[tuple[int, int, int], tuple[int, int, int, str] | None]:
    """The running session (start, last, n) with the next event in order, and the session that it closes."""
    if session is None:
        return (at, at, 1), None
    start, last, n = session
    end, reason = end_of(start, last, idle, longest)
    return ((start, at, n + 1), None) if at < end else ((at, at, 1), (start, end, n, reason))


def capped_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", idle: int = SETTINGS.idle_seconds, longest: int = SETTINGS.longest_seconds) -> DataFrame:
    """(<key>, start_us, end_us, n, reason) of a finished table; a null key is one of its own, rows without a time are left out.

    Silences part a key's events by window functions; only within such a run does the cap need events in order. Runs are
    dealt to tasks and sorted there, and a task reads through them with one session in mind, however long they are.
    """
    idle_us, longest_us = idle * SECOND, longest * SECOND
    timed = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("__key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    by = W.partitionBy("__key").orderBy("at")
    gap = F.coalesce(F.col("at") - F.lag("at").over(by) >= idle_us, F.lit(True))
    runs = timed.withColumn("new", gap.cast("long")).withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    kind = events.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, session = None, None

        def rows(found: list[tuple], arrow_type: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow_type), *[pa.array(c, pa.int64()) for c in columns[1:4]], pa.array(columns[4], pa.string())], names=["__key", *SESSION])

        arrow_type = pa.null()
        for batch in batches:
            arrow_type, out = batch.schema.field("__key").type, []
            for name, run, at in zip(*(batch.column(c).to_pylist() for c in ("__key", "run", "at")), strict=True):
                if here != (name, run):
                    if session is not None:
                        out.append((here[0], session[0], *end_of(session[0], session[1], idle_us, longest_us)[:1], session[2], end_of(session[0], session[1], idle_us, longest_us)[1]))
                    here, session = (name, run), None
                session, closed = take(session, at, idle_us, longest_us)
                if closed is not None:
                    out.append((name, *closed))
            yield rows(out, arrow_type)
        if session is not None:
            end, reason = end_of(session[0], session[1], idle_us, longest_us)
            yield rows([(here[0], session[0], end, session[2], reason)], arrow_type)

    dealt = runs.select("__key", "run", "at").repartition("__key", "run").sortWithinPartitions("__key", "run", "at")
    return dealt.mapInArrow(read, f"__key {kind}, start_us long, end_us long, n long, reason string").withColumnRenamed("__key", key)


#: Events that are put into state together, as one value.
PACK = 1 << 16
REASONS = ("idle", "longest", "behind the watermark")
LATE = len(REASONS) - 1


class CappedSessions(StatefulProcessor):
    """State of a key: events that the watermark hasn't passed, and the running session. One timer a key is due at a time or more.

    What a key costs is calls to the state store, values of state and cells of frames, far more than bytes. So up to
    ``PACK`` events go into state as one binary value, and what is found comes out as one list of numbers, four a session.
    """

    def __init__(self, key: str, idle: int, longest: int):
        self.key, self.idle, self.longest = key, idle, longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", "start long, last long, n long")
        self.pending = handle.getListState("pending", "at binary")

    def found(self, key: tuple, cells: list[int]) -> pd.DataFrame:
        return pd.DataFrame({self.key: [key[0]], "cells": [cells]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held, size, first = [], 0, None
        for frame in rows:
            at = frame["at"].to_numpy(np.int64)
            late, waiting = at[at <= passed], at[at > passed]
            if len(waiting):
                held.append(waiting)
                size += len(waiting)
                first = int(waiting.min()) if first is None else min(first, int(waiting.min()))
            if size >= PACK:
                self.pending.appendValue((np.concatenate(held).tobytes(),))
                held, size = [], 0
            if len(late):
                yield self.found(key, [x for t in np.sort(late).tolist() for x in (t, t, 1, LATE)])
        if held:
            self.pending.appendValue((np.concatenate(held).tobytes(),))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[0], np.int64) for r in self.pending.get())]))
        cut = int(np.searchsorted(waiting, passed, "right"))
        ready, waiting = waiting[:cut], waiting[cut:]
        before = self.session.get()
        session = before = None if before is None else tuple(int(x) for x in before)
        out = []
        for low in range(0, len(ready), PACK):
            if out:
                yield self.found(key, out)
                out = []
            for at in ready[low : low + PACK].tolist():
                session, closed = take(session, at, self.idle, self.longest)
                if closed is not None:
                    out += (*closed[:3], REASONS.index(closed[3]))
        if session is not None:
            end, reason = end_of(session[0], session[1], self.idle, self.longest)
            if end <= passed:
                out += (session[0], end, session[2], REASONS.index(reason))
                session = None
            else:
                self.handle.registerTimer(-(-end // 1000))
        if len(ready):
            if len(waiting):
                self.pending.put([(waiting[low : low + PACK].tobytes(),) for low in range(0, len(waiting), PACK)])
                self.handle.registerTimer(-(-int(waiting[0]) // 1000))
            else:
                self.pending.clear()
        if session is not None:
            self.session.update(session)
        elif before is not None:
            self.session.clear()
        if out:
            yield self.found(key, out)

    def close(self) -> None:
        pass


def stream_capped_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", idle: int = SETTINGS.idle_seconds, longest: int = SETTINGS.longest_seconds, late: str = "10 minutes") -> DataFrame:
    """(<key>, kind, start_us, end_us, n, reason) of a stream: closed sessions, and rows that came too late.

    Needs the RocksDB state store. A session comes out once the watermark, ``late`` behind the newest event, passes its end.
    """
    timed = events.where(F.col(ts).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    kind = events.schema[key].dataType.simpleString()
    # only the number goes on, so that Spark doesn't drop late rows before they are told
    rows = timed.select(key, F.unix_micros(ts).alias("at"))
    found = rows.groupBy(key).transformWithStateInPandas(CappedSessions(key, idle * SECOND, longest * SECOND), f"{key} {kind}, cells array<long>", "Append", "EventTime")
    cell = lambda i: F.get("cells", F.col("__i") + i)
    each = found.withColumn("__i", F.explode(F.sequence(F.lit(0), F.size("cells") - 1, F.lit(len(SESSION)))))
    named = F.get(F.array(*map(F.lit, REASONS)), cell(3).cast("int"))
    return each.select(key, F.when(cell(3) == LATE, "late").otherwise("session").alias("kind"), cell(0).alias("start_us"), cell(1).alias("end_us"), cell(2).alias("n"), named.alias("reason"))
