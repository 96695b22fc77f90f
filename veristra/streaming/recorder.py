"""The newest samples of each timing in a ring of bounded size, and their summary after every trigger."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veristra.operators.latency import last_samples, summary

KEPT = 10_000
PERCENTS = (50, 70, 95)


def rank(n: int, percent: int) -> int:
    """0-based place of a nearest-rank percentile."""
    return max(1, -(-percent * n // 100)) - 1


class Ring(StatefulProcessor):
    """A key's samples under the numbers 0 to kept - 1, and how many came in all; sample i stands at i modulo kept."""

    def __init__(self, key: str, kept: int):
        self.key, self.kept = key, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.came = handle.getValueState("came", "n long")
        self.slots = handle.getMapState("slots", "slot int", "value double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = int(self.came.get()[0]) if self.came.exists() else 0
        # of the new samples only the last ``kept`` are ever seen, and no more are held
        n, new = before, pd.DataFrame({"at": [], "tie": [], "value": []})
        for part in rows:
            n += len(part)
            part = part[["at", "tie", "value"]]
            new = (pd.concat([new, part]) if len(new) else part).sort_values(["at", "tie"], kind="stable").tail(self.kept)
        for i, value in enumerate(new["value"].tolist(), n - len(new)):
            self.slots.updateValue((i % self.kept,), (float(value),))
        self.came.update((n,))
        held = sorted(v[0] for v in self.slots.values())
        found = [held[rank(len(held), p)] for p in PERCENTS]
        yield pd.DataFrame([(key[0], n, len(held), *found, held[-1], sum(held) / len(held))], columns=[self.key, "came", "samples", "p50", "p70", "p95", "p100", "mean"])

    def close(self) -> None:
        pass


def stream_summaries(events: DataFrame, key: str, value: str, ts: str, tie: str, kept: int = KEPT) -> DataFrame:
    """(<key>, came, samples, p50, p70, p95, p100, mean) of each timing that a trigger has samples of, newest first by arrival.

    Within a trigger samples go by ts and tie. Missing values are no samples. Needs the RocksDB state store and the
    output mode ``update``; the newest row of a key is its summary.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.where(F.col(value).isNotNull() & ~F.isnan(value)).select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"), F.col(value).cast("double").alias("value"))
    return rows.groupBy(key).transformWithStateInPandas(Ring(key, kept), f"{key} {kind}, came long, samples long, p50 double, p70 double, p95 double, p100 double, mean double", "Update", "None")


def summaries(events: DataFrame, key: str, value: str, ts: str, tie: str, kept: int = KEPT) -> DataFrame:
    """The same of a finished table, all samples in order of ts and tie."""
    rows = events.where(F.col(value).isNotNull() & ~F.isnan(value))
    newest = last_samples(rows, key, [F.col(ts).desc(), F.col(tie).desc()], kept)
    came = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("came"))
    found = newest.groupBy(key).agg(*summary(value))
    return found.join(came, F.col(key).eqNullSafe(F.col("__key"))).select(key, "came", "samples", "p50", "p70", "p95", "p100", "mean")
