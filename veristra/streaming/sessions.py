"""State machines of sessions: each is a fold over ordered events, run as a stream or over a batch.

``Machine`` holds the rule; ``stream`` runs it with state in Spark's state store, ``batch`` over sorted groups. A
session's events are few, so a group in one task is bounded by the session.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veristra.config import SETTINGS

Step = Callable[[dict, dict], tuple[dict, dict | None]]


def stability(state: dict, event: dict) -> tuple[dict, dict | None]:
    """Emit a partial whose form repeats or stays for long enough, never the same form twice in a row.

    event: form (normalised text), text, at_ns. Short forms clear the candidate. Generations count up.
    """
    form, now = event["form"], event["at_ns"]
    if len(form) < SETTINGS.stable_characters:
        return state | {"form": None, "n": 0}, None
    same = state.get("form") == form
    since, n = (state["since"], state["n"] + 1) if same else (now, 1)
    state = state | {"form": form, "since": since, "n": n}
    settled = n >= SETTINGS.stable_events or now - since >= SETTINGS.stable_ms * 1_000_000
    if not settled or state.get("emitted") == form:
        return state, None
    generation = state.get("generation", 0) + 1
    return state | {"emitted": form, "generation": generation}, {"generation": generation, "text": event["text"].strip(), "accepted_ns": now, "events": n}


def breaker(state: dict, event: dict) -> tuple[dict, dict | None]:
    """Circuit state after each call. event: ok, at_s. Calls within the recovery time of an open circuit are refused."""
    kind, fails = state.get("state", "closed"), state.get("fails", 0)
    if kind == "open":
        if event["at_s"] - state["opened"] < SETTINGS.recovery_seconds:
            return state, {"state": "open", "refused": True}
        kind = "half_open"
    if event["ok"]:
        return {"state": "closed", "fails": 0}, {"state": "closed", "refused": False}
    fails += 1
    if kind == "half_open" or fails >= SETTINGS.failures:
        return {"state": "open", "fails": fails, "opened": event["at_s"]}, {"state": "open", "refused": False}
    return {"state": kind, "fails": fails}, {"state": kind, "refused": False}


def contiguous(state: dict, event: dict) -> tuple[dict, dict | None]:
    """Audio in order from 0, of even byte counts, up to 60 s. event: sequence, size."""
    due, total = state.get("due", 0), state.get("bytes", 0) + event["size"]
    fault = "out_of_order" if event["sequence"] != due else "odd_bytes" if event["size"] % 2 else "too_long" if total > 60 * 32_000 else None
    return {"due": due + 1, "bytes": total}, {"sequence": event["sequence"], "fault": fault}


def silence(state: dict, event: dict) -> tuple[dict, dict | None]:
    """Stop once speech of two chunks over 0.06 is followed by 1.5 s of silence, at least 1.2 s in. event: level, at_ms."""
    loud = event["level"] > 0.06
    heard = state.get("heard", 0) + 1 if loud else state.get("heard", 0)
    begun = state.get("begun", event["at_ms"])
    last = event["at_ms"] if loud else state.get("last", event["at_ms"])
    stop = heard >= 2 and not loud and event["at_ms"] - last >= 1500 and event["at_ms"] - begun >= 1200
    return {"heard": heard, "begun": begun, "last": last}, {"at_ms": event["at_ms"]} if stop and not state.get("stopped") else None


def one_use(state: dict, event: dict) -> tuple[dict, dict | None]:
    """Tokens that can be used once within their time. event: kind (put or take), token, at_s. At most 256, oldest out first."""
    held = {k: t for k, t in state.get("held", {}).items() if event["at_s"] - t < SETTINGS.ttl_seconds}
    if event["kind"] == "put":
        held[event["token"]] = event["at_s"]
        while len(held) > 256:
            held.pop(next(iter(held)))
        return {"held": held}, None
    found = held.pop(event["token"], None) is not None
    return {"held": held}, {"token": event["token"], "redeemed": found}


def _fold(step: Step, state: dict, rows: list[dict], key: str, name: object, columns: list[str]) -> tuple[dict, pd.DataFrame]:
    out = []
    for row in rows:
        state, emitted = step(state, row)
        if emitted is not None:
            out.append({key: name, **emitted})
    return state, pd.DataFrame(out, columns=columns)


def batch(events: DataFrame, step: Step, key: str, order: list[str], schema: str) -> DataFrame:
    """Emissions of every session of a finished table. schema: key first, then what the step emits."""
    columns = [c.split()[0] for c in schema.split(",")]

    def run(name: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(order, kind="stable").to_dict("records")
        return _fold(step, {}, rows, key, name[0], columns)[1]

    return events.groupBy(key).applyInPandas(run, schema)


def stream(events: DataFrame, step: Step, key: str, order: list[str], schema: str, idle: int = SETTINGS.idle_seconds) -> DataFrame:
    """The same over a stream; state is dropped after ``idle`` seconds of processing time without events."""
    columns = [c.split()[0] for c in schema.split(",")]

    def run(name: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        parts = list(groups)
        rows = pd.concat(parts).sort_values(order, kind="stable").to_dict("records") if parts else []
        held, out = _fold(step, held, rows, key, name[0], columns)
        state.update((json.dumps(held),))
        state.setTimeoutDuration(idle * 1000)
        yield out

    return events.groupBy(key).applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def speculative_reuse(finals: DataFrame, stable: DataFrame) -> DataFrame:
    """(session, reuse): whether the final text may take the result of the session's newest stable partial.

    finals: session, form. stable: session, generation, form. The forms must be equal, which the similarity bound implies.
    """
    from veristra.functions.text import edit_similarity

    newest = stable.groupBy("session").agg(F.max_by("form", "generation").alias("last"))
    like = edit_similarity(F.col("form"), F.col("last"))
    return finals.join(newest, "session", "left").select("session", F.coalesce((F.col("form") == F.col("last")) & (like >= SETTINGS.reuse_similarity), F.lit(False)).alias("reuse"))


def final_text(events: DataFrame) -> DataFrame:
    """(session, text, language): final pieces in order, joined by a space, and the last known language."""
    finals = events.where((F.col("event_type") == "final") & (F.trim("text") != ""))
    known = F.col("language").isNotNull() & (F.col("language") != "unknown")
    return finals.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("received_ns", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"), F.max_by(F.when(known, F.col("language")), F.when(known, F.col("received_ns"))).alias("language"))


def rolling_latency(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and averages by type and tumbling window; late rows are dropped beyond the watermark when streaming."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def session_windows(events: DataFrame, key: str = "user_id", idle: int = SETTINGS.idle_seconds) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", "10 minutes") if events.isStreaming else timed
    return timed.groupBy(key, F.session_window("ts", f"{idle} seconds").alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
