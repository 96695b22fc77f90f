"""Capped sessions and exactly-once tables: out-of-order and late rows over several triggers, and a stream that dies and starts again."""

import datetime
import random

import pytest

from veristra.plans import streams
from veristra.streaming import capped, recorder, upsert

SCHEMA = "event_id long, user_id string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


def plain(rows, idle, longest):
    """Sessions of (user, seconds) one after the other."""
    out, open_ = [], {}
    for user, t in sorted(rows, key=lambda r: r[1]):
        if user in open_ and t < min(open_[user][1] + idle, open_[user][0] + longest):
            open_[user] = (open_[user][0], t, open_[user][2] + 1)
            continue
        if user in open_:
            out.append((user, *open_[user]))
        open_[user] = (t, t, 1)
    out += [(u, *s) for u, s in open_.items()]
    return sorted(((u, round(s * 1e6), round(min(e + idle, s + longest) * 1e6), n, "longest" if s + longest < e + idle else "idle") for u, s, e, n in out), key=repr)


def relative(rows):
    base = int(START.replace(tzinfo=datetime.UTC).timestamp()) * 10**6
    return sorted(((r.user_id, r.start_us - base, r.end_us - base, r.n, r.reason) for r in rows), key=repr)


def test_capped_sessions_of_a_table(spark):
    rng = random.Random(8)
    rows = [(u, rng.randrange(4000) * 0.5) for u in ("a", "b", None) for _ in range(150)] + [("c", 5.0), ("c", 5.0), ("d", 0.0), ("d", 30.0), ("e", 0.0), ("e", 29.0), ("e", 58.0), ("e", 87.0), ("e", 90.0)]
    df = spark.createDataFrame([(i, u, at(t)) for i, (u, t) in enumerate(rows)] + [(999, "a", None)], SCHEMA)
    got = capped.capped_sessions(df)
    assert relative(got.collect()) == plain(rows, 30, 90)
    assert {r.reason for r in got.collect()} == {"idle", "longest"}
    assert capped.capped_sessions(df.limit(0)).collect() == []


def files(spark, folder, parts):
    """A file for each trigger, in order of its name; a stream takes one at a time."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_stream_and_a_table_have_the_same_sessions(spark, tmp_path):
    rng = random.Random(2)
    rows = [(u, round(rng.random() * 900, 3)) for u in ("a", "b") for _ in range(120)]
    rng.shuffle(rows)
    # the third part is read when the watermark stands at 2000 - 1000 seconds: what is not newer comes too late
    parts = [rows[:80] + [("c", 1000.0)], [*rows[80:], ("c", 2000.0)], [("a", 100.0), ("a", 1000.0), ("b", 1001.0)], [("z", 9000.0)]]
    number = iter(range(10**6))
    stream = files(spark, str(tmp_path / "in"), [[(next(number), u, at(t)) for u, t in part] for part in parts])
    streams.run(capped.stream_capped_sessions(stream, late="1000 seconds"), str(tmp_path))
    got = upsert.read(spark, str(tmp_path / "table")).collect()
    late = [r for r in got if r.kind == "late"]
    kept = [*parts[0], *parts[1], ("b", 1001.0), ("z", 9000.0)]
    want = [s for s in plain(kept, 30, 90) if s[2] <= 8000 * 10**6]
    assert relative([r for r in got if r.kind == "session"]) == want
    assert [(u, s) for u, s, _, _, _ in relative(late)] == [("a", 100 * 10**6), ("a", 1000 * 10**6)]


def test_a_stream_that_dies_gives_the_rows_of_one_run(spark, tmp_path, monkeypatch):
    rows = [(i, f"u{i % 3}", at(i)) for i in range(40)]
    parts = [rows[:15], rows[10:25], rows[:5] + rows[25:], [rows[39], rows[39]]]
    root, died = str(tmp_path), []

    def dies(self, name, text, whole=upsert.Folder.replace):
        if name == "commits/1" and len(died) < 2:
            died.append(name)
            raise RuntimeError("lost between writing and committing")
        whole(self, name, text)

    monkeypatch.setattr(upsert.Folder, "replace", dies)
    files(spark, f"{root}/in", parts)
    source = lambda: upsert.once(spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), "event_id", "ts")
    for _ in range(2):
        with pytest.raises(Exception, match="lost between"):
            streams.run(source(), root)
        assert upsert.committed(spark, f"{root}/table") == [0] and upsert.read(spark, f"{root}/table").count() == 15
    streams.run(source(), root)
    want = sorted((i, u) for i, u, _ in rows)
    assert sorted((r.event_id, r.user_id) for r in upsert.read(spark, f"{root}/table").collect()) == want
    assert sorted((r.event_id, r.user_id) for r in upsert.read(spark, f"{root}/table", "event_id").collect()) == want
    streams.run(source(), root)
    assert upsert.read(spark, f"{root}/table").count() == 40


def test_newer_batches_take_the_place_of_older_ones(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        upsert.read(spark, root)
    write = lambda rows, n: upsert.write_batch(spark.createDataFrame(rows, "k long, v string"), n, root)
    write([(1, "a"), (2, "b"), (None, "n")], 0)
    write([(2, "c"), (3, "d")], 1)
    write([(2, "c"), (3, "d")], 1)
    assert sorted(map(tuple, upsert.read(spark, root, "k").collect()), key=repr) == [(1, "a"), (2, "c"), (3, "d"), (None, "n")]


def test_a_ring_of_samples_over_triggers_is_that_of_the_table(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["dense", "dense", "sparse", None]), at(i // 3), rng.random()) for i in range(400)]
    rows += [(500, "dense", at(500), None), (501, "dense", at(501), float("nan")), (502, "once", at(502), 2.0)]
    schema = "event_id long, stage string, ts timestamp, value double"
    for n, low in enumerate(range(0, len(rows), 130)):
        spark.createDataFrame(rows[low : low + 130], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    streams.run(recorder.stream_summaries(stream, "stage", "value", "ts", "event_id", 50), str(tmp_path), "update")
    exact = lambda df: sorted(((r.stage, r.came, r.samples, r.p50, r.p70, r.p95, r.p100, round(r["mean"], 9)) for r in df.collect()), key=repr)
    got = exact(upsert.read(spark, f"{tmp_path}/table", "stage"))
    assert got == exact(recorder.summaries(spark.createDataFrame(rows, schema), "stage", "value", "ts", "event_id", 50))
    assert {r[0]: r[2] for r in got}["once"] == 1 and len(got) == 4


def test_ring_holds_no_more_than_it_keeps(monkeypatch):
    """A trigger's samples come in parts; what is held at once goes by ``kept``, not by how many come."""
    import pandas as pd

    from veristra.streaming import recorder

    class State(dict):
        exists, get, values = lambda s: "n" in s, lambda s: s["n"], lambda s: list(dict.values(s))
        update = lambda s, v: s.__setitem__("n", v)
        updateValue = dict.__setitem__  # noqa: N815

    sizes, plain = [], pd.concat
    monkeypatch.setattr(recorder.pd, "concat", lambda parts: (lambda parts: sizes.append(sum(map(len, parts))) or plain(parts))(list(parts)))
    ring = recorder.Ring("k", 7)
    ring.came, ring.slots = State(), State()
    at = [(i * 37) % 101 for i in range(101)]
    parts = [pd.DataFrame({"at": at[i : i + 10], "tie": 0, "value": [float(x) for x in at[i : i + 10]]}) for i in range(0, 101, 10)]
    (out,) = ring.handleInputRows(("a",), iter(parts), None)
    assert sorted(v[0] for v in ring.slots.values()) == [94.0, 95.0, 96.0, 97.0, 98.0, 99.0, 100.0]
    assert (out.came[0], out.samples[0], out.p50[0]) == (101, 7, 97.0) and max(sizes) <= 17
    (out,) = ring.handleInputRows(("a",), iter([pd.DataFrame({"at": [5, 4], "tie": 0, "value": [1.0, 2.0]})]), None)
    assert (out.came[0], sorted(v[0] for v in ring.slots.values())) == (103, [1.0, 2.0, 96.0, 97.0, 98.0, 99.0, 100.0])


def test_events_of_a_key_are_few_values_of_state(monkeypatch):
    """A trigger's events go into state by packs and sessions come out by packs, however many they are, and are those of the plain rule."""
    import pandas as pd

    class Kept(list):
        exists, get, appendList, appendValue = lambda s: bool(s), lambda s: iter(list(s)), list.extend, list.append  # noqa: N815
        put = lambda s, values: s.__setitem__(slice(None), values)

    class One(Kept):
        get, update = lambda s: s[0] if s else None, lambda s, v: s.__setitem__(slice(None), [v])

    class Times:
        getCurrentWatermarkInMs = lambda s: s.ms  # noqa: E731, N815

    monkeypatch.setattr(capped, "PACK", 100, raising=False)
    rng, second, timers = random.Random(3), 10**6, []
    ticks = sorted(rng.sample(range(2, 9000), 700))
    events = [t * second // 2 for t in ticks]
    rng.shuffle(events)
    machine, now = capped.CappedSessions("user_id", 30 * second, 90 * second), Times()
    machine.handle, machine.session, machine.pending = type("Handle", (), {"registerTimer": lambda s, ms: timers.append(ms)})(), One(), Kept()
    now.ms = 500
    frames = [pd.DataFrame({"at": events[i : i + 40]}) for i in range(0, 700, 40)]
    late = list(machine.handleInputRows(("u",), iter([*frames, pd.DataFrame({"at": [500_000, 7, 1]})]), now))
    assert len(late) == 1 and late[0]["cells"][0] == [x for t in (1, 7, 500_000) for x in (t, t, 1, capped.LATE)]
    assert len(machine.pending) == 6 and len(timers) == 1 and timers[0] == min(events) // 1000
    got = []
    for now.ms in (2_000_000, 2_000_000, 3_000_000, 10_000_000):
        out = list(machine.handleExpiredTimer(("u",), now, None))
        assert len(out) <= 7 and len(machine.pending) <= 7
        got += [cells for frame in out for cells in frame["cells"]]
    cells = [x for c in got for x in c]
    found = [("u", *cells[i : i + 3], capped.REASONS[cells[i + 3]]) for i in range(0, len(cells), 4)]
    assert sorted(found, key=repr) == plain([("u", t / second) for t in events], 30, 90)
    assert not machine.pending and not machine.session
