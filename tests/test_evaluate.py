"""Percentiles by narrowing histograms and calibration by cells, against plain Python."""

import itertools
import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from veristra.operators import evaluate


def nearest(values, percent):
    return sorted(values)[max(1, math.ceil(Decimal(str(percent)) * len(values) / 100)) - 1]


def test_selected_percentiles_are_exact(spark):
    rng = random.Random(6)
    groups = {
        "even": [rng.random() for _ in range(700)], "same": [3.5] * 40, "one": [-2.0], "two": [5.0, 1.0],
        "heavy": [math.exp(rng.gauss(0, 12)) for _ in range(400)], "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324, 1e-300],
        None: [float(rng.randrange(4)) for _ in range(90)], "close": [1.0, math.nextafter(1.0, 2), math.nextafter(1.0, 0)] * 5,
    }
    rows = [(g, 1, v) for g, vs in groups.items() for v in vs] + [("even", 1, None), ("even", 1, float("nan")), ("two", 1, float("inf")), ("nothing", 1, None), ("nothing", 1, float("-inf"))]
    df = spark.createDataFrame(rows, "k0 string, v int, value double").repartition(3).cache()
    percents = (0, 0.5, 50, 70, 99.9, 100)
    got = {(r.k0, r.percent): (r.value, r.n) for r in evaluate.selected_percentiles(df, ["k0"], "value", percents, bins=1024).collect()}
    assert got == {(g, float(p)): (nearest(vs, p), len(vs)) for g, vs in groups.items() for p in percents}
    whole = evaluate.selected_percentiles(df.where("k0 IN ('even', 'heavy')"), [], "value", (50,)).collect()
    assert [(r.value, r.n) for r in whole] == [(nearest(groups["even"] + groups["heavy"], 50), 1100)]
    assert evaluate.selected_percentiles(df.limit(0), ["k0"], "value").collect() == []
    df.unpersist()


def test_calibration_by_cells_is_that_of_every_triple(spark):
    rng = random.Random(9)
    rows = [(rng.choice([0.1, 0.2, 0.3, rng.random()]), rng.random() / 3, rng.choice([0.0, 0.5, 1.0]), rng.random() < 0.7) for _ in range(300)]
    odd = [(None, 0.2, 0.5, True), (0.5, None, 0.5, False), (float("nan"), 0.2, 0.5, False), (0.5, 0.2, 0.5, None)]
    scored = spark.createDataFrame(rows + odd, "top double, margin double, agreement double, answerable boolean")
    grids = [evaluate.grid(scored.where("NOT isnan(top)"), "top", 5, (-1.0,)), evaluate.grid(scored, "margin", 4, (0.0,)), evaluate.grid(scored, "agreement", 16, (0.0, 1.0))]
    values = [sorted(r.v for r in g.collect()) for g in grids]
    known = [r for r in rows + odd if r[3] is not None]
    number = lambda x: -math.inf if x is None or math.isnan(x) else x
    want = []
    for triple in itertools.product(*values):
        seen = [(r[3], all(number(x) >= t for x, t in zip(r[:3], triple, strict=True))) for r in known]
        tp, tn, fp, fn = (seen.count(x) for x in ((True, True), (False, False), (False, True), (True, False)))
        recall, specificity = tp / (tp + fn), tn / (tn + fp)
        precision = tp / (tp + fp) if tp + fp else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        want.append(((recall + specificity) / 2, f1, (tp + tn) / len(known), -fp, -fn, *triple))
    got = evaluate.calibrate(scored, *grids).collect()
    mine = [(r.balanced_accuracy, r.f1, r.accuracy, -r.fp, -r.fn, r.min_score, r.min_margin, r.min_agreement) for r in got]
    assert [tuple(round(x, 9) for x in r) for r in mine] == [tuple(round(x, 9) for x in r) for r in sorted(want, reverse=True)]
    assert all(r.cases == len(known) and r.tp + r.fn == sum(x[3] for x in known) for r in got)
    empty = evaluate.calibrate(scored.limit(0), *grids).collect()
    assert len(empty) == len(want) and {(r.cases, r.f1) for r in empty} == {(0, 0.0)}
    with pytest.raises(ValueError, match="a grid holds"):
        evaluate.calibrate(scored, spark.range(100).select(F.col("id").alias("v")), *grids[1:])


def test_group_sizes_meet_the_target_as_well_as_any_subset():
    rng = random.Random(12)
    for _ in range(150):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        sums = {0}
        for s, n in counts.items():
            sums = {t + s * k for t in sums for k in range(n + 1)}
        for target in {0, 1, rng.randrange(40), sum(s * n for s, n in counts.items()), 500}:
            got = evaluate.pick_sizes(counts, target)
            assert all(0 <= got[s] <= n for s, n in counts.items())
            total = sum(s * n for s, n in got.items())
            assert total == min(sums, key=lambda t: (abs(t - target), t > target)), (counts, target)
            # a target beyond the driver's totals: shares of each size first
            rough = evaluate.pick_sizes(counts, target, totals=16)
            assert all(0 <= rough[s] <= n for s, n in counts.items())
    many = {1: 10**6, 3: 10**5, 7: 10**4, 1000: 12}
    for target in (10**5 + 1, 777_777):
        assert sum(s * n for s, n in evaluate.pick_sizes(many, target, totals=5000).items()) == target


def test_groups_are_chosen_whole_and_by_place(spark):
    texts = [f"text {i}" for i in range(12)] + ["twice", "Twice "] * 1 + ["often"] * 5 + [None, ""]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "id long, text string, split string")
    for rows in (0, 1, 7, 19, 100):
        got = evaluate.group_split(df, "text", rows).collect()
        assert len(got) == len(texts) and sum(r.split == "development" for r in got) == min(rows, len(texts))
        sides = {}
        for r in got:
            assert sides.setdefault((r.text or "").lower().strip(), r.split) == r.split
        assert evaluate.group_split(df.repartition(3), "text", rows).where("split = 'development'").count() == min(rows, len(texts))
    assert evaluate.group_split(df.limit(0), "text", 3).count() == 0


def test_marginals_count_what_is_relevant_and_never_list_it(spark, monkeypatch):
    from veristra.plans import queries

    monkeypatch.setattr(evaluate, "per_query", lambda *_: pytest.fail("lists what is relevant"))
    assert queries.corpus_size_marginals(spark, "/root/testdata/sf0.001").count() == len(queries.SIZES)


def _hashes(monkeypatch):
    calls, real = [], evaluate.content_group
    monkeypatch.setattr(evaluate, "content_group", lambda text: calls.append(1) or real(text))
    return calls


def test_provenance_hashes_contents_once(spark, monkeypatch):
    from veristra.plans import records

    calls = _hashes(monkeypatch)
    records.held_out_provenance(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1


def test_group_split_hashes_contents_once(spark, monkeypatch):
    from veristra.plans import queries

    calls = _hashes(monkeypatch)
    queries.group_split(spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
