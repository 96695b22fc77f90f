"""Ranking metrics, latencies, confusion, calibration, splits and comparisons."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veristra.checkpoints import FEW, cut_lineage
from veristra.checkpoints import ranked as numbered
from veristra.config import SETTINGS

SHARES = (25, 50, 70, 75, 90, 95, 99)


def nearest_rank(value: str, percent: float) -> Column:
    return F.expr(f"percentile_disc({percent / 100}) within group (order by {value})")


def distribution(value: str) -> list[Column]:
    """count, min, nearest-rank percentiles, max and mean; all but the count null for no rows."""
    return [F.count(value).alias("count"), F.min(value).alias("min"), *[nearest_rank(value, p).alias(f"p{p}") for p in SHARES], F.max(value).alias("p100"), F.max(value).alias("max"), F.avg(value).alias("mean")]


def selected_percentiles(df: DataFrame, by: list[str], value: str, percents: tuple[float, ...] = SHARES, bins: int = 4096) -> DataFrame:
    """(<by>, percent, value, n): nearest-rank percentiles of few large groups, exactly, without holding a group's values anywhere.

    Each round counts values between a percentile's bounds in ``bins`` bins of equal width, before the shuffle, and
    goes on with the least and largest value of the bin that holds its rank, until these are one value. Both ends of an
    interval fall into different bins, so every round narrows it. Rows are read once a round: cut their lineage if they
    are dear. Null, NaN and infinite values are left out; a group without others has no rows; null keys form groups.
    """
    names = [f"k{i}" for i in range(len(by))]
    v = F.col("v")
    rows = df.select(*[F.col(f"`{b}`").alias(n) for b, n in zip(by, names, strict=True)], F.col(f"`{value}`").cast("double").alias("v")).where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.greatest(F.lit(1), F.ceil(F.lit(Decimal(str(p))) * F.col("n") / 100)).cast("long").alias("rank")) for p in percents])
    whole = rows.groupBy(*names).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    open_ = cut_lineage(whole.withColumn("t", F.explode(ranks)).select(*names, "t.percent", "n", "t.rank", "low", "high"))
    found = [open_.where("low = high")]
    keys = [*names, "low", "high"]
    other = [f"of_{n}" for n in keys]
    same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(o)) for n, o in zip(keys, other, strict=True)])
    while not open_.where("low < high").isEmpty():
        left = open_.where("low < high")
        spans = left.select(*[F.col(n).alias(o) for n, o in zip(keys, other, strict=True)]).distinct()
        within = [F.col(n).eqNullSafe(F.col(f"of_{n}")) for n in names] + [F.col("v") >= F.col("of_low"), F.col("v") <= F.col("of_high")]
        hit = rows.join(F.broadcast(spans) if spans.limit(FEW + 1).count() <= FEW else spans, reduce(Column.__and__, within))
        # halves of very large ends, so that the width of an interval can't overflow; it is never 0
        part = F.when(F.greatest(F.abs("of_low"), F.abs("of_high")) > 1e300, 0.5).otherwise(1.0)
        place = F.least(F.floor((v * part - F.col("of_low") * part) / (F.col("of_high") * part - F.col("of_low") * part) * bins), F.lit(bins - 1))
        # bins of one interval, at most ``bins`` rows, are summed up in order
        held = hit.groupBy(*other, place.alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        summed = held.withColumn("upto", F.sum("c").over(W.partitionBy(*other).orderBy("bin")))
        at = left.join(summed, same & (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
        open_ = cut_lineage(at.select(*names, "percent", "n", (F.col("rank") - F.col("upto") + F.col("c")).alias("rank"), F.col("a").alias("low"), F.col("b").alias("high")))
        found.append(open_.where("low = high"))
    out = reduce(DataFrame.unionByName, found)
    return out.select(*[F.col(n).alias(b) for b, n in zip(by, names, strict=True)], "percent", F.col("low").alias("value"), "n")


def judged(hits: DataFrame, queries: DataFrame, depths: tuple[int, ...] = (1, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """Recall, reciprocal rank and nDCG of each query, 0 where nothing is relevant.

    hits: (<by>), query_id, rank, the relevant ones alone, each once. queries: (<by>), query_id, n, the number of what is
    relevant, null or 0 for none; it needs no list of it.
    """
    key = [*by, "query_id"]
    gain = F.when(F.col("rank") <= 10, F.log(F.lit(2.0)) / F.log(F.col("rank") + 1.0))
    found = hits.groupBy(*key).agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in depths], F.min(F.when(F.col("rank") <= 10, F.col("rank"))).alias("best"), F.sum(gain).alias("gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n")).cast("int")), F.lit(0.0), lambda a, i: a + F.log(F.lit(2.0)) / F.log(i + 1.0))
    zero = lambda c: F.coalesce(F.when(F.col("n") > 0, c), F.lit(0.0))
    kept = [c for c in queries.columns if c != "n"]
    return queries.join(found, key, "left").select(*kept, *[zero(F.col(f"h{k}") / F.col("n")).alias(f"recall_{k}") for k in depths], zero(1 / F.col("best")).alias("mrr_10"), zero(F.col("gain") / ideal).alias("ndcg_10"))


def per_query(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, depths: tuple[int, ...] = (1, 5, 10), by: tuple[str, ...] = ()) -> DataFrame:
    """``judged`` with what is relevant as a list.

    ranked: (<by>), query_id, rank, doc_id. relevant: query_id, doc_id. A document that a query has twice counts once.
    """
    truth = relevant.select("query_id", "doc_id").distinct()
    first = ranked.groupBy(*by, "query_id", "doc_id").agg(F.min("rank").alias("rank")).join(truth, ["query_id", "doc_id"], "left_semi")
    size = truth.groupBy("query_id").agg(F.count("*").alias("n"))
    return judged(first, queries.join(size, "query_id", "left"), depths, by)


METRICS = ("recall_1", "recall_5", "recall_10", "mrr_10", "ndcg_10")


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Averages over all queries, overall and by each column of ``by``: one row a grouping set."""
    means = [F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in METRICS]
    if not by:
        return metrics.agg(F.count("*").alias("queries"), *means)
    return metrics.groupingSets([[], *[[F.col(b)] for b in by]], *[F.col(b) for b in by]).agg(F.count("*").alias("queries"), *means)


def rates(tp: Column, tn: Column, fp: Column, fn: Column) -> list[Column]:
    """Rates of a two-class decision from its counts, 0 where a denominator is."""
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    precision, recall, specificity = rate(tp, tp + fp), rate(tp, tp + fn), rate(tn, tn + fp)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    n = tp + tn + fp + fn
    return [rate(tp + tn, n).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), specificity.alias("specificity"), f1.alias("f1"), ((recall + specificity) / 2).alias("balanced_accuracy"), rate(tp + fp, n).alias("coverage")]


def binary(expected: Column, observed: Column) -> list[Column]:
    """Counts and rates of a two-class decision. Neither may be null."""
    tp, tn = F.count_if(expected & observed), F.count_if(~expected & ~observed)
    fp, fn = F.count_if(~expected & observed), F.count_if(expected & ~observed)
    return [F.count("*").alias("cases"), tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"), *rates(tp, tn, fp, fn)]


def confusion(df: DataFrame, expected: str, observed: str) -> DataFrame:
    return df.groupBy(expected, observed).agg(F.count("*").alias("n"))


def grid(values: DataFrame, column: str, points: int, anchors: tuple[float, ...]) -> DataFrame:
    """Anchors, and evenly placed values among the other distinct ones, ``points`` in all."""
    fixed = sorted(set(anchors))
    others = values.select(F.col(column).cast("double").alias("v")).where("v is not null").distinct().where(~F.col("v").isin(*fixed))
    n, slots = others.count(), max(0, points - len(fixed))
    spark = values.sparkSession
    held = spark.createDataFrame([(float(a),) for a in (fixed if slots or n + len(fixed) <= points else fixed[:points])], "v double")
    if n + len(fixed) <= points:
        return others.unionByName(held)
    if slots == 0:
        return held
    wanted = [n // 2] if slots == 1 else sorted({round(i * (n - 1) / (slots - 1)) for i in range(slots)})
    placed = numbered(others, [], [F.col("v")], "place")
    return placed.where(F.col("place").isin(wanted)).select("v").unionByName(held)


#: Thresholds of a grid; their product of three is what the driver and one task may hold.
GRID_MOST = 64


def calibrate(scored: DataFrame, scores: DataFrame, margins: DataFrame, floors: DataFrame) -> DataFrame:
    """Metrics of every threshold triple, best first by balanced accuracy, then f1, accuracy, fewer errors, higher thresholds.

    scored: top, margin, agreement, answerable; a missing value reaches no threshold, a row without answerable is left
    out. Each row falls into one cell of the grid, by how many thresholds it reaches; what a triple accepts is the sum of
    the cells above it. So the cost is that of one count over the rows, whatever the number of triples.
    """
    grids = {}
    for name, df in (("top", scores), ("margin", margins), ("agreement", floors)):
        grids[name] = sorted(r.v for r in df.where("v IS NOT NULL").distinct().limit(GRID_MOST + 1).collect())
        if not 0 < len(grids[name]) <= GRID_MOST:
            raise ValueError(f"a grid holds 1 to {GRID_MOST} thresholds")
    spark = scored.sparkSession
    reached = lambda name: F.coalesce(F.size(F.filter(F.array(*[F.lit(float(x)) for x in grids[name]]), lambda x: x <= F.col(name).cast("double"))), F.lit(0))
    axes = list(grids)
    counted = scored.where(F.col("answerable").isNotNull()).select(*[F.when(F.col(a).isNull() | F.isnan(F.col(a).cast("double")), 0).otherwise(reached(a)).alias(a) for a in axes], "answerable")
    cells = counted.groupBy(*axes).agg(F.count_if("answerable").alias("yes"), F.count_if(~F.col("answerable")).alias("no"))
    total = cells.agg(F.coalesce(F.sum("yes"), F.lit(0)).alias("all_yes"), F.coalesce(F.sum("no"), F.lit(0)).alias("all_no"))
    corner = lambda name: spark.range(1, len(grids[name]) + 1).select(F.col("id").cast("int").alias(name))
    full = corner("top").join(corner("margin"), F.lit(True)).join(corner("agreement"), F.lit(True)).join(cells, axes, "left").fillna(0, ["yes", "no"])
    for a in axes:
        above = W.partitionBy(*[x for x in axes if x != a]).orderBy(F.col(a).desc())
        full = full.withColumn("yes", F.sum("yes").over(above)).withColumn("no", F.sum("no").over(above))
    value = lambda name: F.element_at(F.array(*[F.lit(float(x)) for x in grids[name]]), F.col(name))
    found = full.join(F.broadcast(total), F.lit(True)).select(*[value(a).alias(n) for a, n in zip(axes, ("min_score", "min_margin", "min_agreement"), strict=True)], F.col("yes").alias("tp"), (F.col("all_no") - F.col("no")).alias("tn"), F.col("no").alias("fp"), (F.col("all_yes") - F.col("yes")).alias("fn"))
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    measured = found.select("min_score", "min_margin", "min_agreement", (tp + tn + fp + fn).alias("cases"), tp, tn, fp, fn, *rates(tp, tn, fp, fn))
    order = [F.col(c).desc() for c in ("balanced_accuracy", "f1", "accuracy")] + [F.col("fp"), F.col("fn")] + [F.col(c).desc() for c in ("min_score", "min_margin", "min_agreement")]
    return measured.orderBy(*order)


def marginal_gains(reports: DataFrame, least: float = 0.01) -> DataFrame:
    """Change of recall from one corpus size to the next, and whether it is the first below ``least``.

    reports: document_count, recall_10; a few rows.
    """
    w = W.orderBy("document_count")
    steps = reports.withColumn("gain", F.col("recall_10") - F.lag("recall_10").over(w)).withColumn("more", F.col("document_count") - F.lag("document_count").over(w))
    low = F.coalesce(F.col("gain") <= least, F.lit(False))
    return steps.withColumn("stop", low & (F.sum(low.cast("int")).over(w) == 1))


def content_group(text: Column) -> Column:
    from veristra.functions.text import plain_matching

    return F.sha2(plain_matching(text), 256)


def split_order(group: Column, seed: int = SETTINGS.seed) -> Column:
    return F.sha2(F.concat(F.lit("sha256\0"), F.lit(str(seed)), F.lit("\0"), group), 256)


def hash_split(df: DataFrame, text: str, share: float, seed: int = SETTINGS.seed, hashed: bool = False) -> DataFrame:
    """``df`` with split: rows of one content go to one side, by the first 52 bits of a seeded hash; no global order is needed.

    ``hashed``: as ``group_split`` takes it.
    """
    place = F.conv(F.substring(split_order(F.col(text) if hashed else content_group(F.col(text)), seed), 1, 13), 16, 10).cast("double") / float(1 << 52)
    return df.withColumn("split", F.when(place < share, "development").otherwise("final"))


#: Totals that the driver tells apart, 8 bytes each.
TOTALS = 1 << 24


def pick_sizes(counts: dict[int, int], target: int, totals: int = TOTALS) -> dict[int, int]:
    """How many groups of each size to take, so that their sizes come to ``target`` or nearest to it (rather below).

    counts: groups of each size. Targets of up to ``totals`` are met as well as can be. Beyond, every size first gives
    its share but for what ``totals`` leaves open, and the rest is met as well as what remains allows.
    """
    given = dict.fromkeys(counts, 0)
    whole = sum(s * n for s, n in counts.items())
    if target > totals:
        share = (target - totals // 2) / max(whole, 1)
        given = {s: min(n, int(n * share)) for s, n in counts.items()}
        target -= sum(s * n for s, n in given.items())
    left = {s: n - given[s] for s, n in counts.items() if s > 0}
    most = min(2 * target, sum(s * n for s, n in left.items())) if target > 0 else 0
    # the size by which a total was first reached, and how many of it: what they are added to was reached before by other sizes
    by, times = np.zeros(most + 1, np.int32), np.full(most + 1, -1, np.int32)
    times[0] = 0
    for size in sorted(left):
        before = times >= 0
        # of each total not reached yet, the nearest reached one below in steps of ``size``, no more steps than groups
        for start in range(min(size, most + 1)):
            lane = before[start::size]
            at = np.maximum.accumulate(np.where(lane, np.arange(len(lane)), -1))
            steps = np.arange(len(lane)) - at
            new = ~lane & (at >= 0) & (steps <= left[size])
            by[start::size][new] = size
            times[start::size][new] = steps[new]
    reached = np.flatnonzero(times >= 0)
    total = int(min(reached, key=lambda t: (abs(t - target), t > target)))
    while total > 0:
        size, n = int(by[total]), int(times[total])
        given[size] += n
        total -= size * n
    return given


def choose_groups(groups: DataFrame, target: int, totals: int = TOTALS) -> DataFrame:
    """``groups`` (group, size, place) with ``chosen``: whole groups whose sizes come to ``target`` or nearest to it.

    Of groups of one size those first in order of place (then group) are taken. The driver holds the number of groups
    of each size; distinct sizes are few, as n of them need n * n / 2 rows. Groups of no rows are never chosen.
    """
    counts = {r["size"]: r["count"] for r in groups.groupBy("size").count().where("size > 0").collect()}
    wanted = groups.sparkSession.createDataFrame([(s, n) for s, n in pick_sizes(counts, target, totals).items()] or [(0, 0)], "s long, m long")
    placed = numbered(groups, ["size"], [F.col("place"), F.col("group")], "n")
    return placed.join(F.broadcast(wanted), F.col("size") == F.col("s"), "left").select(*groups.columns, F.coalesce(F.col("n") < F.col("m"), F.lit(False)).alias("chosen"))


def group_split(df: DataFrame, text: str, rows: int, seed: int = SETTINGS.seed, hashed: bool = False) -> DataFrame:
    """``df`` with split: whole contents of ``rows`` rows together, or as near as can be, are "development", the rest "final".

    ``df`` is read twice. ``hashed``: the column holds ``content_group`` of texts already, which are dear to hash.
    """
    keyed = df.withColumn("__group", F.col(text) if hashed else content_group(F.col(text)))
    groups = keyed.groupBy("__group").agg(F.count("*").alias("size")).select(F.col("__group").alias("group"), "size", split_order(F.col("__group"), seed).alias("place"))
    chosen = choose_groups(groups, rows).where("chosen").select("group")
    return keyed.join(chosen.withColumn("__in", F.lit(True)), F.col("__group") == F.col("group"), "left").withColumn("split", F.when(F.col("__in"), "development").otherwise("final")).drop("__group", "__in", "group")


def id_fingerprint(ids: str) -> Column:
    """SHA-256 of the JSON list of the sorted distinct ids, an aggregate of small groups: one buffer holds a group's ids."""
    return F.sha2(F.to_json(F.array_sort(F.collect_set(F.col(ids).cast("string")))), 256)


#: Ids that one list holds.
LISTED = 100_000


def set_fingerprint(df: DataFrame, ids: str, listed: int = LISTED) -> DataFrame:
    """One row (n, fingerprint): the number of different ids of a table of any size, and a digest of them.

    Up to ``listed`` ids: ``id_fingerprint``. More are dealt by the first hex digits of their own digests, as many digits
    as leave lists of about ``listed`` or fewer; the fingerprint is that of the lists' fingerprints. Both follow from the
    set alone, not from order, repeats or partitions. Nulls are left out.
    """
    once = df.select(F.col(ids).cast("string").alias("id")).where("id IS NOT NULL").distinct()
    n, digits = once.count(), 0
    while n > listed * 16**digits:
        digits += 1
    if digits:
        once = once.groupBy(F.substring(F.sha2("id", 256), 1, digits).alias("part")).agg(id_fingerprint("id").alias("f")).select(F.concat("part", F.lit(":"), "f").alias("id"))
    return once.agg(id_fingerprint("id").alias("fingerprint")).select(F.lit(n).cast("long").alias("n"), "fingerprint")


def compare(left: DataFrame, right: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Differences of two variants' metrics, and whether they have the same keys."""
    a = left.select(key, *[F.col(m).alias(f"a_{m}") for m in metrics])
    b = right.select(F.col(key).alias("k"), *[F.col(m).alias(f"b_{m}") for m in metrics])
    return a.join(b, F.col(key) == F.col("k"), "full").select(F.coalesce(key, "k").alias(key), (F.col(key).isNotNull() & F.col("k").isNotNull()).alias("paired"), *[(F.col(f"b_{m}") - F.col(f"a_{m}")).alias(m) for m in metrics])
