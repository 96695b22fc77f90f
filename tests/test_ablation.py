"""Ablation against plain Python, and what its parts rest on: fingerprints of sets, metrics by counts, leak search."""

import hashlib
import json
import math

from pyspark.sql import functions as F

from veristra.functions import encoders
from veristra.operators import ablation, corpus, evaluate, retrieve, scoring

CHUNKS = "chunk_id long, parent_id long, strategy string, language string, text string"
ROWS = [
    (1, 1, "atomic", "en", "red apples grow on trees"),
    (2, 1, "atomic", "hi", "red apples grow on old trees"),
    (3, 2, "atomic", "en", "blue whales swim in the sea"),
    (4, 2, "sentence_window", "en", "blue whales swim in the sea and sing"),
    (5, 3, "sentence_window", "en", "apples and whales meet in 1999"),
    (6, 3, "bilingual_paired", "hi-en", "apples meet whales"),
    (7, 4, "parent_child", "en", None),
    (8, 4, "parent_child", "en", ""),
    (9, 5, "parent_child", "en", "red apples grow on trees"),
    (None, 6, "atomic", "en", "red apples grow on trees"),
    (11, 6, None, "en", "red apples grow on trees"),
]
QUERIES = [(100, "red apples on trees"), (101, "explain how whales swim"), (102, None), (103, ""), (None, "whales")]


def _rank(hits, planned):
    """Rankings of one plan in plain Python: (source, [(chunk, parent)])."""
    out = {}
    for source, digits, weight, limit in (("dense", 12, planned.dense_weight, planned.dense_limit), ("sparse", 9, planned.sparse_weight, planned.sparse_limit)):
        if weight > 0:
            mine = [h for h in hits if h.query_id == planned.query_id and h.source == source and h.strategy in planned.strategies and (planned.languages is None or h.language in planned.languages)]
            out[source] = sorted(mine, key=lambda h: (-round(h.score, digits), h.chunk_id))[:limit]
    return out


def test_ablation_matches_plain_python(spark):
    chunks, queries = spark.createDataFrame(ROWS, CHUNKS), spark.createDataFrame(QUERIES, "query_id long, query string")
    hits = ablation.search_parts(queries, chunks, encoders.hashed(), 24)
    planned = ablation.plans(retrieve.route(queries.where("query_id IS NOT NULL")))
    relevant = spark.createDataFrame([(100, 1), (100, 1), (100, 3), (101, 2)], "query_id long, parent_id long")
    judged = {(r.config, r.query_id): r for r in ablation.ablate(planned, hits, relevant).collect()}
    held, plans = hits.collect(), planned.collect()
    assert not {h.chunk_id for h in held} & {7, 8, 11, None}
    assert len(plans) == len(judged) == 7 * 4
    truth = {100: {"1", "3"}, 101: {"2"}}
    for p in plans:
        branches = _rank(held, p)
        weights = {s: p[f"{s}_weight"] for s, found in branches.items() if found}
        scores, parent = {}, {}
        for s, found in branches.items():
            for at, h in enumerate(found, 1):
                scores[h.chunk_id] = scores.get(h.chunk_id, 0) + weights[s] / (60 + at)
                parent[h.chunk_id] = h.parent_id
        total = sum(weights.values()) / 61
        order, seen = [], set()
        for c in sorted(scores, key=lambda c: (-round(scores[c] / total, 12), parent[c], c)):
            if parent[c] not in seen:
                seen.add(parent[c])
                order.append(parent[c])
        order = order[:10]
        want, got = truth.get(p.query_id, set()), judged[p.config, p.query_id]
        at = [i for i, x in enumerate(order, 1) if x in want]
        assert got.hits == len(order)
        assert math.isclose(got.recall_10, len(at) / len(want) if want else 0)
        assert math.isclose(got.recall_1, sum(a <= 1 for a in at) / len(want) if want else 0)
        assert math.isclose(got.mrr_10, 1 / at[0] if at else 0)
        ideal = sum(1 / math.log2(i + 1) for i in range(1, len(want) + 1))
        assert math.isclose(got.ndcg_10, sum(1 / math.log2(a + 1) for a in at) / ideal if at else 0)
        assert (got.agreement is None) == (p.sparse_weight == 0 or p.dense_weight == 0)
    assert judged["atomic_dense_english", 102].hits == judged["all_routed", 103].hits == 0

    report = {r.config: r for r in ablation.report(spark.createDataFrame(list(judged.values())), chunks, least=2).collect()}
    assert set(report) == {c.name for c in ablation.CONFIGURATIONS}
    assert report["atomic_dense_hindi"].chunks == 1 and report["atomic_dense_english"].chunks == 3
    assert report["bilingual_paired_dense"].bytes == len("apples meet whales")
    assert not report["all_routed"].qualified and report["all_routed"].coverage < 1


def test_parts_hold_the_best_of_their_union(spark):
    """The merged hits of all parts are those of one search over all chunks."""
    rows = [(i, i // 3, ("atomic", "sentence_window", "parent_child")[i % 3], ("en", "hi")[i % 2], " ".join(f"w{(i * k) % 17}" for k in range(1, 6))) for i in range(60)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    queries = spark.createDataFrame([(1, "w1 w2 w3 w5"), (2, "w16 w4 w8"), (3, "w7")], "query_id long, query string")
    hits = ablation.search_parts(queries, chunks, encoders.hashed(), 5)
    assert hits.groupBy("query_id", "source", "strategy", "language").count().agg(F.max("count")).first()[0] <= 5
    whole = retrieve.gram_search(queries.select("query_id", F.col("query").alias("form")), chunks.select("chunk_id", F.col("text").alias("form")), 5, "chunk_id")
    want = {(r.query_id, r.rank): (r.chunk_id, round(r.score, 9)) for r in whole.collect()}
    got = {}
    for q in (1, 2, 3):
        mine = sorted((h for h in hits.where("source = 'sparse'").collect() if h.query_id == q), key=lambda h: (-round(h.score, 9), h.chunk_id))[:5]
        got |= {(q, at): (h.chunk_id, round(h.score, 9)) for at, h in enumerate(mine, 1)}
    assert got == want


def test_empty_tables(spark):
    chunks, queries = spark.createDataFrame(ROWS, CHUNKS), spark.createDataFrame(QUERIES[:2], "query_id long, query string")
    relevant = spark.createDataFrame([], "query_id long, parent_id long")
    planned = ablation.plans(retrieve.route(queries))
    none = ablation.search_parts(queries, chunks.limit(0), encoders.hashed())
    judged = ablation.ablate(planned, none, relevant)
    assert judged.where("hits = 0 AND recall_10 = 0").count() == 14
    report = ablation.report(judged, chunks.limit(0)).collect()
    assert len(report) == 7 and all((r.queries, r.answered, r.chunks, r.qualified) == (2, 0, 0, False) for r in report)
    assert ablation.search_parts(queries.limit(0), chunks, encoders.hashed()).count() == 0
    assert len(ablation.report(judged.limit(0), chunks).where("queries = 0 AND coverage = 0").collect()) == 7


def test_pairs_of_reports(spark):
    names = "config string, queries long, answered long, contract string, " + ", ".join(f"{m} double" for m in evaluate.METRICS)
    row = lambda config, queries=5, answered=5, contract="c", m=0.5: (config, queries, answered, contract, *[m] * 5)
    left = spark.createDataFrame([row("a"), row("b"), row("c"), row("d"), row("only")], names)
    right = spark.createDataFrame([row("a", m=0.75), row("b", contract="other"), row("c", queries=6, answered=6), row("d", answered=4)], names)
    got = {r.config: (r.fault, r.recall_1) for r in ablation.paired(left, right).collect()}
    assert got == {"a": (None, 0.25), "b": ("contract", None), "c": ("queries", None), "d": ("incomplete", None), "only": ("missing", None)}
    assert ablation.contract() == ablation.contract(tuple(reversed(ablation.CONFIGURATIONS))) != ablation.contract(ablation.CONFIGURATIONS[:6])


def test_fingerprints_of_sets(spark):
    ids = [str(i) for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids] + [("7",), (None,)], "id string")
    one = lambda xs: hashlib.sha256(json.dumps(sorted(set(xs)), separators=(",", ":")).encode()).hexdigest()
    assert tuple(evaluate.set_fingerprint(df, "id").first()) == (50, one(ids))
    parts = {}
    for i in ids:
        parts.setdefault(hashlib.sha256(i.encode()).hexdigest()[:1], []).append(i)
    want = one([f"{p}:{one(xs)}" for p, xs in parts.items()])
    assert evaluate.set_fingerprint(df, "id", 10).first().fingerprint == want
    assert evaluate.set_fingerprint(df.repartition(7, "id").orderBy(F.desc("id")), "id", 10).first().fingerprint == want
    assert tuple(evaluate.set_fingerprint(df.limit(0), "id").first()) == (0, one([]))


def test_metrics_by_count_equal_those_by_list(spark):
    ranked = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (1, 3, 5), (1, 4, 7), (2, 11, 5), (3, 1, 9)], "query_id long, rank int, doc_id long")
    relevant = spark.createDataFrame([(1, 6), (1, 7), (1, 8), (2, 5), (3, 1)], "query_id long, doc_id long")
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    listed = sorted(map(tuple, evaluate.per_query(ranked, relevant, queries).collect()))
    hits = spark.createDataFrame([(1, 2), (1, 4), (2, 11)], "query_id long, rank int")
    counted = evaluate.judged(hits, spark.createDataFrame([(1, 3), (2, 1), (3, 1), (4, None)], "query_id long, n long"))
    assert sorted(map(tuple, counted.collect())) == listed
    assert [round(x, 4) for x in listed[0][1:5]] == [0, 0.6667, 0.6667, 0.5] and listed[3][1:] == (0, 0, 0, 0, 0)


def test_contained_looks_only_at_pairs_of_passages(spark):
    docs = [(1, "a b c d e f"), (2, "xa b c dx"), (3, "b c"), (4, None), (5, ""), (6, "q b c d q b c d"), (6, "q b c d q b c d")]
    passages = [(1, "a b c d"), (2, "c"), (3, "no such words here"), (4, ""), (5, None), (6, "b c d q")]
    found = corpus.contained(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", spark.createDataFrame(passages, "item_id long, passage string"), "item_id")
    want = {(d, i) for d, t in docs for i, p in passages if t and p and p in t}
    assert {tuple(r) for r in found.collect()} == want
    assert corpus.contained(spark.createDataFrame([], "doc_id long, text string"), "doc_id", spark.createDataFrame(passages, "item_id long, passage string"), "item_id").count() == 0
    assert corpus.contained(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", spark.createDataFrame([], "item_id long, passage string"), "item_id").count() == 0


def test_development_scores_go_into_calibration(spark):
    chunks = spark.createDataFrame([r for r in ROWS if r[0] is not None], CHUNKS)
    queries = spark.createDataFrame([(q, t, t is not None and "apples" in t) for q, t in QUERIES], "query_id long, query string, answerable boolean")
    scores = scoring.development_scores(queries, chunks, encoders.hashed())
    got = {r.query_id: r for r in scores.collect()}
    assert set(got) == {100, 101, 102, 103}
    assert got[100].fused_hits > 0 and math.isclose(got[100].margin, got[100].top - got[100].second)
    assert got[101].category == "descriptive" and got[100].encoder == encoders.hashed().fingerprint()
    for q in (102, 103):
        assert (got[q].top, got[q].agreement, got[q].dense_hits, got[q].sparse_hits, got[q].fused_hits) == (None, 0, 0, 0, 0)
    one = lambda x: spark.createDataFrame([(x,)], "v double")
    best = evaluate.calibrate(spark.createDataFrame(list(got.values())), one(got[100].top), one(-1.0), one(0.0)).first()
    accepted = {q for q, r in got.items() if r.top is not None and r.top >= got[100].top}
    assert (best.cases, best.tp, best.fp) == (4, 1, len(accepted - {100}))
    nothing = scoring.development_scores(queries, chunks.limit(0), encoders.hashed()).collect()
    assert len(nothing) == 4 and all(r.fused_hits == 0 for r in nothing)
    assert scoring.development_scores(queries.limit(0), chunks, encoders.hashed()).count() == 0


def test_every_conversation_asks(spark):
    from veristra.plans import ablation as planned
    from veristra.plans.registry import ORACLE_SQL

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    got = sorted(r.query_id for r in planned._openings(spark, "/root/testdata/sf0.001").collect())
    assert got == sorted(r.conv_id for r in turns.where("turn = 0").collect())
    for name in ("ablation_queries", "ablation_report"):
        assert "openings AS (SELECT conv_id AS item_id, text FROM conversations WHERE turn = 0)," in ORACLE_SQL[name]


def test_only_parts_that_plans_ask_are_searched(spark):
    """A plan's hits are those of a search of all parts; what no plan may take isn't looked for, and no list is deeper than limits."""
    chunks, queries = spark.createDataFrame(ROWS, CHUNKS), spark.createDataFrame(QUERIES, "query_id long, query string")
    planned = ablation.plans(retrieve.route(queries.where("query_id IS NOT NULL"))).withColumn("dense_limit", F.lit(2)).withColumn("sparse_limit", F.lit(1))
    few, whole = (ablation.search_parts(queries, chunks, encoders.hashed(), 24, planned=p) for p in (planned, None))
    rows = lambda hits: sorted(map(str, ablation.rankings(planned, hits).collect()))
    assert rows(few) == rows(whole) and few.count() < whole.count()
    assert few.where("source = 'sparse' AND strategy = 'bilingual_paired'").count() == 0 < whole.where("source = 'sparse' AND strategy = 'bilingual_paired'").count()
    assert few.groupBy("query_id", "source", "strategy", "language").count().agg(F.max("count")).first()[0] <= 2


def test_blocks_of_texts_and_queries_hold_the_best_of_all(monkeypatch):
    """Scores of a block are those of plain sums, whatever the number of frequent features, and the best of blocks those of all."""
    import numpy as np
    import pyarrow as pa

    from veristra.operators import parts

    monkeypatch.setattr(parts, "PRODUCTS", 50)
    rng = np.random.default_rng(0)
    known = np.sort(rng.choice(10_000, 60, replace=False))
    vector = lambda n: (np.sort(rng.choice(60, n, replace=False)), rng.random(n).round(1) + 0.1)
    texts, queries = [vector(n) for n in [0, *rng.integers(1, 20, 89)]], [vector(n) for n in [5, 0, *rng.integers(1, 15, 11)]]
    table = pa.table({"query_id": pa.array(range(100, 113)), "fids": pa.array([[*known[f], 10_001] for f, _ in queries]), "values": pa.array([[*v, 7.0] for _, v in queries])})
    full = lambda rows: np.array([np.bincount(f, v, 60) for f, v in rows])
    want = full(queries) @ full(texts).T
    for frequent in (0, 7, 60):
        column = np.full(60, -1, np.int32)
        column[rng.permutation(60)[:frequent]] = np.arange(frequent)
        asked, best = parts.Asked(table, known, column), parts.Best(13, 4, 9, True)
        for low in range(0, 90, 30):
            block = parts.Block([f.astype(np.int32) for f, _ in texts[low : low + 30]], [v for _, v in texts[low : low + 30]], column, asked)
            for first in (0, 8):
                scores = block.scores(asked, first, min(first + 8, 13))
                assert np.allclose(scores, want[first : first + 8, low : low + 30])
                best.add(3, first, np.arange(low, low + 30), scores)
        got = {q: list(zip(ids, scores, strict=True)) for b in best.batches(asked.names, 5) for q, ids, scores in zip(*(b.column(c).to_pylist() for c in ("query_id", "ids", "scores")), strict=True)}
        for q in range(13):
            order = sorted((t for t in range(90) if want[q, t] > 0), key=lambda t: (-round(want[q, t], 9), t))[:4]
            assert [t for t, _ in got.get(100 + q, [])] == order
            assert np.allclose([s for _, s in got.get(100 + q, [])], want[q, order])


def test_frequencies_by_batches_equal_those_by_rows(spark):
    from veristra.operators import parts

    rows = [(i, t) for i, t in enumerate(["red apples in 1999", "red apples in 1999", "ab", "", None, "whales 7 7"])]
    texts = spark.createDataFrame(rows, "chunk_id long, text string").repartition(3)
    forms = parts.forms(texts)
    want = retrieve.gram_frequency(retrieve.gram_features(forms, "chunk_id"))
    assert sorted(map(tuple, parts.frequencies(forms).collect())) == sorted(map(tuple, want.collect()))


def test_many_small_partitions_are_searched_in_few_tasks(spark):
    from veristra.operators import parts

    cores = spark.sparkContext.defaultParallelism
    chunks, queries = spark.createDataFrame([r for r in ROWS if r[0] is not None], CHUNKS), spark.createDataFrame(QUERIES, "query_id long, query string")
    dealt = chunks.repartition(5 * cores)
    assert parts.together(dealt).rdd.getNumPartitions() == cores and parts.together(chunks.coalesce(1)).rdd.getNumPartitions() == 1
    rows = lambda df: sorted(map(str, ablation.search_parts(queries, df, encoders.hashed(), 3).collect()))
    assert rows(dealt) == rows(chunks)
