"""Dense and n-gram search against plain forms: nulls, empty and long texts, ties, chunks, pruning."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristra.operators import retrieve


def _form_tables(spark):
    rng = random.Random(5)
    words = "the of and thing other than hand in er ly tion".split()
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(rng.randrange(1, 60))) for _ in range(90)]
    texts += [None, "", "ab", "   ", "日本 語 12/3 12/3", "x" * 3000, texts[3], texts[3]]
    found = spark.createDataFrame([*enumerate(texts), (None, "the hand")], "id long, form string")
    asked = spark.createDataFrame([(1, texts[3]), (2, "nothing like it"), (3, ""), (4, None), (5, "日本"), (6, texts[40] + " the of"), (None, "the"), (7, "12/3")], "query_id long, form string")
    return found, asked


@pytest.mark.parametrize(("most", "chunk"), [(retrieve.MANY, retrieve.CHUNK_FEATURES), (10, 1000)])
def test_gram_search_agrees_with_the_weighted_index(spark, most, chunk):
    found, asked = _form_tables(spark)
    keyed = found.where("id IS NOT NULL")
    counted = retrieve.features(keyed, "id")
    frequency, total = retrieve.document_frequency(counted), keyed.count()
    queries = retrieve.tfidf(retrieve.features(asked.where("query_id IS NOT NULL"), "query_id"), frequency, total, "query_id")
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    for k in (4, 200):
        plain = rows(retrieve.sparse_search(queries, retrieve.tfidf(counted, frequency, total, "id"), k, "id"))
        assert rows(retrieve.gram_search(asked, found, k, "id", most=most, chunk=chunk)) == plain
    assert retrieve.gram_search(asked, found.limit(0), 3, "id").count() == 0
    assert retrieve.gram_search(asked.limit(0), found, 3, "id").count() == 0


def test_gram_counts_of_long_forms_go_by_steps():
    form, exact = "ab  cd " * 300 + "é日本𝒳 " * 50 + " " * 9 + "end", np.array([7, 7, -3], np.int64)
    whole = retrieve.gram_counts(form, exact)
    padded = f" {form} "
    grams = collections.Counter(padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1) if padded[i : i + n].strip(" "))
    assert sorted(whole[1].tolist()) == sorted([*grams.values(), 4, 2])
    for step in (1, 2, 5, 64, 999):
        assert all((a == b).all() for a, b in zip(retrieve.gram_counts(form, exact, step), whole, strict=True))


def test_postings_prune_exactly():
    """Uneven features: most products are those of a few frequent ones, and few texts need them."""
    rng = np.random.default_rng(3)
    n, k = 3000, 10
    share = np.concatenate((np.full(20, 0.5), np.full(3000, 0.01)))
    rows = [np.flatnonzero(rng.random(len(share)) < share) for _ in range(n)]
    values = [np.where(r < 20, 0.3, 2.0) * (0.5 + rng.random(len(r))) for r in rows]
    values = [v / np.sqrt((v * v).sum()) for v in values]
    block = retrieve.Postings(np.arange(n) * 7, np.concatenate(rows) * 5, np.array([len(r) for r in rows]), np.concatenate(values))
    asked = [np.append(rows[i] * 5, 10**6) for i in range(0, n, 100)]
    weights = [np.append(values[i], 0.1) for i in range(0, n, 100)]
    matrix = np.zeros((n, len(share)))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        matrix[i, r] = v
    products = 0
    for (ids, scores), f, w in zip(block.search(asked, weights, k), asked, weights, strict=True):
        want = matrix[:, f[:-1] // 5] @ w[:-1]
        products += int((matrix[:, f[:-1] // 5] > 0).sum())
        best = np.lexsort((np.arange(n), -np.round(want, 9)))[:k]
        order = np.lexsort((ids, -np.round(scores, 9)))[:k]
        assert ids[order].tolist() == (best * 7).tolist() and np.allclose(scores[order], want[best])
    assert block.completed < 0.25 * n * len(asked)
    assert block.products + block.completed * 10 < 0.75 * products


def test_dense_search_goes_by_chunks_and_lengths(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 3 + i % 2).astype(float).tolist()) for i in range(60)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    good = {i: np.array(v) for i, v in rows[:60] if np.any(v)}

    def brute(q):
        score = {i: round(float(v @ good[q] / np.sqrt((v @ v) * (good[q] @ good[q]))), 12) for i, v in good.items() if i != q and len(v) == len(good[q])}
        return sorted(score, key=lambda i: (-score[i], i))[:4]

    for chunk in (10**6, 8):
        monkeypatch.setattr(retrieve, "CHUNK", chunk)
        got = collections.defaultdict(dict)
        for r in retrieve.dense_search(df.where("vec_id < 6 OR vec_id IS NULL OR vec_id > 99"), df, 4).collect():
            got[r.query_id][r["rank"]] = r.vec_id
        assert {q: [x for _, x in sorted(v.items())] for q, v in got.items()} == {q: brute(q) for q in range(6) if q in good}


def test_gram_search_by_small_blocks_stores_no_grams(spark, monkeypatch):
    """Blocks are made where texts are read: any size gives the same rows, and no exchange carries grams of texts."""
    found, asked = _form_tables(spark)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    found = found.repartition(3)
    whole = retrieve.gram_search(asked, found, 5, "id")
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and not any("fids" in line or "values" in line for line in plan.splitlines() if "Exchange" in line)
    for texts, features in ((1, 10**6), (4, 300), (7, 5000), (10**4, 1)):
        monkeypatch.setattr(retrieve, "BLOCK_TEXTS", texts)
        monkeypatch.setattr(retrieve, "BLOCK_FEATURES", features)
        monkeypatch.setattr(retrieve, "GRAM_TEXTS", 9)
        assert rows(retrieve.gram_search(asked, found, 5, "id")) == rows(whole)


def test_floors_leave_out_only_what_others_beat():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(200) < 0.1) for _ in range(300)]
    block = retrieve.Postings(np.arange(300), np.concatenate(rows), np.array([len(r) for r in rows]), np.concatenate([np.full(len(r), 1 / np.sqrt(max(1, len(r)))) for r in rows]))
    asked, weights = [rows[0], rows[1]], [np.full(len(rows[i]), 0.3) for i in (0, 1)]
    for (ids, scores), (few, left), floor in zip(block.search(asked, weights, 10), block.search(asked, weights, 10, [0.6, 99.0]), (0.6, 99.0), strict=True):
        assert set(ids[scores >= floor]) <= set(few)


@pytest.mark.parametrize("most", [retrieve.MANY, 10])
def test_squares_of_grams_agree_with_named_features(spark, most):
    found, _ = _form_tables(spark)
    keyed = found.where("id IS NOT NULL")
    named, counted, total = retrieve.features(keyed, "id"), retrieve.gram_features(keyed, "id"), keyed.count()
    raw = named.join(retrieve.document_frequency(named), "feature").select("id", ((1 + F.log("n")) * (F.log(F.lit(total + 1) / (F.col("df") + 1)) + 1)).alias("raw"))
    rows = lambda df: sorted((r.id, r.features, round(r.square, 6)) for r in df.collect())
    want = rows(raw.groupBy("id").agg(F.count("*").alias("features"), F.sum(F.col("raw") * F.col("raw")).alias("square")))
    assert rows(retrieve.gram_squares(counted, retrieve.gram_frequency(counted), total, "id", most)) == want


def test_dense_search_works_out_vectors_once(spark):
    """Vectors from Python are made once a row, and those without a direction are left out where they are multiplied."""
    from veristra.functions import encoders

    texts = spark.createDataFrame([(0, "rain on hills"), (1, "rain on hills"), (2, ""), (3, None), (4, "rain in town")], "vec_id long, text string")
    base = encoders.encode(texts, encoders.hashed())
    found = retrieve.dense_search(base, base, 3)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect())
    assert got == [(0, 1, 1), (0, 2, 4), (1, 1, 0), (1, 2, 4), (4, 1, 0), (4, 2, 1)]


def test_text_frequency_makes_no_row_for_a_gram_of_a_text(spark):
    """Counted by batches it is what the features of texts give, also with many different signs and with none."""
    from veristra.operators import frequency

    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 5000)))
    forms = ["rain on 12 hills", "rain on 12 12 hills", "", "a", "ab", "日本語 x 3.5", "straße   x", wide, wide[:9] + " rain", None, "a\x00b\x00"]
    texts = spark.createDataFrame(list(enumerate(forms)), "id long, form string")
    got, found = retrieve.text_frequency(texts, "id"), retrieve.features(texts, "id")
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    state = frequency.of_texts(texts)
    want = {r.feature: r.df for r in retrieve.document_frequency(found).collect()}
    assert {r.feature: r.df for r in got.collect()} == want == {r.feature: r.df for r in state.frequency.collect()}
    assert state.documents == frequency.count(found, len(forms)).documents


def test_copies_of_a_text_do_not_pile_up(spark, monkeypatch):
    """Of texts of equal score a task hands over the k of smallest keys, however many blocks they lie in."""
    monkeypatch.setattr(retrieve, "BLOCK_TEXTS", 50)
    handed, plain = [], retrieve.best
    monkeypatch.setattr(retrieve, "best", lambda scored, k, *order: handed.append(scored.count()) or plain(scored, k, *order))
    texts = spark.createDataFrame([(i, "blue lamp on the table" if i % 3 else f"green chair {i}") for i in range(900, 0, -1)], "id long, form string").coalesce(1)
    asked = spark.createDataFrame([(1, "a blue lamp"), (2, "green chair 3")], "query_id long, form string")
    got = {(r.query_id, r["rank"]): r.id for r in retrieve.gram_search(asked, texts, 4, "id").collect()}
    assert [got[1, i] for i in range(1, 5)] == [1, 2, 4, 5] and got[2, 1] == 3
    assert handed[0] <= 2 * 4 * 3
