"""Encoders as arguments: loaded once a worker, checked, bound to indexes; sections and search under them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristra.functions import encoders
from veristra.operators import chunking, indexing, retrieve

TEXTS = ["the red fox", "", None, "a blue fish swims far", "the red fox", "  ", "fox fox fox " * 400, "日本 語"]


def plain(text, dimension=64):
    v = encoders.signed_hashes(dimension, False)([text])[0]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size if size else 0.0 for x in v]


def counting(folder, dimension=2):
    """An encoder that leaves a file for each load and each call."""

    def load():
        import uuid

        open(f"{folder}/load-{uuid.uuid4().hex}", "w").close()

        def model(texts):
            open(f"{folder}/call-{len(texts)}-{uuid.uuid4().hex}", "w").close()
            return [[float(len(t)), 1.0] for t in texts]

        return model

    return encoders.Encoder("lengths", str(folder), dimension, load, query_prefix="query: ", passage_prefix="passage: ", unit=False, batch=3)


def test_vectors(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("embedding", F.lit(1))
    got = {r.id: r.embedding for r in encoders.encode(docs, encoders.hashed()).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] is None if t is None else np.allclose(got[i], plain(t))
    assert encoders.encode(docs.limit(0), encoders.hashed()).count() == 0


def test_model_is_loaded_once_and_batched(spark, tmp_path):
    encoder = counting(tmp_path)
    docs = spark.range(40).select("id", F.concat(F.lit("x"), (F.col("id") % 10).cast("string")).alias("text")).coalesce(1)
    for role, size in (("passage", 11), ("query", 9)):
        assert {tuple(r.v) for r in encoders.encode(docs, encoder, to="v", role=role).collect()} == {(float(size), 1.0)}
    names = sorted(p.name for p in tmp_path.iterdir())
    # ten distinct texts, three at a time, in each of two jobs; at most one load a worker
    assert sum(n.startswith("call-3") for n in names) == 6 and sum(n.startswith("call-1") for n in names) == 2
    assert 1 <= sum(n.startswith("load") for n in names) <= 2


def test_settings_and_bad_models(spark):
    one = encoders.hashed()
    other = encoders.Encoder(one.name, "2", one.dimension, one.load)
    assert one.fingerprint() == encoders.hashed().fingerprint() != other.fingerprint()
    assert encoders.Encoder(one.name, "1", 64, one.load, batch=7).fingerprint() == one.fingerprint()
    with pytest.raises(ValueError):
        encoders.vector_of(F.col("x"), one, "title")
    for model in (lambda texts: [[1.0]] * len(texts), lambda texts: [[float("nan"), 1.0]] * len(texts), lambda texts: [[1.0, 1.0]]):
        with pytest.raises(ValueError):
            encoders.encode_list(encoders.Encoder("bad", str(id(model)), 2, lambda model=model: model), ["a", "b"])


def test_sections_take_an_encoder(spark):
    text = "The cat sat down here. The cat sat up there. Prices rose by ten today. Prices fell by two later. The end is near now."
    docs = spark.createDataFrame([("a", "en", text), ("b", "en", "Too short."), ("c", "en", None), ("d", "en", text)], "parent_id string, language string, source string").coalesce(1)
    topic = encoders.Encoder("topic", "1", 2, lambda: lambda texts: [[1.0, 0.0] if "cat" in t else [0.0, 1.0] for t in texts])
    spans = lambda df: {p: sorted((r.span_start, r.span_end) for r in df.where(F.col("parent_id") == p).collect()) for p in "abcd"}
    got = spans(chunking.semantic_sections(docs, topic, least=2, quantile=0.0))
    assert got["a"] == got["d"] and got["b"] == got["c"] == []
    # the least similar neighbours, sentences two and three, are parted
    assert got["a"] == [(0, text.index(" Prices rose")), (text.index("Prices rose"), len(text))]


def test_index_is_bound_to_its_encoder(spark, tmp_path):
    rows = [(str(i), "en", f"word{i % 7} other{i % 3} and {i}") for i in range(40)] + [("e", "en", ""), ("n", "en", None)]
    docs = spark.createDataFrame(rows, "parent_id string, language string, source string")
    root, one = f"file://{tmp_path}/index", encoders.hashed(32)
    go = lambda encoder: indexing.build(docs, root, chunking.atomic, {"strategies": ["atomic"]}, buckets=4, wave=4, encoder=encoder)
    first = go(one)
    assert (first.written, first.chunks) == (4, 40) and go(one).written == 0
    queries = spark.createDataFrame([(5, "word3 other2"), (9, None), (11, "")], "query_id long, query string")
    got = indexing.search(spark, root, queries, one, 3).orderBy("query_id", "rank").collect()
    held = {r.chunk_id: (r.parent_id, plain(r.text, 32)) for r in indexing.open_index(spark, root).collect()}
    asked = plain("word3 other2", 32)
    due = sorted((-round(sum(a * b for a, b in zip(asked, v, strict=True)), 12), c, p) for c, (p, v) in held.items())[:3]
    assert [(r.query_id, r["rank"], r.chunk_id, r.parent_id) for r in got] == [(5, i, c, p) for i, (_, c, p) in enumerate(due, 1)]
    narrowed = indexing.search(spark, root, queries, one, 50, where=F.col("parent_id").cast("int") < 10)
    assert narrowed.count() == 10
    other = encoders.Encoder(one.name, "2", 32, one.load)
    with pytest.raises(ValueError):
        indexing.search(spark, root, queries, other, 3)
    changed = go(other)
    assert changed.written == 4 and changed.build_id != first.build_id
    assert indexing.search(spark, root, queries, other, 3).count() == 3
    with pytest.raises(ValueError):
        indexing.build(docs, root, chunking.atomic, {"encoder": "x"}, encoder=one)


def test_hybrid_search_takes_an_encoder(spark):
    chunks = spark.createDataFrame([(1, 1, "red fox jumps"), (2, 1, "red fox sleeps"), (3, 2, "blue whale swims"), (4, 3, None), (5, 4, "")], "chunk_id long, parent_id long, text string")
    queries = spark.createDataFrame([(1, "explain the red fox jumps"), (2, ""), (3, None), (None, "red")], "query_id long, query string")
    found = retrieve.hybrid_search(queries, chunks, encoders.hashed()).collect()
    mine = sorted((r["rank"], r.chunk_id) for r in found if r.query_id == 1)
    assert mine[0] == (1, 1) and {r.parent_id for r in found} <= {1, 2} and {r.query_id for r in found} == {1}
    assert len({r.parent_id for r in found}) == len(found)
    assert retrieve.hybrid_search(queries, chunks.limit(0), encoders.hashed()).count() == 0
    assert retrieve.hybrid_search(queries.limit(0), chunks, encoders.hashed()).count() == 0
