"""Index builds that go on, take over and publish; frequency states that fold; files replaced in one step."""

import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from veristra.operators import chunking, frequency, indexing
from veristra.sources.publish import Folder

DOCS = "parent_id string, language string, source string"
SETTINGS = {"strategies": ["atomic", "sentence_window"]}


def chunk(docs):
    return chunking.atomic(docs).unionByName(chunking.sentence_windows(docs))


def documents(spark, change=None, drop=()):
    rows = [(str(i), "en", f"First of {i}. Then more. And an end! Or {change if change and change[0] == i else 'not'}?") for i in range(30) if i not in drop]
    return spark.createDataFrame([*rows, ("e", "en", ""), ("n", "en", None), (None, "en", "no key"), ("7", "en", rows[7][2])], DOCS)


def build(docs, root, chunk=chunk, **more):
    return indexing.build(docs, root, chunk, SETTINGS, **({"buckets": 8, "wave": 8} | more))


def rows(df):
    return sorted((r.chunk_id, r.text) for r in df.where("chunk_id IS NOT NULL").collect())


def files(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/parts/*/*/*.parquet")}


def test_builds_take_over_what_did_not_change(spark, tmp_path):
    root, docs = str(tmp_path), documents(spark)
    with pytest.raises(FileNotFoundError):
        indexing.current(spark, root)
    one = build(docs, root)
    assert rows(indexing.open_index(spark, root)) == sorted({*rows(chunk(docs))}) and one.kept == 0 and one.documents == docs.count()
    before = files(root)
    two = build(docs.repartition(5), root)
    assert (two.written, two.kept, two.build_id, two.checksum) == (0, one.written, one.build_id, one.checksum) and files(root) == before
    edited = documents(spark, change=(3, "so"), drop=(11,))
    three = build(edited, root)
    touched = {r[0] for r in spark.createDataFrame([("3",), ("11",)], "k string").select(indexing.bucket_of(F.col("k"), 8)).collect()}
    assert three.written == len(touched) and before.items() <= files(root).items()
    assert rows(indexing.open_index(spark, root)) == sorted({*rows(chunk(edited))})
    # other settings share no part, and old builds can still be read until they are cleared away
    old = indexing.current(spark, root)
    four = indexing.build(edited, root, chunking.atomic, {"strategies": ["atomic"]}, buckets=8, wave=8)
    assert four.kept == 0 and rows(indexing.open_index(spark, root, old)) == sorted({*rows(chunk(edited))})
    assert indexing.damaged(spark, root).count() == 0
    assert indexing.vacuum(spark, root) == one.written + three.written and indexing.vacuum(spark, root) == 0
    assert rows(indexing.open_index(spark, root)) == sorted({*rows(chunking.atomic(edited))})
    assert indexing.build(edited, root, chunking.atomic, {"strategies": ["atomic"]}, buckets=8).written == 0


def test_a_broken_build_goes_on_and_shows_nothing_of_itself(spark, tmp_path):
    root = str(tmp_path)
    first = build(documents(spark), root)
    changed, waves = documents(spark, change=(4, "so")).withColumn("source", F.concat("source", F.lit(" More."))), []

    def breaks(docs):
        waves.append(1)
        if len(waves) == 3:
            raise RuntimeError("lost")
        return chunk(docs)

    with pytest.raises(RuntimeError, match="lost"):
        build(changed, root, breaks, wave=2)
    assert rows(indexing.open_index(spark, root)) == sorted({*rows(chunk(documents(spark)))}) and indexing.current(spark, root)["build_id"] == first.build_id
    before = files(root)
    # a part that was written but not noted, as when the driver dies between both, is written again
    shutil.copytree(glob.glob(f"{root}/parts/bucket=1/*")[0], f"{root}/parts/bucket=1/print=p0")
    second = build(changed, root, wave=2)
    assert second.kept == 4 and second.written == first.written - 4
    assert before.items() <= files(root).items() and rows(indexing.open_index(spark, root)) == sorted({*rows(chunk(changed))})


def test_an_index_tells_damage_and_emptiness(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(ValueError, match="no documents"):
        build(documents(spark).limit(0), root)
    build(documents(spark), root, files=2)
    gone = next(f for f in files(root))
    os.remove(gone)
    assert [r.bucket for r in indexing.damaged(spark, root).collect()] == [int(gone.split("bucket=")[1].split("/")[0])]
    hollow = build(spark.createDataFrame([("a", "en", ""), ("b", "en", None)], DOCS), root)
    assert (hollow.chunks, hollow.documents) == (0, 2)
    with pytest.raises(ValueError, match="no chunks"):
        indexing.open_index(spark, root)


def test_files_are_replaced_whole(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "new"))
    assert folder.read("a") is None and folder.names() == [] and not folder.exists("a")
    for text in ("one", "é 日本\n", ""):
        folder.replace("a", text)
        assert folder.read("a") == text
    folder.replace_json("deep/b.json", {"x": [1, None], "a": "ü"})
    assert folder.read_json("deep/b.json") == {"x": [1, None], "a": "ü"} and folder.read("deep/b.json") == '{"a":"ü","x":[1,null]}'
    assert [n for n in folder.names() if not n.endswith(".crc")] == ["a", "deep"]


def state(spark, docs):
    found = [(i, f) for i, fs in docs for f in fs]
    return frequency.count(spark.createDataFrame(found, "id long, feature string"), len(docs))


def held(s):
    return {r.feature: r.df for r in s.frequency.collect()}, s.documents


def test_states_fold_in_any_parts(spark, tmp_path):
    docs = [(i, [f"f{j}" for j in range(7) if (i * 7 + j) % 3 == 0] + ["all"]) for i in range(20)] + [(20, []), (21, [None, "f1", "f1"])]
    whole = state(spark, docs)
    halves = frequency.fold(state(spark, docs[:9]), state(spark, docs[9:]))
    assert held(halves) == held(whole)
    assert held(frequency.fold(whole, state(spark, docs[9:]), -1)) == held(state(spark, docs[:9]))
    assert held(frequency.fold(whole, whole, -1)) == ({}, 0)
    root = str(tmp_path)
    frequency.save(whole, root)
    assert held(frequency.load(spark, root)) == held(whole)
    frequency.save(frequency.fold(frequency.load(spark, root), state(spark, docs[:2]), -1), root)
    assert held(frequency.load(spark, root)) == held(state(spark, docs[2:]))


def test_states_refuse_what_does_not_fit(spark, tmp_path):
    root, one = str(tmp_path), state(spark, [(1, ["a"]), (2, ["a", "b"])])
    with pytest.raises(FileNotFoundError):
        frequency.load(spark, root)
    with pytest.raises(ValueError, match="more documents"):
        frequency.fold(one, state(spark, [(i, []) for i in range(3)]), -1)
    with pytest.raises(Exception, match="doesn't hold"):
        frequency.fold(one, state(spark, [(1, ["c"])]), -1).frequency.collect()
    with pytest.raises(ValueError, match="differently"):
        frequency.fold(one, frequency.State(one.frequency, 1, {"kind": "words"}))
    frequency.save(one, root)
    with pytest.raises(ValueError, match="were made by"):
        frequency.load(spark, root, {"kind": "words"})
    folder = Folder(spark, root)
    header = folder.read_json("current")
    folder.replace_json("current", header | {"checksum": "0"})
    with pytest.raises(ValueError, match="was changed"):
        frequency.load(spark, root)
    folder.replace_json("current", header | {"version": 2})
    with pytest.raises(ValueError, match="version 2"):
        frequency.load(spark, root)


def test_checksums_of_many_chunks_fit_a_long(spark):
    """The sum of 100,000 ids of 48 set bits is beyond a long."""
    ids = spark.range(100_000).select(F.lit("f" * 64).alias("id"))
    assert ids.agg(indexing.checksum(F.col("id"))).first()[0] == 100_000 * (2**48 - 1) % indexing.CHECKSUMS
    assert ids.limit(0).agg(indexing.checksum(F.col("id"))).first()[0] == 0
    assert ids.limit(3).agg(indexing.checksum(F.col("id"))).first()[0] == 3 * (2**48 - 1)


def test_the_sql_of_rebuilds_writes_sharp_s_as_spark_does():
    """In capitals Spark writes ß as SS; the other engine's upper alone leaves one letter."""
    duckdb = pytest.importorskip("duckdb")
    from veristra.plans.index import _RUNS

    edit = _RUNS.split("CASE WHEN doc_id % 211 = 0 THEN ")[1].split(" ELSE")[0]
    assert duckdb.sql(f"SELECT {edit} FROM (SELECT 'Straße' AS text)").fetchall() == [("STRASSE!",)]
