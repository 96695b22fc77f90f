"""Batches by row position: every row once whatever breaks, in the files' own order, and no batch over changed files."""

import pytest
from pyspark.sql import functions as F

from veristra.sources import batches, io
from veristra.sources.publish import Folder


@pytest.fixture
def source(spark, tmp_path):
    """Three files of 40, 0 and 25 rows with a partition column, below a path with a space."""
    path = f"file://{tmp_path}/a table"
    rows = lambda low, high: spark.range(low, high).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text")).coalesce(1)
    for part, (low, high) in {"a": (0, 40), "b": (40, 40), "c": (40, 65)}.items():
        rows(low, high).write.parquet(f"{path}/part={part}")
    return path


def ids(df):
    return sorted((r.position, r.id, r.part) for r in df.collect())


def test_positions(spark, source):
    files = batches.files_of(spark, source)
    due = [(i, i, "a" if i < 40 else "c") for i in range(65)]
    assert files.rows == 65 and [(s, n) for _, s, n in files.starts] == [(0, 40), (40, 25)]
    assert ids(batches.batch(spark, files, 0, 1000)) == due
    assert ids(batches.batch(spark, files, 37, 6)) == due[37:43]
    assert ids(batches.batch(spark, files, 60, 50)) == due[60:]
    assert len(batches.batch(spark, files, 41, 3).inputFiles()) == 1
    assert batches.batch(spark, files, 65, 5).count() == 0
    assert batches.batch(spark, files, 1, 1).columns == ["id", "text", "part", "position"]
    for wrong in ((-1, 5), (0, 0)):
        with pytest.raises(ValueError):
            batches.batch(spark, files, *wrong)
    with pytest.raises(ValueError):
        batches.batch(spark, files, 0, 1, position="ID")


def test_a_broken_run_goes_on(spark, source, tmp_path):
    root, calls = f"file://{tmp_path}/out", []

    def handle(rows, number):
        calls.append(number)
        rows.write.mode("overwrite").parquet(f"{root}/batches/number={number}")
        if len(calls) == 3:
            raise InterruptedError

    with pytest.raises(FileNotFoundError):
        batches.copied(spark, root)
    with pytest.raises(InterruptedError):
        list(batches.each(spark, source, root, 10, handle))
    # the third batch is written but not finished
    assert batches.done(spark, root)["rows"] == 20 and batches.copied(spark, root).count() == 20
    assert list(batches.each(spark, source, root, 10, handle)) == [2, 3, 4, 5, 6] and calls == [0, 1, 2, 2, 3, 4, 5, 6]
    assert sorted(r.id for r in batches.copied(spark, root).collect()) == list(range(65))
    assert batches.copy(spark, source, root, 10) == 0


def test_added_and_changed_files(spark, source, tmp_path):
    root = f"file://{tmp_path}/out"
    assert batches.copy(spark, source, root, 50) == 2
    more = spark.range(65, 70).select("id", F.lit("x").alias("text")).coalesce(1)
    more.write.parquet(f"{source}/part=d")
    assert batches.copy(spark, source, root, 3) == 2
    assert sorted(r.id for r in batches.copied(spark, root).collect()) == list(range(70))
    more.write.mode("overwrite").parquet(f"{source}/part=a")
    with pytest.raises(ValueError):
        batches.copy(spark, source, root, 3)


def test_one_file_and_no_rows(spark, tmp_path):
    spark.range(9).coalesce(1).write.parquet(f"file://{tmp_path}/t")
    (file,) = [n for n in Folder(spark, f"file://{tmp_path}/t").names() if n.endswith(".parquet")]
    files = batches.files_of(spark, f"file://{tmp_path}/t/{file}")
    assert sorted(r.id for r in batches.batch(spark, files, 4, 3).collect()) == [4, 5, 6]
    spark.range(0).coalesce(1).write.parquet(f"file://{tmp_path}/none")
    assert batches.copy(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/out", 5) == 0
    assert batches.batch(spark, batches.files_of(spark, f"file://{tmp_path}/none"), 0, 5).count() == 0


def test_readers_and_writers_of_records(spark, tmp_path):
    """Fixtures by extension, canonical JSON, bundles, upserts and fingerprints."""
    df = spark.createDataFrame([(2, "b|\n", ["x"]), (1, None, None), (3, "ü", [])], "id long, name string, tags array<string>")
    root = f"file://{tmp_path}"
    io.write_bundle(df, f"{root}/bundle")
    assert sorted(r.value for r in spark.read.text(f"{root}/bundle/jsonl").collect()) == ['{"id":1}', '{"id":2,"name":"b|\\n","tags":["x"]}', '{"id":3,"name":"ü","tags":[]}']
    assert spark.read.option("header", True).csv(f"{root}/bundle/csv").columns == ["id", "name", "tags"]
    (tmp_path / "rows.jsonl").write_text('{"id":1,"name":"a"}\n{"id":2}\n')
    (tmp_path / "rows.json").write_text('[{"id":1,"name":"a"},\n{"id":2}]')
    (tmp_path / "rows.csv").write_text("id,name\n1,a\n2,\n")
    (tmp_path / "bad.csv").write_text("id,title\n1,a\n")
    schema = spark.createDataFrame([], "id long, name string").schema
    for kind in ("jsonl", "json", "csv"):
        assert sorted(map(tuple, io.fixture(spark, f"{root}/rows.{kind}", schema).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(Exception, match="header|CSV"):
        io.fixture(spark, f"{root}/bad.csv", schema).collect()
    with pytest.raises(ValueError):
        io.fixture(spark, f"{root}/rows.txt", schema)
    assert io.partition_path("r", "en", "dev", {"en": {"dev"}}) == "r/language=en/split=dev"
    for wrong in (("hi", "dev"), ("en", "test")):
        with pytest.raises(ValueError):
            io.partition_path("r", *wrong, {"en": {"dev"}})
    new = spark.createDataFrame([(2, "new", None), (9, "nine", None)], df.schema)
    assert sorted((r.id, r.name) for r in io.upsert(df, new, "id").collect()) == [(1, None), (2, "new"), (3, "ü"), (9, "nine")]
    with pytest.raises(Exception, match="duplicate key"):
        io.upsert(df, new.unionByName(new), "id").collect()
    assert io.fingerprint(df) == io.fingerprint(df.orderBy("id").repartition(3)) != io.fingerprint(df.limit(2))
    assert io.markdown([{"a": 0.5, "b": "x|y"}, {"a": None, "b": 3}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 0.5 | x\\|y |\n|  | 3 |"
    io.unique_or_fail(df, F.col("id"))
    with pytest.raises(ValueError):
        io.unique_or_fail(df, F.col("id") % 2)
    assert [(r.row_number, r.id) for r in sorted(io.numbered(df, "id").collect(), key=lambda r: r.row_number)] == [(0, 1), (1, 2), (2, 3)]
