"""Forbidden names at any depth of a row."""

from pyspark.sql import functions as F

from veristra.operators import records


def test_leaks_are_found_at_any_depth(spark):
    schema = "id long, text string, answer string, meta struct<Label:int, more:map<string, array<struct<a:int, Query:string>>>>, path string"
    rows = [
        (1, "plain", None, None, None),
        (2, "plain", "x", (None, {"ok": [(1, None)]}), None),
        (3, '{"a": [1, {"ANSWER": null}]}', None, (7, {"Query": [(1, "q"), (2, None)], "x": None}), "p"),
        (4, ' [{"x": "{\\"label\\": {\\"query\\": 1}}"}]', None, (None, {}), "[1, 2"),
        (5, '{"answer": 1, "answer": 2}', None, (None, {"n": None}), '{"label" : broken'),
        (6, '{"text": "an answer: no"}', "", None, '"answer": 1'),
        (None, "{}", None, None, '{"query":[]}'),
    ]
    df = spark.createDataFrame(rows, schema)
    df = df.unionByName(df.where("id = 2"))
    got = sorted((r.id, r.path, r.field) for r in records.leaks(df, "id", ("query", "Answer", "label")).where("id IS NOT NULL").collect())
    want = [
        ("2", "answer", "answer"), ("2", "answer", "answer"),
        ("3", "meta.Label", "label"), ("3", "meta.more.Query", "query"), ("3", "meta.more.Query[0].Query", "query"), ("3", "text.a[1].ANSWER", "answer"),
        ("4", "text[0].x.label", "label"), ("4", "text[0].x.label.query", "query"),
        ("5", "path~", "label"), ("5", "text~", "answer"), ("6", "answer", "answer"),
    ]
    assert got == want
    assert [(r.id, r.path) for r in records.leaks(df, "id", ("query",)).where("id IS NULL").collect()] == [(None, "path.query")]
    assert records.leaks(df.limit(0), "id", ("query",)).count() == 0
    assert records.leaks(df.select("id", F.col("text").alias("fine")).where("id = 1"), "id", ("query",)).count() == 0
