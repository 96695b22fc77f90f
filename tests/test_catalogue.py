"""Strict catalogues: rules row by row, and CSV with a fixed header."""

import os
import tempfile

import pytest

from veristra.operators import records
from veristra.sources import io

RULES = records.Rules(texts=("said",), numbers=("seq",), values=(("lang", ("en", "hi")),), unique=(("said",), ("session", "seq")), contiguous=("seq",))
SCHEMA = "id string, said string, seq string, lang string, session string, fault string"


def test_faults_of_a_catalogue(spark):
    rows = [
        ("a", "one", "1", "en", "s", "x"),
        ("b", "two", " 2 ", "hi", "s", None),
        ("c", "two", "4", "EN", "t", None),
        ("d", " ", "0", None, "t", None),
        ("e", None, "x", "en", None, None),
        ("f", "six", "1", "en", "s", None),
        (None, "seven", "9" * 30, "en", "u", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.id or "", r.fault) for r in records.catalogue_faults(df, "id", RULES).collect())
    assert got == sorted([
        ("", "gap:seq"), ("", "number:seq"), ("a", "repeated:session+seq"), ("b", "repeated:said"), ("c", "repeated:said"), ("c", "value:lang"),
        ("d", "missing:said"), ("d", "number:seq"), ("d", "value:lang"), ("e", "missing:said"), ("e", "number:seq"), ("f", "repeated:session+seq"),
    ])
    assert records.catalogue_faults(df.limit(0), "id", RULES).count() == 0
    assert records.catalogue_faults(df.where("id IN ('a', 'b')"), "id", RULES).count() == 0
    assert records.catalogue_faults(df, "id", records.Rules()).count() == 0


def test_csv_with_a_fixed_header(spark):
    root = tempfile.mkdtemp(prefix="veristra-")

    def file(name, text):
        path = os.path.join(root, name)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return path

    good = file("good.csv", 'id,said\n1,"two\nlines, ""quoted"""\n2,\n')
    assert [tuple(r) for r in io.strict_csv(spark, good, ("id", "said")).collect()] == [("1", 'two\nlines, "quoted"'), ("2", None)]
    for name, text in (("case.csv", "ID,said\n1,a\n"), ("order.csv", "said,id\n1,a\n"), ("more.csv", "id,said,x\n1,a,b\n"), ("none.csv", "")):
        with pytest.raises(ValueError, match="header"):
            io.strict_csv(spark, file(name, text), ("id", "said"))
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        io.strict_csv(spark, file("long.csv", "id,said\n1,a,b\n"), ("id", "said")).collect()
