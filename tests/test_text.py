from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veristra.functions import language as L
from veristra.functions import text as X


@given(st.text(alphabet="ab .!?1\"'”)", max_size=60))
@settings(max_examples=200, deadline=None)
def test_sentence_spans_hold_all_but_white_space(text):
    spans = X.split_sentences(text)
    assert all(text[a:b] == s for s, a, b in spans)
    assert "".join(s for s, _, _ in spans).replace(" ", "") == text.replace(" ", "")


def test_sentence_boundaries():
    ends = lambda t: [s for s, _, _ in X.split_sentences(t)]
    assert ends("It is 3.5 high. Yes.") == ["It is 3.5 high.", "Yes."]
    assert ends("Dr. Rao came. He left.") == ["Dr. Rao came.", "He left."]
    assert ends("See http://a.b/c.d now. Ok") == ["See http://a.b/c.d now.", "Ok"]
    assert ends("The U.S. economy grew. Fine.")[0] == "The U.S. economy grew."


@given(st.text(alphabet="aेकb", max_size=40), st.integers(1, 7))
@settings(max_examples=100, deadline=None)
def test_cut_at_marks_rebuilds(text, most):
    pieces = X.cut_at_marks(text, most)
    assert "".join(p for p, _, _ in pieces) == text and all(len(p) <= most for p, _, _ in pieces)


def test_forms(spark):
    df = spark.createDataFrame([("  A b ,c ( d  Straße",), (None,), ("",)], "t string")
    rows = df.select(X.normalized(F.col("t")).alias("n"), X.plain_matching(F.col("t")).alias("m"), X.matching(F.col("t")).alias("u")).collect()
    assert rows[0].n == "A b,c (d Straße" and rows[0].m == rows[0].u == "a b c d strasse"
    assert rows[1].n == rows[2].n == ""


def test_language(spark):
    df = spark.createDataFrame([("hello", None), ("यह क्या है", None), ("hello यह", None), ("123", None), ("mera naam kya hai", "hi")], "t string, h string")
    rows = [r.a for r in df.select(L.analyze(F.col("t"), F.col("h")).alias("a")).collect()]
    assert [r.language for r in rows] == ["en", "hi", "hi-en", "unknown", "hi"]
    assert rows[1].ambiguous and rows[2].code_mixed
    roman = df.select(L.roman_hindi(F.col("t"), F.col("h")).alias("r")).collect()
    assert [r.r for r in roman] == [False, False, False, False, True]
    assert df.select(L.rewritten(F.col("t")).alias("x")).collect()[4].x == "mera naam क्या है"
    tags = spark.createDataFrame([("hin_Deva",), ("en-US",), ("xx",), (None,)], "t string")
    assert [r[0] for r in tags.select(L.language_of_tag(F.col("t"))).collect()] == ["hi", "en", "unknown", "unknown"]
