"""The full audit against plain Python, and its edge cases."""

from veristra.operators import reports


def test_full_audit(spark):
    rows = [(1, "a b", "en", "s", 7), (2, "a b", "en", "t", None), (3, "", None, "s", 1), (4, None, None, None, 1), (5, "a b", None, "s", 2), (5, "a b", None, "s", 2), (6, "word " * 10, "en", "t", 3)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string, source string, __0 int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (3, 1), (5, 7), (99, 1), (None, 1)], "id long, label int")
    got = {}
    for r in reports.full_audit(docs, labels, "id", "lang", short=5).collect():
        assert (r.whole, r.lang, r.section, r.name) not in got
        got[r.whole, r.lang, r.section, r.name] = r.value
    en, none, whole = [r for r in rows if r[2] == "en"], [r for r in rows if r[2] is None], rows
    marks = {1: [1], 2: [0, None], 3: [1], 5: [7]}
    for scope, mine in (((False, "en"), en), ((False, None), none), ((True, None), whole)):
        of = lambda s, n, scope=scope: got[(*scope, s, n)]
        texts = [r[1] for r in mine if r[1] is not None]
        sizes = sorted(map(len, texts))
        assert of("rows", "rows") == len(mine)
        assert of("field", "missing:source") == sum(r[3] is None for r in mine)
        assert of("field", "missing:__0") == sum(r[4] is None for r in mine)
        assert of("field", "empty:text") == sum(t == "" for t in texts)
        assert of("length", "p50") == sizes[-(-len(sizes) // 2) - 1] and of("length", "greatest") == sizes[-1]
        assert of("length", "short") == sum(s < 5 for s in sizes)
        assert of("copies", "different") == len(set(texts)) and of("copies", "surplus") == len(texts) - len(set(texts))
        assert of("copies", "reused") == sum(len({r[3] for r in mine if r[1] == t}) > 1 for t in set(texts))
        found = [m for k in {r[0] for r in mine} for m in marks.get(k, [])]
        assert of("label", "positive") == found.count(1) and of("label", "negative") == found.count(0)
        assert of("label", "invalid") == sum(m not in (0, 1) for m in found)
        valid = found.count(0) + found.count(1)
        assert of("label", "ratio") == (found.count(1) / valid if valid else None)
    assert reports.full_audit(docs.limit(0), labels, "id", "lang").count() == 0
    assert reports.full_audit(docs, labels.limit(0), "id", "lang").where("section = 'label'").count() == 0
