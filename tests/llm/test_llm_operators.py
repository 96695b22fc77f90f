"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


from veristra.llm import ann, licenses, minhash, mixing, packing, quality, sharding, substring, toxicity, urls
from veristra.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, key string"


def _texts():
    rng = random.Random(3)
    w = lambda n: " ".join(rng.choice("ab cd ef gh ij kl mn op qr st uv wx".split()) + str(rng.randrange(40)) for _ in range(n))
    base, passage = w(120), w(50)
    near = base.split()
    near[60] = "changed"
    return [None, "", "  \n\t ", "one", "One", "two words", base, base, " ".join(near), base.upper(), w(20) + " " + passage + " " + w(30), passage + "\n" + w(40), w(3000), "x y " * 60, "é ü 日本", *[w(rng.randrange(5, 90)) for _ in range(25)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", len(t or ""), 9, "clash") for i, t in enumerate(_texts())]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards(docs, none):
    got = sharding.plan_shards(docs.drop("size", "key"), 4).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == docs.count()
    shard = {}
    slots = collections.defaultdict(list)
    for r in got:
        t = text[r.doc_id]
        assert r["size"] == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
        assert shard.setdefault(t, r.shard) == r.shard
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.plan_shards(none, 4).count() == 0


def test_minimax_is_optimal(spark):
    rng = random.Random(1)
    for n, shards in ((1, 3), (7, 3), (60, 5), (400, 8)):
        groups = sorted((rng.randrange(1 << 63), rng.randrange(1, 1000)) for _ in range(n))
        cuts, capacity = sharding.minimax_cuts(spark.createDataFrame(groups, "key long, bytes long"), shards)
        load = collections.Counter()
        for k, b in groups:
            load[sum(k >= c for c in cuts)] += b
        assert max(load.values()) <= capacity

        def fits(c):
            used, held = 1, 0
            for _, b in groups:
                if held + b > c:
                    used, held = used + 1, 0
                held += b
            return used <= shards

        largest = max(b for _, b in groups)
        assert fits(capacity) and (capacity == largest or not fits(capacity - 1))


def test_near_duplicates(docs, none):
    def sets(t):
        w = (t or "").encode().lower().split()
        return frozenset(zip(w, w[1:], strict=False)) if len(w) > 1 else frozenset([tuple(w)] if w else [])

    s = {r.doc_id: sets(r.text) for r in docs.collect()}
    part = {i: i for i in s}
    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
            old, new = max(part[a], part[b]), min(part[a], part[b])
            part = {k: new if v == old else v for k, v in part.items()}
    got = minhash.near_duplicates(docs, 2, 80).collect()
    assert len(got) == docs.count()
    assert all((r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), part[r.doc_id], part[r.doc_id] == r.doc_id) for r in got)
    assert minhash.near_duplicates(none).count() == 0


def test_substrings(docs, none):
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in docs.collect()]
    seen = collections.Counter(tuple(w[i : i + 35]) for _, w in rows for i in range(len(w) - 34))
    want = {}
    for i, w in rows:
        covered = [False] * len(w)
        for j in range(len(w) - 34):
            if seen[tuple(w[j : j + 35])] > 1:
                covered[j : j + 35] = [True] * 35
        kept = b" ".join(x for x, c in zip(w, covered, strict=True) if not c)
        want[i] = (len(w), sum(covered), hashlib.sha256(kept).hexdigest())
    got = substring.repeated_words(docs).collect()
    assert len(got) == len(rows) and all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in got)
    assert sum(v[1] > 0 for v in want.values()) >= 5
    assert substring.repeated_words(none).count() == 0
    left = {r.doc_id: r for r in substring.drop_repeats(docs).collect()}
    assert 6 not in left and 12 in left


def test_quality(docs, none):
    for r in quality.score_documents(docs).collect():
        t = next(x.text for x in docs.collect() if x.doc_id == r.doc_id) or ""
        w = WORD.findall(t)
        count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        m = r.measures
        assert (m.n_words, m.word_chars, m.n_repeat_words) == (len(w), sum(map(len, w)), len(covered))
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r.kept and r.base_failed)
    assert quality.score_documents(none).count() == 0 and quality.keep_good(none).count() == 0


def test_mixture(docs, none):
    plan = mixing.plan_mixture(docs).collect()
    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs.collect()}
    assert len(plan) == docs.count() and all(r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] for r in plan)
    target = {r.source: r.target for r in plan}
    assert abs(sum(target.values()) - sum(r["size"] for r in plan)) < 1e-6
    for s, t in target.items():
        own = [r for r in plan if r.source == s]
        assert t <= 3 * own[0].source_size + 1e-9 and abs(sum(r.taken for r in own) - t) <= 2 * max(r["size"] for r in own)
    again = {(r.doc_id, r.taken) for r in mixing.plan_mixture(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in plan}
    assert mixing.mix(docs).columns == docs.columns and mixing.plan_mixture(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack_documents(docs, tokenizer_file(), ids=True).collect()
    library = packing.encoder(tokenizer_file()).library
    whole = collections.defaultdict(list)
    for r in rows:
        whole[r.doc_id].append((r.start, r.ids))
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for r in docs.dropDuplicates(["doc_id"]).collect():
        want = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert b"".join(x for _, x in sorted(set(whole[r.doc_id]))) == want
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert packing.pack_documents(none, tokenizer_file()).count() == 0


def test_word_encoder_equals_library():
    e = packing.encoder(tokenizer_file())
    for t in ("Don't STOP <|endoftext|> it", "naïve ΣΑΣ İ ½ x² a\x1fb", "日本語 we'll'd 12345", "a" * 300, "", " x y", "THE### %%% the,"):
        assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == e.library.encode(t, add_special_tokens=False).ids


def test_word_encoder_on_slices_and_in_small_groups(monkeypatch):
    e = packing.encoder(tokenizer_file())
    rng = random.Random(6)
    signs = "abcstrevmld''''  \n\t0123½²ªºßİŞéÈñ!#%$<|>\xa0\xad \x1c\x1f\x85\x00\x7f日本Σς̇ẞȺɐ🙂"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", None, "'", "x're've's's", "''s", "a'", "1'll"]
    want = [b"" if t is None else np.array(e.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    held = pa.array(["before"] * 9 + texts, pa.string()).slice(9)
    for together in (1 << 22, 100, 1):
        monkeypatch.setattr(packing, "TOGETHER", together)
        assert [x for low in range(0, len(held), 300) for x in e.encode(held.slice(low, 300))] == want


def test_word_encoder_keeps_the_words_that_recur(monkeypatch):
    """Words that are met once don't push out those of every batch."""
    monkeypatch.setattr(packing, "CACHE", 800)
    e = packing.WordEncoder(tokenizer_file())
    made, merge = collections.Counter(), e._merge
    monkeypatch.setattr(e, "_merge", lambda parts: made.update(parts) or merge(parts))
    spell = lambda n: "".join(chr(97 + n // 26**k % 26) for k in range(4))
    often = ["often" + spell(i) for i in range(50)]
    for batch in range(40):
        e.encode([" ".join([*often, *("once" + spell(100 * batch + i) for i in range(100))])])
    assert all(made[w.encode()] == 1 for w in often) and len(made) >= 4050


def test_forest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 6), (902, [1.0, None] * 3), (903, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    # a share of 1 looks at all rows: the exact answer, ties included
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 10, share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q in range(0, 300, 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        assert got[q] == np.lexsort((np.arange(300), -s))[:10].tolist()
    assert ann.search(df.limit(0), df, 5).count() == 0


def test_licenses(spark):
    rows = [(1, "a/b/x.py", "code\nReleased under the MIT License.\nmore"), (2, "a/LICENSE", "This work is licensed under the GNU General Public License, version 3."), (3, "a/b/c/y.py", "nothing here"), (4, "z/w.py", None), (5, None, "All rights reserved."), (6, "a/v.py", "")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1].effective_license == "MIT" and got[2].is_license_file and got[5].license == "Proprietary"
    assert (got[3].effective_license, got[3].inherited_from) == ("GPL-3.0", "a") and got[6].effective_license == "GPL-3.0"
    assert got[4].effective_license is None and len(got) == 6


def test_licenses_of_a_hot_folder(spark):
    rows = [(0, "a/LICENSE", "Released under the MIT License."), *[(i, f"a/b/{i}.txt", "plain words") for i in range(1, 301)], *[(7, "a/b/7.txt", "plain words")] * 3, (400, "c/d.txt", "plain words")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()
    assert len(got) == len(rows)
    assert all((r.effective_license, r.inherited_from) == ("MIT", "a") for r in got if 0 < r.doc_id < 400)
    assert [r.effective_license for r in got if r.doc_id == 400] == [None]


def test_licenses_of_wrapped_headers():
    import textwrap

    scanner = licenses.Scanner({t: 3.0 for t in licenses.VOCABULARY}, 6.0)
    prose = [f"value{i} = compute{i}(other{i}, third{i})" for i in range(150)]
    for name, width in itertools.product(("MIT", "GPL-3.0", "Apache-2.0"), (80, 60, 40)):
        notice = max((text for n, text in licenses.TEMPLATES if n == name and len(text) < 400), key=len)
        lines = [*prose[:50], *[f"# {x}" for x in textwrap.wrap(notice, width)], *prose[50:]]
        found, score, whole = scanner.scan("\n".join(lines))
        assert (found, whole < licenses.THRESHOLD) == (name, True) and score > 0.99, (name, width)
    assert scanner.scan("\n".join([*prose, "free", *prose]))[0] is None


def test_neighbouring_licenses():
    scanner = licenses.Scanner({t: 3.0 for t in licenses.VOCABULARY}, 6.0)
    for name, text in licenses.TEMPLATES:
        if not text.startswith("Redistribution") or len(text) > 200:
            assert scanner.scan(text)[0] == name, text
            assert scanner.scan("Copyright 2020 Ann Other\n\n" + text.replace(". ", ".\n").replace(", ", ",\n"))[0] == name, text
    opening = next(text for name, text in licenses.TEMPLATES if name == "BSD-3-Clause")
    assert scanner.scan(opening)[0] is None and scanner.scan("Licensed under the GNU General Public License")[0] is None
    told = {name for name, _ in licenses.TEMPLATES}
    assert told >= {"GPL-2.0", "LGPL-2.1", "AGPL-3.0", "BSD-2-Clause", "ISC", "CC-BY-SA-4.0", "CC-BY-ND-4.0", "CC0-1.0", "Unlicense"}


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("red blue green tree house river stone cloud".split()) for _ in range(20)) + (" idiot" if i % 3 == 0 else "")) for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels, toxicity.third)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(scored) == 302 and all((scored[i] >= 0.7) == (i % 3 == 0) for i in held)
    assert 0 <= scored[900] <= 1 and scored[900] == scored[901]
    assert toxicity.train([]).score("x") <= 0.5


def test_toxic_pairs(spark):
    """Which of two insults meets which of two groups decides: additive weights judge all four pairs alike."""
    rng = random.Random(5)
    pairs = list(itertools.product(("aaa", "bbb"), ("ccc", "ddd")))
    toxic = {("aaa", "ccc"), ("bbb", "ddd")}
    text = lambda pair: " ".join([*rng.choices("red blue green tree house river stone cloud".split(), k=12), *pair])
    known = [(int(p in toxic), text(p)) for p in [*rng.choices(pairs, k=3000), *[()] * 3000]]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(known)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (y, _) in enumerate(known)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, toxicity.third)
    right = [sum((m.score(text(p)) >= toxicity.THRESHOLD) == (p in toxic) for p in pairs * 50) / 200 for m in (model, toxicity.FactorizationMachine(model.bias, model.terms, model.weights, model.factors * 0))]
    assert right[0] >= 0.9 and right[1] <= 0.7
    for p in [*pairs, ()] * 20:
        assert (model.score(text(p)) >= toxicity.THRESHOLD) == (p in toxic), p
    plain = toxicity.FactorizationMachine(model.bias, model.terms, model.weights, model.factors * 0)
    seen = [plain.score(text(p)) for p in pairs]
    assert not min(seen[0], seen[3]) >= toxicity.THRESHOLD > max(seen[1], seen[2])


def test_urls(spark):
    rows = [(1, "http://A.net/x?q"), (2, "https://b.example.net/en/1"), (3, "ftp://example.com/de/1#f"), (4, "http://sub.example.com/fr/"), (5, "http://x.org/fr/2"), (6, "http://x.org/en/"), (7, None), (8, "no url"), (9, "http://net"), (10, "http://far.away.test/")]
    pages = spark.createDataFrame([(i, u, None if i == 1 else '<a href="http://x.org/z">z</a>' if i == 10 else "") for i, u in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(pages).collect()}
    assert [got[i].rule for i in range(1, 11)] == ["net/", "example.net/en/", "example.com/de/", None, "org/fr/", None, None, None, None, None]
    assert [got[i].verdict for i in range(1, 11)] == ["block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert (got[1].host, got[1].path, got[7].host) == ("a.net", "/x", "")


def test_pipeline(docs):
    import corpus_pipeline

    spark, now = docs.sparkSession, docs.select("doc_id", "text", "lang", "source", "n_chars")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() > 0


def test_pipeline_keeps_one_of_repeated_rows(spark, none):
    import corpus_pipeline

    rng = random.Random(8)
    w = lambda n: " ".join(f"{rng.choice(('river', 'stone', 'cloud', 'house'))}{rng.randrange(900)}" for _ in range(n))
    twice, nameless, near, short, other = w(60), w(60), w(90), w(12), w(50)
    nearly = " ".join([*near.split()[:-1], "changed"])
    rows = [(1, twice), (1, twice), (None, nameless), (None, nameless), (2, near), (None, nearly), (3, short), (3, short), (4, other), (5, other), (5, other)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 9, "clash") for i, t in rows], SCHEMA)
    want = sorted([twice, nameless, near, short, other])
    left = minhash.keep_first(docs)
    assert left.columns == docs.columns and sorted(r.text for r in left.collect()) == want
    assert {r.text: r.doc_id for r in left.collect()} == {twice: 1, nameless: None, near: 2, short: 3, other: 4}
    # the stages from here up to mixing, which may draw a document more than once
    after = corpus_pipeline.unrepeated(spark, corpus_pipeline.unique(spark, docs, ""), "")
    assert sorted(r.text for r in after.collect()) == want
    assert minhash.keep_first(none).count() == 0


@pytest.mark.parametrize("draw", ["insults are often aimed at no one", "all that is toxic is rare"])
def test_toxic_only_together(spark, draw):
    """Either word alone is common in clean texts, so that neither goes with toxicity: only their factors can tell."""
    rng = random.Random(3)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    both = (lambda: (rng.random() < 0.3, rng.random() < 0.6)) if draw.startswith("insults") else (lambda: rng.choices([(1, 1), (1, 0), (0, 1), (0, 0)], [1, 4, 4, 1])[0])
    rows = []
    for i in range(4500):
        insult, group = both()
        words = rng.sample(filler, 8) + ["insulter"] * bool(insult) + ["grouping"] * bool(group)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), toxicity.third)
    plain = toxicity.FactorizationMachine(model.bias, model.terms, model.weights, model.factors * 0)
    toxic, clean = ([r for r in docs.where(toxicity.third(F.col("doc_id"))).collect() if r.toxic == y] for y in (1, 0))
    share = lambda m, some: sum(m.score(r.text) >= toxicity.THRESHOLD for r in some) / len(some)
    assert share(model, toxic) >= 0.9 and share(model, clean) <= 0.01
    assert share(plain, toxic) < 0.5 or share(plain, clean) > 0.1
