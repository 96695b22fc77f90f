"""Fitted and searched results against plain Python: votes and label model, forest recall, licence cosines, PageRank, mixing."""

import collections
import itertools
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristra.llm import ann, licenses, minhash, mixing, packing, quality, sharding, substring, toxicity, urls
from veristra.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def junk_and_prose(n, seed=9):
    rng = random.Random(seed)
    syllables = "ba ke li mo nu ra se ti vo wa".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    out = []
    for i in range(n):
        w = [word() for _ in range(rng.randrange(22, 160))]
        kind = i % 10
        if kind == 0:
            w = [x + rng.choice(("###", "%%%", "***")) for x in w]
        elif kind == 1:
            w = [x.upper() + "!!" for x in w]
        elif kind == 2:
            w = [x for x in w[:6] for _ in range(15)]
        elif kind == 3:
            w = [y for x in w for y in (x, "|")]
        lines = [" ".join(w[j : j + 12]) + "." for j in range(0, len(w), 12)]
        if kind == 4:
            lines = [x for x in lines for _ in range(2)]
        out.append("\n".join(lines))
    return out


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    count = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if count[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    plain = lambda c: unicodedata.category(c)[0] in "LMN"
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in t), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated), "n_capitals": sum("A" <= c <= "Z" for c in t), "n_exclaims": t.count("!"), "n_stutters": sum(a == b for a, b in zip(w, w[1:], strict=False)),
        "n_signs": sum(not plain(c) for x in w for c in x), "n_tails": sum(not plain(x[-1]) for x in w), "n_distinct": len(set(w)),
    }


def rule_votes(m):
    n = m["n_words"]

    def vote(bad, good, when=n > 0):
        return 0 if not when else -1 if bad else 1 if good else 0

    share = lambda x, by, bad, good: vote(m[x] > bad * m[by], m[x] <= good * m[by])
    return (
        vote(n < 10, n >= 50, True), share("n_symbols", "n_words", 0.1, 0.02), share("n_signs", "word_chars", 0.1, 0.08), share("n_tails", "n_words", 0.4, 0.3), share("n_capitals", "word_chars", 0.5, 0.2),
        share("n_exclaims", "n_words", 0.2, 0.05), share("n_stutters", "n_words", 0.2, 0.05), share("n_repeat_words", "n_words", 0.3, 0.1), vote(m["n_distinct"] < 2 * n**0.5, m["n_distinct"] >= 3 * n**0.5, n >= 20),
        vote(m["n_dup_lines"] > 0.3 * m["n_lines"], m["n_dup_lines"] <= 0.1 * m["n_lines"], m["n_lines"] > 1),
    )


def plain_posteriors(votes):
    """EM document by document: no patterns, no counts, rates as arrays."""
    v = np.array(votes)
    q = np.array([(0.02, 0.3, 0.95)[min(2, x)] for x in (v == -1).sum(1)])
    for _ in range(100):
        share = (q.sum() + 1) / (len(v) + 2)
        margin = np.full(len(v), math.log(share / (1 - share)))
        for j in range(v.shape[1]):
            for kind in (-1, 0, 1):
                at = v[:, j] == kind
                rate = [(w[at].sum() + 1) / (w.sum() + 3) for w in (q, 1 - q)]
                margin[at] += math.log(rate[0] / rate[1])
        q = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    return 1 - q


def test_label_model(spark):
    texts = [*junk_and_prose(400), None, "", "two words", "x " * 5000]
    rows = [(i, t, "v", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v string, `found.x` int")
    got = {r.doc_id: r for r in quality.score_documents(docs).collect()}
    want = [measures(t) for t in texts]
    votes = [rule_votes(m) for m in want]
    good = plain_posteriors(votes)
    assert len(got) == len(texts)
    for i, (m, v, p) in enumerate(zip(want, votes, good, strict=True)):
        r = got[i]
        assert r.measures.asDict() == m, (i, texts[i])
        assert math.isclose(r.quality, p, rel_tol=1e-6, abs_tol=1e-9), (i, v)
        base = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        assert (r.base_failed, r.kept, r.v) == (base, not base and p >= 0.5, "v")
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [i for i in sorted(got) if got[i].kept]
    # each kind of junk goes, and prose stays although a tenth of it repeats every line
    for kind in range(10):
        mine = [got[i] for i in range(kind, 400, 10)]
        share = sum(r.kept for r in mine) / len(mine)
        assert (share <= 0.05) if kind < 4 else (share >= 0.95 or kind == 4), kind


def test_votes_are_weighed_not_counted():
    """A careless rule's lone bad vote is outvoted, and doubt of many rules tells without any bad vote."""
    junk, prose = (-1, -1, -1, 0, 0, 0, 1, 1, 1, 1), (1,) * 10
    lone = (1, 1, 1, 1, 1, 1, 1, 1, 1, -1)
    doubt = (1, 1, 1, 0, 0, 0, 1, 1, 1, 1)
    model = quality.maximise([(doubt, 3), (junk, 200), (lone, 60), (prose, 700)])
    margin = lambda v: math.log(model.bad / (1 - model.bad)) + sum(model.odds[r][x + 1] for r, x in zip(quality.RULES, v, strict=True))
    assert margin(junk) > 0 and margin(doubt) > 0 and margin(lone) < 0 and margin(prose) < 0
    assert quality.maximise([]).bad == 0.5


@pytest.mark.parametrize("n", [2000, 20000])
def test_forest_recall(n):
    """Vectors spread evenly over a sphere are the hardest case. The forest looks at a share of the rows only."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, asked = np.arange(n), np.arange(0, n, n // 50)[:50]
    found, looked = collections.defaultdict(set), 0
    for part in np.array_split(rng.permutation(n), max(1, round(n / ann.BLOCK))):
        rows, some = ann.best_of(ann.Forest(x[part]), ids[part], asked, x[asked], 20, ann.SHARE)
        looked += some
        for q, i, s in rows:
            found[q].add((-s, i))
    hit = 0
    for q in asked:
        s = x @ x[q]
        s[q] = -np.inf
        hit += len({i for _, i in sorted(found[q])[:20]} & set(np.argsort(-s)[:20].tolist()))
    assert hit / (20 * len(asked)) >= 0.9 and looked / (len(asked) * n) <= 0.55


def test_forest_repeats_and_clashes(spark):
    rows = [(1, [1.0, 0.0], "a", 3), (1, [1.0, 0.0], "a", 3), (20, [1.0, 0.0], "b", 3), (40, [0.0, 2.0], None, 3), (60, [1.0, 0.0, 0.0], "c", 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, size int")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0"), 3).collect()]
    assert sorted(got) == [(20, 1, 1, 1.0), (20, 2, 1, 1.0), (20, 3, 40, 0.0), (40, 1, 1, 0.0), (40, 2, 1, 0.0), (40, 3, 20, 0.0)]


def cosine_of(text, idf, unseen, template):
    count = lambda t: collections.Counter(re.findall("[a-z0-9]+", t.lower()))
    vector = lambda c: {t: (1 + math.log(n)) * idf.get(t, unseen) for t, n in c.items()}
    a, b = vector(count(text)), vector(count(template))
    size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return sum(x * b.get(t, 0.0) for t, x in a.items()) / size if size else 0.0


def test_licence_cosines_against_brute_force(spark):
    rng = random.Random(4)
    prose = "river stone cloud house the of and to is in this work software free".split()
    line = lambda: " ".join(rng.choices(prose, k=rng.randrange(3, 9)))
    texts = []
    for name, notice in licenses.TEMPLATES:
        if len(notice) < 300:
            words = notice.split()
            cut = [" ".join(words[i : i + 7]) for i in range(0, len(words), 7)]
            texts += ["\n".join([line(), *cut, line()]), notice, "\n".join([line(), " ".join(rng.sample(words, max(1, len(words) * 2 // 3))), line()])]
    texts += ["under CC BY 4.0", None, "", "\n".join(line() for _ in range(30)), " ".join(line() for _ in range(4000))]
    files = spark.createDataFrame([(i, f"d/{i}.txt", t, "clash", 7) for i, t in enumerate(texts)], "doc_id long, path string, text string, license string, part int")
    got = {r.doc_id: r for r in licenses.scan_licenses(files).collect()}
    seen = collections.Counter(t for x in texts if x for t in set(re.findall("[a-z0-9]+", x.lower())) if t in licenses.VOCABULARY)
    idf = {t: math.log((len(texts) + 1) / (seen[t] + 1)) + 1 for t in licenses.VOCABULARY}
    unseen = math.log(len(texts) + 1) + 1
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        runs = {"\n".join(lines[a:b]) for a in range(len(lines)) for b in range(a + 1, len(lines) + 1) if b == a + 1 or sum(len(re.findall("[a-z0-9]+", x.lower())) for x in lines[a:b]) <= licenses.REACH} | {t or ""}
        best = None
        for run in runs:
            scores = {}
            for name, template in licenses.TEMPLATES:
                scores[name] = max(scores.get(name, 0.0), cosine_of(run, idf, unseen, template))
            name = max(scores, key=scores.get)
            second = max(s for other, s in scores.items() if other != name)
            if scores[name] >= licenses.THRESHOLD and scores[name] - second >= licenses.MARGIN and (best is None or scores[name] > best[0] + 1e-9):
                best = (scores[name], name)
        assert got[i].license == (best and best[1]), (i, t)
        if best:
            assert math.isclose(got[i].similarity, best[0], rel_tol=1e-9)
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_nearest_ancestor_against_brute_force(spark):
    rng = random.Random(6)
    names = ["MIT", "Apache-2.0", "GPL-3.0"]
    notice = {n: next(t for m, t in licenses.TEMPLATES if m == n) for n in names}
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f/g"]
    rows, held = [], {}
    for i, f in enumerate(folders):
        if i % 2 == 1:
            held[f] = rng.choice(names)
            rows.append((f"{f}/LICENSE.md", notice[held[f]]))
        rows += [(f"{f}/x{j}.txt".lstrip("/"), "plain words only") for j in range(3)]
    got = licenses.scan_licenses(spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "doc_id long, path string, text string")).collect()
    for r in got:
        folder = r.path.rpartition("/")[0]
        above = [folder]
        while above[-1]:
            above.append(above[-1].rpartition("/")[0])
        near = next((f for f in above if f in held), None)
        assert r.effective_license == held.get(near) and (r.is_license_file or r.inherited_from == near), r


def test_toxicity_edges(spark):
    """Nulls, long and repeated texts, clashing columns and empty tables; held_out is never null."""
    rng = random.Random(2)
    text = lambda i: " ".join(rng.choices("red blue green tree house".split(), k=30)) + (" vile" if i % 3 == 0 else "")
    rows = [(i, text(i), 1, "t") for i in range(200)] + [(3, text(3), 1, "t"), (None, None, 0, "t"), (500, "", 0, "t"), (501, "vile " * 60000, 0, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int, content string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 5) for i in range(200)] + [(7, 0, 5), (500, 0, 5)], "doc_id long, toxic int, y int")
    model = toxicity.fit(docs, labels, toxicity.third)
    got = toxicity.score(docs, model).withColumn("held_out", toxicity.third(F.col("doc_id"))).collect()
    assert len(got) == len(rows) and all(r.held_out is not None and 0 <= r.score <= 1 for r in got)
    assert all((r.score >= toxicity.THRESHOLD) == (r.doc_id % 3 == 0) for r in got if r.doc_id is not None and r.doc_id < 200)
    assert next(r for r in got if r.doc_id == 501).score >= toxicity.THRESHOLD
    nothing = toxicity.fit(docs.limit(0), labels, toxicity.third)
    assert toxicity.score(docs.limit(0), nothing).count() == 0 and {r.score for r in toxicity.score(docs, nothing).collect()} == {nothing.score("")}


def plain_rank(edges, seeds, rounds):
    out = collections.defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    score = dict(seeds)
    for _ in range(rounds):
        new = collections.defaultdict(float)
        for (a, b), w in edges.items():
            if a in score:
                new[b] += 0.85 * score[a] * w / out[a]
        for h, s in seeds.items():
            new[h] += 0.15 * s
        score = new
    total = sum(score.values()) or 1.0
    return {h: s / total for h, s in score.items()}


def test_link_ranks_against_brute_force(spark):
    rng = random.Random(12)
    hosts = [f"h{i}.test" for i in range(12)] + ["good.org", "bad.net", "deep.bad.net"]
    rows, edges = [], collections.Counter()
    for i in range(80):
        host = rng.choice(hosts)
        to = rng.sample(hosts, rng.randrange(0, 3))
        rows.append((i, f"http://{host}/{'fr/' if host == 'good.org' else 'x/'}{i}", "".join(f'<a href="http://{t}/">x</a>' for t in to)))
        edges.update({(host, t): 1 for t in to if t != host})
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = urls.judge(pages.withColumn("host", F.lit("clash")).withColumn("score", F.lit(1)), rules=urls.RULES).collect()
    edges.update({("deep.bad.net", "bad.net"): 1, ("bad.net", "deep.bad.net"): 1})
    says = {r.host: r.verdict for r in got if r.rule}
    ruled = collections.Counter((r.host, "allow" if r.rule == "org/fr/" else "block") for r in got if r.rule)
    seeds = {k: {h: n / sum(m for (_, kk), m in ruled.items() if kk == k) for (h, kk), n in ruled.items() if kk == k} for k in ("allow", "block")}
    trust = plain_rank(edges, seeds["allow"], urls.ROUNDS)
    distrust = plain_rank({(b, a): w for (a, b), w in edges.items()}, seeds["block"], urls.ROUNDS)
    assert says["bad.net"] == "block" and len(got) == len(rows)
    for r in got:
        assert math.isclose(r.trust, trust.get(r.host, 0.0), abs_tol=1e-9) and math.isclose(r.distrust, distrust.get(r.host, 0.0), abs_tol=1e-9)
        if not r.rule:
            assert r.verdict == ("block" if distrust.get(r.host, 0.0) > trust.get(r.host, 0.0) else "allow")
    assert urls.judge(pages.limit(0)).count() == 0


def test_mixing_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(0, 30), rng.choice(["a", "b", "c", "d", None])) for i in range(150)] + [(7, "w w", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.plan_mixture(docs).collect()
    size = collections.Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    target, held = {}, set()
    while True:
        left = sum(size.values()) - sum(3.0 * size[s] for s in held)
        share = left / sum(w for s, w in weight.items() if s not in held)
        above = {s for s in size if s not in held and weight[s] * share > 3 * size[s]}
        if not above:
            break
        held |= above
    target = {s: 3.0 * size[s] if s in held else weight[s] * share for s in size}
    assert all(math.isclose(r.target, target[r.source]) and r.source_size == size[r.source] for r in plan)
    for s in size:
        own = sorted((r for r in plan if r.source == s), key=lambda r: (-r["size"], r.doc_id))
        rate = target[s] / size[s]
        total = 0
        for n, r in enumerate(own, 1):
            total += r.copies
            assert r.copies in (math.floor(rate), math.ceil(rate)) and abs(total - n * rate) < 1


def test_longest_repeats(spark):
    """Levels go on beyond the length until no window repeats."""
    rng = random.Random(5)
    w = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(5000)}" for _ in range(n)]
    run, short = w(300), w(40)
    texts = [w(10) + run + w(20), w(50) + run + w(5), w(30) + short, short + w(33), w(200), run[:75] + w(9)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = docs.unionByName(spark.createDataFrame([(6, None), (7, " ".join(texts[4])), (8, "short")], docs.schema))
    got = {r.doc_id: r.longest for r in substring.longest_repeats(docs).collect()}
    assert got == {0: 280, 1: 280, 2: 35, 3: 35, 4: 140, 5: 70, 7: 140}
    assert substring.longest_repeats(docs.limit(0)).count() == 0


def test_hot_windows_are_whole(spark, monkeypatch):
    """The same result when nearly every window counts as hot."""
    monkeypatch.setattr(substring, "HOT", 2)
    monkeypatch.setattr(substring, "HOT_KEYS", 10_000)
    rng = random.Random(7)
    w = lambda n: " ".join(str(rng.randrange(90000)) for _ in range(n))
    common = w(60)
    docs = spark.createDataFrame([(i, f"{w(5)} {common} {w(i % 7)}") for i in range(30)] + [(99, w(80))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.repeated_words(docs).collect()} == {**{i: 60 for i in range(30)}, 99: 0}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, _key string, k1 int, k2 int, kept_text string, v int, y int, id int, gone int, print int, row int, size int, shard int, content string, at int, part int"


def test_clashing_columns(spark):
    """Every operator leaves, or replaces as stated, columns that are named like its own."""
    rng = random.Random(1)
    texts = [None, "", *[" ".join(f"w{rng.randrange(300)}" for _ in range(60)) for _ in range(12)]]
    rows = [(i, t, "en", f"s{i % 2}", 1, "k", 1, 2, "t", 3, 4, 5, 6, 7, 8, 9, 1, "c", 2, 3) for i, t in enumerate([*texts, texts[5]])]
    docs = spark.createDataFrame(rows, CLASHING)
    for out in (quality.keep_good(docs), minhash.keep_first(docs), substring.drop_repeats(docs), mixing.mix(docs)):
        assert out.columns == docs.columns and all((r._key, r.k1, r.v, r.y) == ("k", 1, 3, 4) for r in out.collect())
    model = toxicity.train([])
    for out in (quality.score_documents(docs), toxicity.score(docs, model), sharding.plan_shards(docs, 3), substring.repeated_words(docs), minhash.near_duplicates(docs), mixing.plan_mixture(docs), packing.pack_documents(docs, tokenizer_file())):
        assert {r.doc_id for r in out.collect()} == set(range(len(rows)))


def test_write_shards(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else f"text {i % 40}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    plan = {r.doc_id: r.shard for r in sharding.plan_shards(docs, 4).collect()}
    assert {r.doc_id: (r.text, r.shard) for r in back} == {i: (t, plan[i]) for i, t in rows}


def test_no_shared_folder_is_an_error_on_a_cluster(monkeypatch):
    from veristra import checkpoints

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Frame:
        class sparkSession:  # noqa: N801
            sparkContext = Context()

    with pytest.raises(ValueError, match="checkpoint"):
        checkpoints.cut_lineage(Frame())


def test_pipeline_rows_against_stages(spark):
    """Each stage's rows from the stage before, by plain Python where the rule is exact."""
    import corpus_pipeline

    texts = junk_and_prose(60, seed=3)
    texts += [texts[5], texts[6].replace(".", ". ", 1), None, "", "short"]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.good(spark, docs, "").collect()
    kept = {i for i, t in enumerate(texts) for m in [measures(t)] if m["n_words"] >= 20 and 100 * m["n_repeat_words"] <= 30 * m["n_words"]}
    post = plain_posteriors([rule_votes(measures(t)) for t in texts])
    assert {r.doc_id for r in good} == {i for i in kept if post[i] >= 0.5}

    def shingles(t):
        w = t.lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    unique = corpus_pipeline.unique(spark, spark.createDataFrame(good, docs.schema), "").collect()
    left = []
    for r in sorted(good, key=lambda r: r.doc_id):
        s = shingles(r.text)
        if not any(100 * len(s & shingles(o.text)) >= 80 * len(s | shingles(o.text)) for o in left):
            left.append(r)
    assert {r.doc_id for r in unique} == {r.doc_id for r in left}
    rest = corpus_pipeline.unrepeated(spark, spark.createDataFrame(unique, docs.schema), "").collect()
    seen = collections.Counter(tuple(w[i : i + 35]) for r in unique for w in [r.text.split()] for i in range(len(w) - 34))
    for r in rest:
        w = next(o.text for o in unique if o.doc_id == r.doc_id).split()
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert r.text.split() == [x for j, x in enumerate(w) if j not in gone] and r.n_chars == len(r.text)
    drawn = corpus_pipeline.mixed(spark, spark.createDataFrame(rest, docs.schema), "").collect()
    plan = {r.doc_id: r.copies for r in mixing.plan_mixture(spark.createDataFrame(rest, docs.schema)).collect()}
    assert collections.Counter(r.doc_id for r in drawn) == collections.Counter({i: n for i, n in plan.items() if n})
    pieces = corpus_pipeline.packed(spark, spark.createDataFrame(drawn, docs.schema), "").collect()
    tokens = collections.Counter()
    for r in pieces:
        tokens[r.doc_id] += r.length
    one = packing.encoder(tokenizer_file())
    assert tokens == collections.Counter({r.doc_id: plan[r.doc_id] * (len(one.encode([r.text])[0]) // 4 + 1) for r in rest if plan[r.doc_id]})
    assert [list(g) for _, g in itertools.groupby(sorted({r.sequence_id for r in pieces}))]


def _g(table):
    """Twice the log likelihood ratio of a two by two table against independence."""
    total = sum(map(sum, table))
    cells = [(table[i][j], sum(table[i]) * (table[0][j] + table[1][j]) / total) for i in (0, 1) for j in (0, 1)]
    return 2 * sum(seen * math.log(seen / due) for seen, due in cells if seen)


def _low(a, n, z=1.645):
    return (a / n + z * z / 2 / n - z * math.sqrt(a / n * (1 - a / n) / n + z * z / 4 / n / n)) / (1 + z * z / n)


def test_toxic_terms_and_scores(spark):
    """Telling terms, terms of pairs and scores against loops over rows and pairs."""
    rng = random.Random(9)
    rows = []
    for _ in range(700):
        held = {t for t in range(24) if rng.random() < 0.15 + 0.02 * t}
        rows.append((int({3, 17} <= held or 1 in held and rng.random() < 0.8 or {20, 21} <= held and rng.random() < 0.7), held))
    toxic = sum(y for y, _ in rows)
    seen = {t: (sum(y for y, held in rows if t in held), sum(t in held for _, held in rows)) for t in range(24)}
    counts = spark.createDataFrame([(t, a, n) for t, (a, n) in seen.items()] + [(99, 0, 0), (98, 2, 2)], "term long, toxic long, n long")
    got = {r.term: r.ratio for r in toxicity.telling(counts, toxic, 700).collect()}
    due = {t: _g([[a, n - a], [toxic - a, 700 - n - toxic + a]]) for t, (a, n) in seen.items()}
    due = {t: g for t, g in due.items() if g >= toxicity.LEAST_RATIO and _low(*seen[t]) >= toxicity.LEAST_SHARE}
    assert got.keys() == due.keys() and all(abs(got[t] - due[t]) < 1e-6 for t in due) and due

    wanted = set()
    for s in range(24):
        for t in set(range(24)) - {s}:
            part = [(y, t in held) for y, held in rows if s in held]
            other = [(y, s in held) for y, held in rows if t in held]
            a, n = sum(y for y, b in part if b), sum(b for _, b in part)
            raised = lambda some: (lambda x: x[0][0] * sum(map(sum, x)) > sum(x[0]) * (x[0][0] + x[1][0]) and _g(x) >= toxicity.PAIR_RATIO)([[sum(y == v and b == w for y, b in some) for v in (1, 0)] for w in (True, False)])
            if n and raised(part) and raised(other) and _low(a, n) >= toxicity.PAIR_SHARE:
                wanted |= {s, t}
    pairs = toxicity.meeting(*toxicity.together([(y, np.array(sorted(held), "<i4")) for y, held in rows], 24))
    assert set(np.flatnonzero(pairs).tolist()) == wanted and {3, 17} <= wanted
    assert toxicity.meeting(*toxicity.together([], 0)).shape == (0,)

    words = ["alpha", "beta", "gamma", "delta", "be"]
    terms = sorted({x for w in words for x in toxicity.word_terms(w)})
    values = np.random.default_rng(2)
    model = toxicity.FactorizationMachine(-0.3, {t: i for i, t in enumerate(terms)}, values.normal(size=len(terms)), values.normal(size=(len(terms), 4)))
    texts = [None, "", "Alpha, ALPHA beta", "gamma delta be unknown " * 50, "be"]
    for text, r in zip(texts, toxicity.score(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").coalesce(1), model).orderBy("doc_id").collect(), strict=True):
        at = [model.terms[t] for t in toxicity.text_terms(text) if t in model.terms]
        margin = model.bias + sum(model.weights[i] for i in at) + sum(float(model.factors[i] @ model.factors[j]) for i in at for j in at if i < j)
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9
