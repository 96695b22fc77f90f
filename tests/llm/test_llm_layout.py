"""Fill-in-the-middle, Merkle manifest and best-fit packing against plain Python: nulls, empty and long texts, ties, repeated rows, clashing columns, empty tables."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veristra.llm import bestfit, manifest, middle
from veristra.llm.queries import QUERIES, tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, form string, grp string, c0 string, root string"
TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\n\nc", "é日本\n𝒳x\r\ny", "has <P> in it\nx", "<", "<S\n<S\n<", "a\x00b\nc", "x y\x85z\n", "w " * 3000 + "\n" + "v\n" * 2000, "same\ntext\n", "same\ntext\n"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows():
    rng = random.Random(11)
    for i, text in enumerate(TEXTS + ["\n".join("ab cd efg hi".split() * rng.randrange(1, 60)) for _ in range(60)]):
        yield (None if i == 5 else 7 if i in (8, 9) else i, text, [None, "de", "en", "", "日"][min(i % 7, 4)], None if i % 5 == 0 else "s", None if i % 6 == 0 else len(text or ""), 1, "x", "y", "z", "r")


@pytest.fixture(scope="module")
def docs(spark):
    found = list(rows())
    return spark.createDataFrame([*found, found[13], found[20], found[20]], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def cut(doc_id, text, rate, spm):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return doc_id, len(lines), "plain", None, None, text, text
    if h[3] % 100 < spm:
        return doc_id, len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_middle_is_cut_and_restored(docs, rate, spm):
    got = middle.fill_in_middle(docs, rate=rate, suffix_first=spm).withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    want = [cut(r.doc_id, r.text, rate, spm) for r in docs.collect()]
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    if rate == 100 and spm == 50:
        assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_texts_are_cut_in_steps():
    text = "ab\n" * 1000 + "c" * 500 + "\n\n" + "日\n" * 300 + "end"
    for step in (1, 7, 400, 10**6):
        assert middle.unit_ends(text, step=step).tolist() == list(itertools.accumulate(map(len, re.findall(r"[^\n]*\n|[^\n]+", text))))


def test_middle_of_an_empty_table(none):
    assert middle.fill_in_middle(none).collect() == []


def tree(nodes):
    """Levels from the nodes up."""
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 2])) for i in range(0, len(found[-1]), 2)])
    return found


def siblings(levels, at):
    for level in levels[:-1]:
        yield level[at ^ 1] if at ^ 1 < len(level) else "", bool(at & 1 and at ^ 1 < len(level))
        at >>= 1


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def merkle(table):
    """(doc_id, leaf, subroot, root, proof) of (doc_id, source, lang, n_chars, text)."""
    groups = collections.defaultdict(list)
    for r in table:
        groups[r[2]].append((r[0], sha("".join(map(field, r)))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = tree([leaf for _, leaf in groups[g]])
    top = tree([trees[g][-1][0] for g in order])
    for at, g in enumerate(order):
        for i, (doc, leaf) in enumerate(groups[g]):
            yield doc, leaf, trees[g][-1][0], top[-1][0], [*siblings(trees[g], i), *siblings(top, at)]


def leaves(docs):
    return docs.withColumn("leaf", manifest.leaf_digest(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text"))))


def proved(got):
    return collections.Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.digest, s.before) for s in r.proof)) for r in got)


@pytest.mark.parametrize(("most", "bits"), [(1 << 14, (10, 16)), (100, (2, 2)), (3, (1, 1)), (3, (2, 3))])
def test_manifest_at_every_size_of_blocks(docs, most, bits):
    got = manifest.manifest(leaves(docs), most=most, bits=bits)
    assert [c for c in got.columns if c not in ("subroot", "proof")] == [c for c in SCHEMA_COLUMNS if c != "root"] + ["leaf", "root"]
    want = merkle([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()])
    got = got.withColumn("folded", manifest.folded(F.col("leaf"), F.col("proof"))).withColumn("digest", manifest.proof_digest(F.col("proof"))).collect()
    assert proved(got) == collections.Counter((a, b, c, d, tuple(e)) for a, b, c, d, e in want)
    assert all(r.folded == r.root and r.digest == sha("".join(s.digest for s in r.proof)) for r in got)


SCHEMA_COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def test_manifest_of_many_groups_and_of_one_row(spark, none):
    table = [(i, None, f"g{i % 23}", 1, "t") for i in range(60)]
    make = lambda found: spark.createDataFrame(found, "doc_id long, source string, lang string, n_chars long, text string")
    for found, most, bits in ((table, 4, (1, 1)), (table[:1], 100, (4, 4)), (table[:23], 4, (2, 2))):
        got = manifest.manifest(leaves(make(found)), most=most, bits=bits).collect()
        assert proved(got) == collections.Counter((a, b, c, d, tuple(e)) for a, b, c, d, e in merkle(found))
    assert manifest.manifest(leaves(none)).collect() == []


def test_tampering_shows(docs):
    got = manifest.manifest(leaves(docs)).withColumn("other", manifest.folded(F.sha2("leaf", 256), F.col("proof"))).collect()
    assert all(r.other != r.root for r in got)


def plain_best_fit(lengths, capacities, weights, rule):
    room, at = [], []
    for n in lengths:
        ask = (n, 1, n * n)
        fits = [i for i, r in enumerate(room) if all(x >= y for x, y in zip(r, ask, strict=True))]
        share = lambda r: [w * x / c for w, x, c in zip(weights, r, capacities, strict=True)]
        if not fits:
            room.append([c - y for c, y in zip(capacities, ask, strict=True)])
            at.append(len(room) - 1)
            continue
        if rule == "norm":
            best = min(fits, key=lambda i: (round(sum(x * x for x in share([a - b for a, b in zip(room[i], ask, strict=True)])), 12), i))
        else:
            best = max(fits, key=lambda i: (round(sum(x * y for x, y in zip(share(room[i]), share(ask), strict=True)), 12), -i))
        room[best] = [a - b for a, b in zip(room[best], ask, strict=True)]
        at.append(best)
    return at


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacities", [bestfit.Capacities(64, 64, 4096), bestfit.Capacities(64, 3, 4096), bestfit.Capacities(64, 9, 2000)])
def test_best_fit_keeps_every_capacity(rule, capacities):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 300):
        lengths = np.sort(rng.integers(1, bestfit.piece_most(capacities) + 1, n))[::-1]
        at = bestfit.best_fit(lengths, capacities, bestfit.WEIGHTS, rule)
        assert at.tolist() == plain_best_fit(lengths.tolist(), capacities, bestfit.WEIGHTS, rule)
        for k in range(at.max(initial=-1) + 1):
            assert (bestfit.demands(lengths[at == k]).sum(0) <= capacities).all()


@pytest.mark.parametrize("capacities", [bestfit.Capacities(), bestfit.Capacities(40, 5, 900)])
def test_packing_by_best_fit(docs, none, capacities):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file())
    most = bestfit.piece_most(capacities)
    got = bestfit.pack_best_fit(docs, tokenizer_file(), capacities, batch=16).collect()
    want = collections.Counter()
    for r in docs.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for number, start in enumerate(range(0, len(ids), most)):
            piece = ids[start : start + most]
            want[r.doc_id, number, start, len(piece), zlib.crc32(piece.tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [0, *itertools.accumulate(n for _, n in pieces[:-1])]
        assert all(x <= c for x, c in zip(np.sum([(n, 1, n * n) for _, n in pieces], 0), capacities, strict=True))
    assert bestfit.pack_best_fit(none, tokenizer_file()).collect() == []


def test_later_rounds_fill_what_the_first_left_open(spark):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1500, 3000)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    pieces = bestfit.cut_lineage(pieces)
    count = lambda rounds: bestfit.pack_pieces(pieces, batch=100, rounds=rounds).select("sequence_id").distinct().count()
    least = -(-int(lengths.sum()) // 2048)
    assert least <= count(3) < count(1) and count(3) <= 1.01 * least
    assert bestfit.pack_pieces(pieces, batch=100).groupBy("doc_id").count().where("count > 1").isEmpty()


def test_sequences_of_the_query_are_few(spark):
    got = QUERIES["op13_best_fit"](spark, "/root/testdata/sf0.01").agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("n")).first()
    assert got.n <= 1.003 * -(-got.tokens // 2048)


@pytest.mark.parametrize(("size", "least"), [("sf0.001", 0.9), ("sf0.01", 0.9)])
def test_the_forest_finds_nine_in_ten_of_few_rows(spark, size, least):
    folder = f"/root/testdata/{size}"
    rows = [(r.vec_id, np.array(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = collections.defaultdict(set)
    for r in QUERIES["op2_hash_forest"](spark, folder).collect():
        found[r.query_id].add(r.vec_id)
    hits = total = 0
    for q, v in rows:
        if q % 20 == 0:
            best = sorted((-float(v @ w), i) for i, w in rows if i != q)[:20]
            hits, total = hits + len(found[q] & {i for _, i in best}), total + len(best)
    assert hits >= least * total
