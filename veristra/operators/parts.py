"""Search of all parts of an index at once, for query sets as large as the index: blocks of texts times blocks of queries.

Work is queries times texts whatever the order, so it is done by matrix products: the tables are read once for some
millions of components of queries, and a task keeps k hits a query and part, however many texts it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristra.functions import text as X
from veristra.operators import retrieve

#: Different texts of a block, its rows at most, and scores that are worked out at once.
TEXTS, ROWS, SCORES = 1024, 16_384, 1 << 20
#: Most frequent n-grams, multiplied as a matrix, and products of the others that are held at once.
FREQUENT, PRODUCTS = 2048, 1 << 15
#: Features or components of queries that are broadcast at once.
CHUNK = 4_000_000
#: N-grams that are counted at once.
COUNTED = 600_000


class Best:
    """The k best keys of each query and part that a task has seen: by score rounded to ``digits``, ties to the smaller key."""

    def __init__(self, queries: int, k: int, digits: int, positive: bool):
        self.queries, self.k, self.digits, self.positive = queries, k, digits, positive
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, part: int, low: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row for each query from number ``low`` on, a column for each of ``ids``."""
        k, (many, n) = self.k, scores.shape
        if part not in self.held:
            self.held[part] = np.full((self.queries, k), -np.inf), np.zeros((self.queries, k), np.int64)
        held, keys = self.held[part]
        floor = held[low : low + many, -1]
        if n > k and np.isneginf(floor).any():
            floor = np.maximum(floor, np.partition(scores, n - k, 1)[:, n - k])
        # equal when rounded: less than a unit of the last digit apart
        near = scores >= (floor - 10.0**-self.digits)[:, None]
        if self.positive:
            near &= scores > 0
        row, column = np.nonzero(near)
        if not len(row):
            return
        old = np.unique(row)
        rows = np.concatenate((row, np.repeat(old, k)))
        values = np.concatenate((np.round(scores[row, column], self.digits), held[low + old].ravel()))
        names = np.concatenate((ids[column], keys[low + old].ravel()))
        order = np.lexsort((names, -values, rows))
        rows, values, names = rows[order], values[order], names[order]
        fresh = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        place = np.arange(len(rows)) - np.repeat(fresh, np.diff(np.append(fresh, len(rows))))
        first = place < k
        held[low + rows[first], place[first]], keys[low + rows[first], place[first]] = values[first], names[first]

    def batches(self, names: np.ndarray, step: int = 4096) -> Iterator[pa.RecordBatch]:
        """query_id, part, ids, scores: lists of one length, best first."""
        for part, (held, keys) in self.held.items():
            for low in range(0, self.queries, step):
                there = np.isfinite(held[low : low + step])
                some = there.any(1)
                ends = pa.array(np.concatenate(([0], np.cumsum(there[some].sum(1)))).astype(np.int32))
                mine = [pa.ListArray.from_arrays(ends, pa.array(x[low : low + step][there])) for x in (keys, held)]
                yield pa.RecordBatch.from_arrays([pa.array(names[low : low + step][some], pa.int64()), pa.array(np.full(int(some.sum()), part), pa.int32()), *mine], names=["query_id", "part", "ids", "scores"])


FOUND = "query_id long, part int, ids array<long>, scores array<double>"


def merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, part, chunk_id, score): the k best of the lists that tasks hand over."""
    # ascending by the negative score, so that ties go to the smaller key without a comparison of our own
    pairs = F.transform(F.arrays_zip("scores", "ids"), lambda x: F.struct((-x["scores"]).alias("s"), x["ids"].alias("id")))
    lists = found.select("query_id", "part", pairs.alias("l")).groupBy("query_id", "part").agg(F.flatten(F.collect_list("l")).alias("l"))
    return lists.select("query_id", "part", F.explode(F.slice(F.array_sort("l"), 1, k)).alias("x")).select("query_id", "part", F.col("x.id").alias("chunk_id"), (-F.col("x.s")).alias("score"))


def chunked(asked: DataFrame, size: str) -> Iterator[DataFrame]:
    """The queries in sets of some ``CHUNK`` components. ``size``: the column whose lists are counted."""
    parts = max(1, -(-asked.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.size(size)).cast("long")), F.lit(0))).first()[0] // CHUNK))
    for part in range(parts):
        yield asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)


def together(df: DataFrame) -> DataFrame:
    """``df`` in no more tasks than there are cores, as each hands over k hits a query and part."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(cores) if df.rdd.getNumPartitions() > cores else df


def union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def dense_parts(asked: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """(query_id, part, chunk_id, score): the k chunks of each part of largest cosine, exactly, scores rounded to 12 digits.

    asked: (query_id, embedding), read twice and once for each set of them; base: (chunk_id, part, embedding). Vectors are of
    one length; null and zero ones are left out.
    """

    def units(batch: pa.RecordBatch | pa.Table, *keys: str) -> list[np.ndarray]:
        """The keys' columns and unit vectors of rows that have a direction."""
        table = pa.table({c: batch.column(c) for c in (*keys, "embedding")}).combine_chunks()
        table = table.filter(table.column("embedding").is_valid())
        vectors = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 1))
        good = np.isfinite(vectors).all(1) & vectors.any(1)
        vectors = vectors[good]
        return [*[table.column(c).to_numpy()[good] for c in keys], vectors / np.sqrt((vectors * vectors).sum(1))[:, None]]

    def one(some: DataFrame) -> DataFrame:
        sent = base.sparkSession.sparkContext.broadcast(some.toArrow())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, asks = units(sent.value, "query_id")
            best = Best(len(names), k, 12, False)
            if not len(names):
                return

            def look(waiting: list[pa.RecordBatch]) -> None:
                ids, part, vectors = units(pa.Table.from_batches(waiting), "chunk_id", "part")
                for p in np.unique(part):
                    mine = part == p
                    keys, columns = ids[mine], vectors[mine].T
                    step = max(1, SCORES // len(keys))
                    for low in range(0, len(names), step):
                        best.add(int(p), low, keys, asks[low : low + step] @ columns)

            waiting: list[pa.RecordBatch] = []
            for batch in batches:
                waiting.append(batch)
                if sum(b.num_rows for b in waiting) >= 4 * TEXTS:
                    look(waiting)
                    waiting = []
            if waiting:
                look(waiting)
            yield from best.batches(names)

        return base.select("chunk_id", "part", "embedding").mapInArrow(search, FOUND)

    return merged(union([one(some) for some in chunked(asked, "embedding")]), k)


def text_grams(batch: pa.RecordBatch) -> Iterator[tuple[int, str, np.ndarray]]:
    """Row number, form and hashes of exact numbers of the forms that are there."""
    exact = batch.column("exact").to_pylist()
    for at, form in enumerate(batch.column("form").to_pylist()):
        if form is not None:
            yield at, form, np.array(exact[at] or [], np.int64)


def frequencies(texts: DataFrame) -> DataFrame:
    """(fid, df) as ``retrieve.gram_frequency`` gives it, counted batch by batch where texts lie. texts: (form, exact)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def fold(new: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            values, at = np.unique(np.concatenate([v for v, _ in new]), return_inverse=True)
            return values, np.bincount(at, np.concatenate([c for _, c in new]), len(values)).astype(np.int64)

        for batch in batches:
            times: dict[str, list] = {}
            for _, form, exact in text_grams(batch):
                times.setdefault(form, [0, exact])[0] += 1
            for form, (n, exact) in times.items():
                fids, _ = retrieve.gram_counts(form, exact)
                held.append((fids, np.full(len(fids), n, np.int64)))
            if sum(len(v) for v, _ in held[1:]) > COUNTED:
                held = [fold(held)]
        if held:
            values, counts = fold(held)
            for low in range(0, len(values), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(values[low : low + 100_000]), pa.array(counts[low : low + 100_000])], names=["fid", "df"])

    return texts.mapInArrow(count, "fid long, df long").groupBy("fid").agg(F.sum("df").alias("df"))


class Asked:
    """Queries' weights, in order of queries: of frequent features as places in rows of a matrix, of the others as numbers among those asked."""

    def __init__(self, table: pa.Table, known: np.ndarray, column: np.ndarray):
        self.names = table.column("query_id").to_numpy()
        (fids, sizes), (values, _) = retrieve.flat(table.column("fids")), retrieve.flat(table.column("values"))
        at = np.minimum(np.searchsorted(known, fids), len(known) - 1)
        # what no text has adds nothing
        here = known[at] == fids
        row, at, values = np.repeat(np.arange(len(sizes)), sizes)[here], at[here], values[here]
        often = column[at] >= 0
        self.row, self.column, self.value = row[often].astype(np.int32), column[at[often]], values[often]
        self.starts = np.searchsorted(self.row, np.arange(len(sizes) + 1))
        rare = at[~often]
        self.number = np.full(len(known), -1, np.int32)
        wanted = np.unique(rare)
        self.number[wanted] = np.arange(len(wanted), dtype=np.int32)
        self.rare_row, self.rare, self.rare_value, self.wanted = row[~often].astype(np.int32), self.number[rare], values[~often], len(wanted)
        self.rare_starts = np.searchsorted(self.rare_row, np.arange(len(sizes) + 1))

    def matrix(self, low: int, high: int, width: int) -> np.ndarray:
        some = slice(self.starts[low], self.starts[high])
        out = np.zeros((high - low, width))
        out[self.row[some] - low, self.column[some]] = self.value[some]
        return out


class Block:
    """Texts of a block: their frequent features as a matrix, postings of the others that are asked for."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray], column: np.ndarray, asked: Asked):
        self.n, self.width = len(ids), int(column.max(initial=-1)) + 1
        row, at, value = np.repeat(np.arange(self.n, dtype=np.int32), [len(x) for x in ids]), np.concatenate(ids), np.concatenate(values)
        often = column[at] >= 0
        self.matrix = np.zeros((self.n, self.width))
        self.matrix[row[often], column[at[often]]] = value[often]
        number = asked.number[at]
        here = np.flatnonzero(~often & (number >= 0))
        here = here[np.argsort(number[here], kind="stable")]
        self.rows, self.values = row[here], value[here]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(number[here], minlength=asked.wanted))))

    def scores(self, asked: Asked, low: int, high: int) -> np.ndarray:
        """A row a query, a column a text: sums of all products."""
        out = asked.matrix(low, high, self.width) @ self.matrix.T
        start = asked.rare_starts[low : high + 1]
        some = slice(start[0], start[-1])
        rare, row, weight = asked.rare[some], asked.rare_row[some] - low, asked.rare_value[some]
        first = self.starts[rare]
        size = self.starts[rare + 1] - first
        before = np.concatenate(([0], np.cumsum(size)))
        bound = before[start - start[0]]
        a = 0
        while a < high - low:
            b = max(a + 1, int(np.searchsorted(bound, bound[a] + PRODUCTS, "right")) - 1)
            x, y, many = start[a] - start[0], start[b] - start[0], int(bound[b] - bound[a])
            if many:
                at = np.repeat(first[x:y] - before[x:y] + before[x], size[x:y]) + np.arange(many)
                cell = np.repeat((row[x:y] - a).astype(np.int64) * self.n, size[x:y]) + self.rows[at]
                out[a:b] += np.bincount(cell, self.values[at] * np.repeat(weight[x:y], size[x:y]), (b - a) * self.n).reshape(b - a, self.n)
            a = b
        return out


def gram_parts(asked: DataFrame, texts: DataFrame, k: int, frequency: DataFrame, total: int) -> DataFrame:
    """(query_id, part, chunk_id, score): the k chunks of each part of largest TF-IDF cosine, exactly, scores rounded to 9 digits.

    asked: (query_id, fids, values) of ``retrieve.gram_weights``, read twice and once for each set of them. texts: (chunk_id, part,
    form, exact), ``frequency`` (fid, df; broadcast whole) and ``total`` of at least these. Scores of 0 are left out. Texts of
    one form in a block are looked at once.
    """
    spark = texts.sparkSession
    counted = frequency.toArrow().sort_by("fid")
    fids, df = (counted.column(c).to_numpy() for c in ("fid", "df"))
    column = np.full(len(fids), -1, np.int32)
    most = np.argsort(-df, kind="stable")[:FREQUENT]
    column[most] = np.arange(len(most))
    rules = spark.sparkContext.broadcast((fids, np.log((total + 1) / (df + 1)) + 1, column))

    def one(some: DataFrame) -> DataFrame:
        sent = spark.sparkContext.broadcast(some.toArrow())

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, rarity, column = rules.value
            if not len(known) or not sent.value.num_rows:
                return
            mine = Asked(sent.value, known, column)
            best = Best(len(mine.names), k, 9, True)
            place: dict[str, int] = {}
            ids: list[np.ndarray] = []
            values: list[np.ndarray] = []
            rows: list[tuple[int, int, int]] = []

            def look() -> None:
                block = Block(ids, values, column, mine)
                keys, part, text = np.array(rows, np.int64).T
                lots = [(int(p), keys[part == p], text[part == p]) for p in np.unique(part)]
                step = max(1, SCORES // block.n)
                for low in range(0, len(mine.names), step):
                    scores = block.scores(mine, low, min(low + step, len(mine.names)))
                    for p, names, columns in lots:
                        best.add(p, low, names, scores[:, columns])

            for batch in batches:
                keys, part = batch.column("chunk_id").to_pylist(), batch.column("part").to_pylist()
                for at, form, exact in text_grams(batch):
                    if form not in place:
                        found, ns = retrieve.gram_counts(form, exact)
                        number = np.searchsorted(known, found)
                        raw = (1 + np.log(ns)) * rarity[number]
                        place[form] = len(ids)
                        ids.append(number.astype(np.int32))
                        values.append(raw / np.sqrt((raw * raw).sum()) if len(raw) else raw)
                    rows.append((keys[at], part[at], place[form]))
                    if len(ids) >= TEXTS or len(rows) >= ROWS:
                        look()
                        place.clear(), ids.clear(), values.clear(), rows.clear()
            if rows:
                look()
            yield from best.batches(mine.names)

        return texts.select("chunk_id", "part", "form", "exact").mapInArrow(search, FOUND)

    return merged(union([one(some) for some in chunked(asked, "fids")]), k)


def forms(chunks: DataFrame, text: str = "text") -> DataFrame:
    """``chunks`` with ``form`` in place of the text, and ``exact``, the hashes of its exact numbers."""
    found = chunks.withColumn("form", X.plain_matching(F.col(text))).drop(text)
    return found.withColumn("exact", F.transform(X.numbers(F.col("form")), lambda x: F.xxhash64(F.concat(F.lit("exact:"), x))))
