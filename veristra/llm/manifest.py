"""A Merkle manifest: every row is a leaf, rows of a group form a tree, and the groups' roots form one above them.

Leaves are numbered within their group and cut into large aligned blocks, which executors reduce to one node each.
These few nodes are the leaves of a small upper tree that the driver builds; the path from each block to the root is
broadcast back, and executors finish the proof of each row and fold it. More block nodes than the driver should hold
are reduced in blocks once more, and then their paths are joined in place of being broadcast.

A node's digest is the SHA-256 of its one or two children's digests as hexadecimal text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veristra.llm.common import cut_lineage, fresh, ranked

#: Block nodes that the driver takes, with paths of some 20 steps of 70 bytes.
TOP_MOST = 1 << 14
#: Least and most leaves of a block, as powers of two; between them, so many that half of TOP_MOST blocks suffice.
BITS = (10, 16)
STEPS = "array<struct<digest:string,before:boolean>>"
ARROW_STEPS = pa.list_(pa.struct([("digest", pa.string()), ("before", pa.bool_())]))


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields one after the other: ``-`` for a null, else UTF-8 byte count, colon, value as text."""

    def put(field: Column) -> Column:
        value = field.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[put(f) for f in fields]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.when(step["before"], F.concat(step["digest"], node)).otherwise(F.concat(node, step["digest"])), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's digests, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda step: step["digest"]), ""), 256)


def climb(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """The nodes of each level from these up, for so many levels or until one node remains."""
    found = [nodes]
    while len(found) <= levels if levels is not None else len(found[-1]) > 1:
        last = found[-1]
        found.append([hashlib.sha256("".join(last[i : i + 2]).encode()).hexdigest() for i in range(0, len(last), 2)])
    return found


def steps(levels: list[list[str]]) -> Iterable[list[tuple[str, bool]]]:
    """Of each node of the lowest level, the siblings up to the highest one, and whether they stand before the path.

    A node without a sibling has an empty digest there, which leaves its own digest to be hashed alone.
    """
    for place in range(len(levels[0])):
        yield [((level[at ^ 1], bool(at & 1)) if at ^ 1 < len(level) else ("", False)) for height, level in enumerate(levels[:-1]) for at in [place >> height]]


def _block(table: pa.Table, bits: int, pos: str, digest: str) -> tuple[pa.Table, list[list[str]]]:
    """A block's rows in order and its levels: a full or later block has exactly ``bits`` above it, a lone one what it needs."""
    table = table.sort_by(pos)
    nodes = table.column(digest).to_pylist()
    lone = table.column(pos)[0].as_py() >> bits == 0 and len(nodes) < 1 << bits
    return table, climb(nodes, None if lone else bits)


def _blocks(nodes: DataFrame, bits: int) -> DataFrame:
    """(grp, pos, digest): the nodes that blocks of (grp, pos, digest) reduce to."""

    def reduced(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, levels = _block(table, bits, "pos", "digest")
        return pa.table({"grp": pa.array([key[0].as_py()], pa.string()), "pos": pa.array([key[1].as_py()], pa.int64()), "digest": pa.array(levels[-1])})

    return nodes.select("grp", F.shiftright("pos", bits).alias("block"), "pos", "digest").groupBy("grp", "block").applyInArrow(reduced, "grp string, pos long, digest string")


def _with_steps(nodes: DataFrame, bits: int, name: str) -> DataFrame:
    """``nodes`` and the steps of each within its block; grp, pos and digest are three of its columns."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in nodes.schema)}, `{name}` {STEPS}"

    def paths(table: pa.Table) -> pa.Table:
        table, levels = _block(table, bits, "pos", "digest")
        n, height = len(levels[0]), len(levels) - 1
        digests, before = np.full((n, height), "", dtype=object), np.zeros((n, height), bool)
        for at, level in enumerate(levels[:-1]):
            sibling = np.arange(n) >> at ^ 1
            has = sibling < len(level)
            digests[has, at] = np.array(level, dtype=object)[sibling[has]]
            before[:, at] = has & ((np.arange(n) >> at) & 1 == 1)
        flat = pa.StructArray.from_arrays([pa.array(digests.ravel(), pa.string()), pa.array(before.ravel())], ["digest", "before"])
        return table.append_column(name, pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * height), flat, type=ARROW_STEPS))

    block = F.shiftright("pos", bits)
    return nodes.groupBy("grp", block).applyInArrow(paths, schema)


def _ascend(nodes: DataFrame, most: int, bits: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """(grp, pos, path) of (grp, pos, digest) up to the group's root, and the roots (grp, digest).

    Up to ``most`` nodes are brought to the driver, which builds their tree; more go by blocks. Groups that consist of
    one node each are their own roots.
    """
    spark = nodes.sparkSession
    got = nodes.select("grp", "pos", "digest").limit(most + 1).collect()
    if len(got) <= most:
        groups = defaultdict(list)
        for row in sorted(got, key=lambda r: r.pos):
            groups[row.grp].append(row.digest)
        trees = {g: climb(found) for g, found in groups.items()}
        paths = [(g, at, path) for g, levels in trees.items() for at, path in enumerate(steps(levels))]
        return F.broadcast(spark.createDataFrame(paths, f"grp string, pos long, path {STEPS}")), F.broadcast(spark.createDataFrame([(g, levels[-1][0]) for g, levels in trees.items()], "grp string, digest string"))
    if nodes.where("pos > 0").isEmpty():
        return nodes.select("grp", "pos", F.array().cast(STEPS).alias("path")), nodes.select("grp", "digest")
    return _by_blocks(nodes, most, bits, "path")


def _by_blocks(nodes: DataFrame, most: int, bits: tuple[int, int], name: str) -> tuple[DataFrame, DataFrame]:
    """``nodes`` with each one's path to its group's root, and the roots (grp, digest)."""
    size = min(bits[1], max(bits[0], ceil(log2(max(1, nodes.count()) / max(1, most // 2)))))
    top, roots = _ascend(cut_lineage(_blocks(nodes, size)), most, bits)
    low, g, b, p = fresh(nodes, "__low", "__grp", "__block", "__upper")
    upper = top.select(F.col("grp").alias(g), F.col("pos").alias(b), F.col("path").alias(p))
    own = _with_steps(nodes, size, low)
    joined = own.join(upper, own["grp"].eqNullSafe(upper[g]) & (F.shiftright(own["pos"], size) == upper[b]))
    return joined.withColumn(name, F.concat(low, p)).drop(low, g, b, p), roots


def manifest(leaves: DataFrame, group: str = "lang", order: str = "doc_id", leaf: str = "leaf", most: int = TOP_MOST, bits: tuple[int, int] = BITS) -> DataFrame:
    """``leaves`` with ``subroot`` (of the row's group), ``root`` and ``proof`` (steps from the leaf to the root).

    leaves: group (text, nulls form a group), order, leaf (a digest) and any other columns, which stay; hand over few and
    short ones. Leaves ascend by order (null first) within a group, then by digest: rows of like order and digest may
    change places, which changes no root. Roots of groups are ordered by UTF-8 bytes, null first. A group of one row
    is its own subroot, a single group's subroot the root. Repeated rows are leaves each. An empty table gives no rows.
    Columns called subroot, root or proof are replaced.
    """
    rest = leaves.drop("subroot", "root", "proof")
    grp, pos, digest = "grp", "pos", "digest"
    names = [f"c{i}" for i in range(len(rest.columns))]
    plain = rest.toDF(*names)
    at = dict(zip(rest.columns, names, strict=True))
    keyed = plain.select(F.col(at[group]).cast("string").alias(grp), F.col(at[leaf]).alias(digest), *names)
    placed = ranked(keyed, [grp], [F.col(at[order]).asc_nulls_first(), F.col(digest)], rank=pos)
    own, subroots = _by_blocks(placed, most, bits, "path")
    # the groups' roots, few or many, are the leaves of one more tree
    few = ranked(subroots.select(F.col("grp").alias("name"), F.col("digest").alias("sub"), F.encode("grp", "utf-8").alias("bytes")), [], [F.col("bytes").asc_nulls_first()], rank=pos)
    heads = few.select(F.lit(None).cast("string").alias(grp), pos, F.col("sub").alias(digest), "name")
    above, root = _ascend(heads, most, bits)
    tops = heads.join(above.select(F.col(pos).alias("p"), F.col("path").alias("up")), F.col(pos) == F.col("p"))
    tops = tops.join(root.select(F.col(grp).alias("g"), F.col(digest).alias("root")), F.col(grp).eqNullSafe(F.col("g")))
    tops = tops.select("name", F.col(digest).alias("subroot"), "up", "root")
    if tops.limit(most + 1).count() <= most:
        tops = F.broadcast(tops)
    done = own.join(tops, own[grp].eqNullSafe(tops["name"]))
    return done.select(*[F.col(n).alias(c) for c, n in at.items()], "subroot", "root", F.concat("path", "up").alias("proof"))
