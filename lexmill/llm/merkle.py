"""Merkle manifest of a dataset with incremental witnesses.

A leaf is the hash of a row; the leaves of a source, by ascending ``doc_id``, grow a tree whose runs of ``WIDTH``
consecutive nodes become their hash, level by level, until one node remains; these subroots, ordered by source, grow
one more tree to the root. H is the lower-case hex SHA-256 of hex digests written one after another.

A tree grows by appends. A *frontier* holds the open runs of every level. A node that is appended to a run waits there
with all that lies below it; when the run is complete, each member's subtree gets its other members as one more step
of its partial witness, and the run's hash is appended to the next level. What is still open at the end closes likewise.
So a row's witness is what was attached to its subtrees, read upwards.

Distribution: leaves get their positions from ranges, not from a global window, and fall into aligned blocks of
``WIDTH ** levels`` leaves. A task streams a block past a frontier; the blocks' roots are nodes of the next round, which
appends them in blocks in the same way, and so on until every tree has one node: the number of rounds grows with the
logarithm of the largest tree. On the way back each block meets its root's witness (one row per block), so a witness
meets the rows of its block inside one task. No task holds more than a block, and nothing whole passes the driver.

Cases: nulls in any column are the field ``-``; an empty text is ``0:``; a null source is a source of its own and first,
a null ``doc_id`` is first in its source and never tampered with; rows that repeat an id stand side by side in the order of their
leaves, and equal rows each have a leaf; a single row is its own subroot and root with a proof of no siblings; other
columns are not looked at; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.positions import positions
from . import common

WIDTH = 3
#: Levels that a block goes up: blocks of 3 ** 7 = 2187 nodes.
LEVELS = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(**fields: Column) -> Column:
    """The hash of a row: every field as its UTF-8 byte count, a colon and its value; ``-`` for null."""
    shown = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in fields.values()]
    return F.sha2(F.concat(*shown), 256)


def digest(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


@dataclass(slots=True)
class Node:
    """A subtree: its hash and, once its run is complete, the siblings on its left and right and the node above."""

    value: str
    left: str = ""
    right: str = ""
    above: Node | None = None


@dataclass
class Frontier:
    """The open runs of a growing tree."""

    runs: list[list[Node]] = field(default_factory=list)

    def append(self, node: Node, level: int = 0) -> None:
        while len(self.runs) <= level:
            self.runs.append([])
        run = self.runs[level]
        run.append(node)
        if len(run) == WIDTH:
            self.runs[level] = []
            self.append(_complete(run), level + 1)

    def close(self, levels: int) -> Node:
        """Complete open runs up to ``levels`` levels; the node that remains."""
        for level in range(levels):
            while len(self.runs) <= level + 1:
                self.runs.append([])
            run, self.runs[level] = self.runs[level], []
            if run:
                self.append(_complete(run), level + 1)
        return self.runs[levels][0]


def _complete(run: list[Node]) -> Node:
    above = Node(digest(*[n.value for n in run]))
    for i, n in enumerate(run):
        n.left, n.right, n.above = "".join(m.value for m in run[:i]), "".join(m.value for m in run[i + 1:]), above
    return above


def height(nodes: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while nodes > 1:
        nodes, levels = -(-nodes // WIDTH), levels + 1
    return levels


def grow(values: list[str], levels: int) -> tuple[list[Node], Node]:
    frontier, leaves = Frontier(), [Node(v) for v in values]
    for n in leaves:
        frontier.append(n)
    return leaves, frontier.close(levels)


def steps(node: Node) -> list[tuple[str, str]]:
    """(left, right) siblings of a node and of those above it in its block."""
    out = []
    while node.above is not None:
        out.append((node.left, node.right))
        node = node.above
    return out


def fold(value: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        value = digest(left, value, right)
    return value


def pack_steps(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in path)


def unpack_steps(text: str | None) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in text.split(";")] if text else []


@dataclass
class Round:
    """Nodes of all trees in blocks: ``tree, block, members array<struct<pos, value, ...>>, levels``; ``last``: one block a tree."""

    blocks: DataFrame
    last: bool


def _blocks(nodes: DataFrame, levels: int, carried: tuple[str, ...] = ()) -> Round:
    """Nodes (tree, pos, value) of one round as one row per aligned block of ``WIDTH ** levels``."""
    size = WIDTH**levels
    counts = nodes.groupBy("tree").agg(F.count("*").alias("nodes"))
    rows = nodes.groupBy("tree", F.floor(F.col("pos") / size).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "value", *carried))).alias("members"))
    height_of = F.ceil(F.log(F.col("nodes") - 0.5) / math.log(WIDTH))  # exact: the half keeps powers of the width off the edge
    counts = counts.select(
        F.col("tree").alias("_tree"), F.when(F.col("nodes") > 1, F.least(F.lit(levels), height_of)).otherwise(0).cast("int").alias("levels"))
    met = common.stage(rows.join(counts, F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree"), "merkle-blocks")
    return Round(met, (met.agg(F.max("block")).first()[0] or 0) == 0)


def _roots(blocks: DataFrame) -> DataFrame:
    """``tree, pos, value``: the root of every block as a node of the next round."""

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        for rows in slices:
            found = [grow([m["value"] for m in members], levels)[1].value for members, levels in zip(rows["members"], rows["levels"])]
            yield {"tree": rows["tree"], "pos": rows["block"], "value": found}

    return common.map_batches(
        blocks.select("tree", "block", F.transform("members", lambda m: F.struct(m["value"].alias("value"))).alias("members"), "levels"),
        {"tree": pa.string(), "pos": pa.int64(), "value": pa.string()}, "tree string, pos long, value string", work, rows_at_once=16)


def _witnesses(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """``tree, pos, path``: every node's witness, its block's steps and then those of the block's root."""
    met = blocks if above is None else _with_path(blocks, above)
    path = F.lit("").alias("path") if above is None else F.col("path")
    rows = met.select("tree", F.transform("members", lambda m: F.struct(m["pos"].alias("pos"), m["value"].alias("value"))).alias("members"), "levels", path)

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        for rows in slices:
            for tree, members, levels, path in zip(rows["tree"], rows["members"], rows["levels"], rows["path"]):
                leaves, _ = grow([m["value"] for m in members], levels)
                own = [";".join(x for x in (pack_steps(steps(n)), path) if x) for n in leaves]
                yield {"tree": [tree] * len(own), "pos": [m["pos"] for m in members], "path": own}

    return common.map_batches(
        rows, {"tree": pa.string(), "pos": pa.int64(), "path": pa.string()}, "tree string, pos long, path string", work, rows_at_once=16)


def _with_path(blocks: DataFrame, above: DataFrame) -> DataFrame:
    up = above.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), "path")
    return blocks.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_pos"))).drop("_tree", "_pos")


@dataclass
class Forest:
    """Trees over nodes: the rounds from the leaves up, and each tree's ``root`` (tree, value)."""

    rounds: list[Round]
    roots: DataFrame

    def paths(self) -> DataFrame | None:
        """``tree, pos, path`` of the roots of the first round's blocks; None where there is no round above."""
        above = None
        for r in reversed(self.rounds[1:]):
            above = common.stage(_witnesses(r.blocks, above), "merkle-paths")
        return above


def forest(nodes: DataFrame, levels: int = LEVELS, carried: tuple[str, ...] = ()) -> Forest:
    """Grow trees from nodes (tree string, pos long from 0, value string, and ``carried`` columns of the leaves)."""
    rounds = [_blocks(nodes, levels, carried)]
    while True:
        roots = common.stage(_roots(rounds[-1].blocks), "merkle-roots")
        if rounds[-1].last:
            return Forest(rounds, roots.select("tree", "value"))
        rounds.append(_blocks(roots, levels))


def leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf, tampered``: the hash of every row, and of the row whose text lost its line ends where that is tried."""
    kinds = {"doc_id": "long", "source": "string", "lang": "string", "n_chars": "long", "text": "string"}
    typed = docs.select(*[F.col(c).cast(kinds[c]).alias(c) for c in FIELDS])
    fields = {c: F.col(c).cast("string") for c in FIELDS}
    tried = F.coalesce(F.crc32(fields["doc_id"]) % 2 == 0, F.lit(False)) & F.contains("text", F.lit("\n"))
    return typed.select(
        "source", "doc_id", leaf(**fields).alias("leaf"),
        F.when(tried, leaf(**{**fields, "text": F.replace("text", F.lit("\n"), F.lit(""))})).alias("tampered"))


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``doc_id, source, leaf, subroot, root, n_siblings, proof_sha256, folded_root, verified`` of every row.

    ``folded_root`` is computed from the tampered leaf (the leaf itself where nothing changed) and the witness of the row.
    """
    placed = positions(leaves(docs), [F.asc_nulls_first("doc_id"), F.asc("leaf")], by=("source",), name="pos")
    own = forest(
        placed.withColumnRenamed("source", "tree").withColumnRenamed("leaf", "value"), levels, carried=("doc_id", "tampered"))
    # the subroots are the leaves of one more tree, whose name is no source's
    top = positions(own.roots, [F.asc_nulls_first("tree")], name="pos").withColumnRenamed("tree", "source")
    crown = forest(top.withColumn("tree", F.lit("")), levels, carried=("source",))
    root = crown.roots.first()  # one row, or none of an empty table

    up = crown.paths()
    crown_blocks = crown.rounds[0].blocks
    source_paths = _source_paths(crown_blocks, up).withColumn("root", F.lit(root["value"] if root else None).cast("string"))
    blocks, above = own.rounds[0].blocks, own.paths()
    if above is not None:
        blocks = _with_path(blocks, above)
    else:
        blocks = blocks.withColumn("path", F.lit(""))
    rows = blocks.join(source_paths, F.col("tree").eqNullSafe(F.col("source"))).select(
        F.col("tree").alias("source"), "members", "levels", "path", "subroot", "crown", "root")
    return _prove(rows)


def _source_paths(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    """``source, subroot, crown``: every subroot with its witness in the tree of the subroots."""
    met = blocks.withColumn("path", F.lit("")) if above is None else _with_path(blocks, above)

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        for rows in slices:
            for members, levels, path in zip(rows["members"], rows["levels"], rows["path"]):
                nodes, _ = grow([m["value"] for m in members], levels)
                yield {
                    "source": [m["source"] for m in members], "subroot": [m["value"] for m in members],
                    "crown": [";".join(x for x in (pack_steps(steps(n)), path) if x) for n in nodes],
                }

    return common.map_batches(
        met.select("members", "levels", "path"), {c: pa.string() for c in ("source", "subroot", "crown")},
        "source string, subroot string, crown string", work, rows_at_once=16)


def _prove(rows: DataFrame) -> DataFrame:
    kinds = dict(
        doc_id=pa.int64(), source=pa.string(), leaf=pa.string(), subroot=pa.string(), root=pa.string(), n_siblings=pa.int64(),
        proof_sha256=pa.string(), folded_root=pa.string(), verified=pa.bool_())

    def work(slices: Iterator[dict]) -> Iterator[dict]:
        for rows in slices:
            for source, members, levels, path, subroot, crown, root in zip(*[rows[c] for c in ("source", "members", "levels", "path", "subroot", "crown", "root")]):
                nodes, _ = grow([m["value"] for m in members], levels)
                upper = unpack_steps(path) + unpack_steps(crown)
                shared, folded = "".join(a + b for a, b in upper), {}  # untampered rows of a block fold to one node
                out = {k: [] for k in kinds}
                for m, node in zip(members, nodes):
                    lower = steps(node)
                    siblings = "".join(a + b for a, b in lower) + shared
                    at = fold(m["tampered"] or m["value"], lower)
                    if at not in folded:
                        folded[at] = fold(at, upper)
                    for k, v in zip(out, (m["doc_id"], source, m["value"], subroot, root, len(siblings) // 64, digest(siblings), folded[at], folded[at] == root)):
                        out[k].append(v)
                yield out

    return common.map_batches(
        rows, kinds, "doc_id long, source string, leaf string, subroot string, root string, n_siblings long, proof_sha256 string, "
        "folded_root string, verified boolean", work, rows_at_once=8)
