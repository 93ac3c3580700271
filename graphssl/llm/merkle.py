"""Merkle manifest of a documents table with octopus multiproofs.

Every row is a leaf.  Per lang the leaves stand by doc_id and form a binary tree; the
roots of these trees, by lang, form the last tree, whose root stands for the table.

``manifest`` hashes the texts where they are read (they never move), numbers
the narrow leaf rows by a range scan, and grows the trees in rounds of ``BITS`` levels: a
task sees whole blocks of ``2 ** BITS`` neighbours, whose top nodes are the next round's
leaves, so a tree of any size costs one round per ``BITS`` levels.

``prove`` gives the proofs of any set of leaves.  A leaf partition is a block.  Each one
works out the least union of node coordinates that its proofs need and its own leaves do
not give, up to the last root; all requests are fetched in one join;
the block derives the interior nodes that its proofs share once, and expands every proof
from them.

Defined results: a null lang is a tree of its own, the first one; a null doc_id is the
smallest; rows with equal lang and doc_id stand by their leaf hash (equal rows are
interchangeable); null fields are ``-``, an empty text is ``0:``; a table of one row has its leaf as
root and an empty proof; an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphssl.llm.common import partitions
from graphssl.llm.scan import runs, segmented_scan
from graphssl.operators.sizing import small_hint
from graphssl.session import write_table

#: Levels that one round grows; a block has ``2 ** BITS`` leaves at most.
BITS = 12
#: The tree of the per-lang roots.
TOP = -1
#: Request or tree rows that are broadcast at most (a few numbers each).
BROADCAST_ROWS = 500_000

_NODE = "tree long, level int, idx long, hash binary"


class Manifest(NamedTuple):
    """``leaves``: tree, pos, n (leaves of the tree), doc_id, leaf, told; ``nodes``: tree, level,
    idx, hash of every node, leaves and the last tree among them; ``n_trees``."""
    leaves: DataFrame
    nodes: DataFrame
    n_trees: int


def node_hash(children: list[bytes]) -> bytes:
    """The hash of one or two nodes."""
    return sha256("".join(c.hex() for c in children).encode()).digest()


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The leaf of a row (binary); each field is its UTF-8 length, ``:`` and itself, or ``-``."""
    fields = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    return F.unhex(F.sha2(F.concat(*[
        F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
        for c in fields]), 256))


def tampered_leaves(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, leaf, told``: ``told`` is the leaf that a reader is told where it
    differs from the row's own: with 7 dividing the crc32 of its doc_id, n_chars has
    one more."""
    col = {c: F.col(c).cast(t) for c, t in (("doc_id", "long"), ("source", "string"), ("lang", "string"),
                                            ("n_chars", "decimal(20,0)"), ("text", "string"))}
    hit = F.crc32(col["doc_id"].cast("string")) % 7 == 0
    more = dict(col, n_chars=col["n_chars"] + 1)
    return docs.select(col["doc_id"].alias("doc_id"), col["lang"].alias("lang"), leaf_hash(**col).alias("leaf"),
                       F.when(hit, leaf_hash(**more)).alias("told"))


def _grow(base: int, bits: int):
    """Nodes above the blocks of a round (rows tree, block, idx, hash, in order)."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ([], [], [], [])
        for run in runs(batches, ["tree", "block"]):
            tree, block = run["tree"][0].as_py(), run["block"][0].as_py()
            row, first, level = run["hash"].to_pylist(), block << bits, base
            # The last block of a tree of many goes up with the others.
            while len(row) > 1 or (block and level < base + bits):
                row = [node_hash(row[i:i + 2]) for i in range(0, len(row), 2)]
                first, level = first >> 1, level + 1
                for into, values in zip(out, ([tree] * len(row), [level] * len(row), range(first, first + len(row)), row)):
                    into.extend(values)
            if len(out[0]) >= 1 << bits:
                yield _nodes(out)
                out = ([], [], [], [])
        if out[0]:
            yield _nodes(out)
    return kernel


def _nodes(out) -> pa.RecordBatch:
    tree, level, idx, hashes = out
    return pa.RecordBatch.from_arrays([pa.array(tree, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64()),
                                       pa.array(hashes, pa.binary())], names=["tree", "level", "idx", "hash"])


def _blocks(rows: DataFrame, at: str, bits: int) -> DataFrame:
    """``rows`` with their ``block``, whole blocks in a partition, in order."""
    n = partitions(rows.sparkSession)
    rows = rows.withColumn("block", F.shiftright(at, bits))
    return rows.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", at)


def grow(leaves: DataFrame, bits: int = BITS) -> DataFrame:
    """All nodes (``tree, level, idx, hash``) of trees with leaves ``tree, pos, hash``."""
    rows = leaves.select("tree", F.col("pos").alias("idx"), "hash")
    every, base = rows.select("tree", F.lit(0).alias("level"), "idx", "hash"), 0
    while True:
        new = write_table(_blocks(rows, "idx", bits).mapInArrow(_grow(base, bits), _NODE), "nodes")
        every, base = every.unionByName(new), base + bits
        rows = new.where(F.col("level") == base).select("tree", "idx", "hash")
        if rows.where("idx > 0").isEmpty():
            return every


def manifest(leaves: DataFrame, bits: int = BITS) -> Manifest:
    """The trees of ``doc_id, lang, leaf, told``."""
    rows = write_table(leaves.select("doc_id", "lang", "leaf", "told", F.lit(1).cast("long").alias("pos")), "leaves")
    placed = segmented_scan(rows, "lang", ["doc_id", "leaf"], ["pos"], [0], lambda a, b: [a[0] + b[0]], "placed")
    placed = placed.select(F.col("_seg").alias("tree"), (F.col("pos") - 1).alias("pos"), "doc_id", "leaf", "told")
    sizes = write_table(placed.groupBy("tree").agg(F.count(F.lit(1)).alias("n")), "sizes")
    n_trees = sizes.count()
    nodes = grow(placed.select("tree", "pos", F.col("leaf").alias("hash")), bits)
    roots = (nodes.where("idx = 0").groupBy("tree").agg(F.max_by("hash", "level").alias("hash"))
             .select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), "hash"))
    top = grow(write_table(roots, "roots"), bits)
    sized = placed.join(small_hint(sizes, n_trees, BROADCAST_ROWS), "tree")
    return Manifest(sized, nodes.unionByName(top), n_trees)


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n``."""
    return max(0, n - 1).bit_length()


def missing(positions, n: int) -> list[tuple[int, int]]:
    """The least set of ``(level, idx)`` that, with the leaves at ``positions``, gives all their
    proofs in a tree of ``n`` leaves."""
    idx, out = np.unique(np.asarray(positions, np.int64)), []
    for level in range(height(n)):
        beside = idx ^ 1
        out += [(level, int(i)) for i in np.setdiff1d(beside[beside < n], idx)]
        idx, n = np.unique(idx >> 1), (n + 1) // 2
    return out


def _ask(n_trees: int):
    """The requests of every block: ``tree, block, of, level, idx``."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["tree", "block"]):
            tree, block = run["tree"][0].as_py(), run["block"][0].as_py()
            asked = [(tree, *c) for c in missing(run["pos"].to_numpy(), run["n"][0].as_py())]
            asked += [(TOP, *c) for c in missing([tree], n_trees)]
            if asked:
                of, level, idx = zip(*asked)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([tree] * len(of), pa.int64()), pa.array([block] * len(of), pa.int64()),
                     pa.array(of, pa.int64()), pa.array(level, pa.int32()), pa.array(idx, pa.int64())],
                    names=["tree", "block", "of", "level", "idx"])
    return kernel


class _Tree:
    """What a block knows of a tree of ``n`` leaves: per level the hashes by index."""

    def __init__(self, n: int):
        self.height, self.known = height(n), [{} for _ in range(height(n) + 1)]

    def derive(self, positions) -> None:
        """All nodes above the leaves at ``positions``, each once."""
        idx = positions
        for level in range(self.height):
            row, above, idx = self.known[level], self.known[level + 1], np.unique(np.asarray(idx) >> 1).tolist()
            for i in idx:
                above[i] = node_hash([row[j] for j in (2 * i, 2 * i + 1) if j in row])

    def beside(self, pos: int) -> list[tuple[bytes | None, bool]]:
        """Per level the sibling of ``pos``'s ancestor (None: it has none) and whether it stands left."""
        return [(self.known[level].get((pos >> level) ^ 1), bool(pos >> level & 1)) for level in range(self.height)]

    def root(self) -> bytes:
        return self.known[self.height][0]


def folded(leaf: bytes, siblings: list[tuple[bytes | None, bool]]) -> bytes:
    """The root that ``leaf`` gives with these siblings."""
    for other, left in siblings:
        leaf = node_hash([leaf] if other is None else [other, leaf] if left else [leaf, other])
    return leaf


def _expand(n_trees: int):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, ["tree", "block"]):
            rows = run.to_pylist()
            own = [r for r in rows if r["level"] is None]
            if not own:
                continue
            tree, trees = own[0]["tree"], {own[0]["tree"]: _Tree(own[0]["n"]), TOP: _Tree(n_trees)}
            mine, top = trees[tree], trees[TOP]
            for r in rows:
                if r["level"] is not None:
                    trees[r["of"]].known[r["level"]][r["idx"]] = r["hash"]
            for r in own:
                mine.known[0][r["idx"]] = r["hash"]
            mine.derive([r["idx"] for r in own])
            top.known[0][tree] = mine.root()
            top.derive([tree])
            above, root = top.beside(tree), top.root()
            out = []
            for r in own:
                proof = mine.beside(r["idx"]) + above
                got = folded(r["told"] or r["hash"], proof)
                out.append((r["doc_id"], r["hash"].hex(), mine.root().hex(), root.hex(),
                            node_hash([other for other, _ in proof if other is not None]).hex(), got.hex(), got == root))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PROOF_TYPES)], names=_PROOF_NAMES)
    return kernel


_PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROOF_NAMES = [c.split()[0] for c in _PROOF.split(", ")]
_PROOF_TYPES = [pa.int64(), *[pa.string()] * 5, pa.bool_()]


def prove(tree: Manifest, wanted: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """The proofs of ``wanted`` (rows of ``tree.leaves``; all of them by default), folded from the
    leaf that was told, else the leaf itself."""
    rows = (tree.leaves if wanted is None else wanted).select("tree", "pos", "n", "doc_id", "leaf", "told")
    asked = write_table(_blocks(rows.select("tree", "pos", "n"), "pos", bits).mapInArrow(
        _ask(tree.n_trees), "tree long, block long, of long, level int, idx long"), "asked")
    node = tree.nodes.select(F.col("tree").alias("of"), "level", "idx", "hash")
    got = node.join(small_hint(asked, asked.count(), BROADCAST_ROWS), ["of", "level", "idx"])
    own = rows.select("tree", F.shiftright("pos", bits).alias("block"), F.lit(None).cast("long").alias("of"),
                      F.lit(None).cast("int").alias("level"), F.col("pos").alias("idx"), F.col("leaf").alias("hash"),
                      "told", "doc_id", "n")
    both = own.unionByName(got, allowMissingColumns=True)
    n = partitions(rows.sparkSession)
    return (both.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "level", "idx")
            .mapInArrow(_expand(tree.n_trees), _PROOF))
