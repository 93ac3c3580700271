"""The prefix trie of conversations that are rebuilt from another one's head and their
own tail.

A turn is an element of a monoid, its hash weighted by a power of a base modulo a prime
(two primes; the element keeps its length, the power and the power's inverse).  The
products of all heads of the stored conversations come from one segmented scan.  A rebuilt
conversation is never put together: the fingerprint of each of its prefixes is composed
from the product of the base conversation's head and of its own tail, which is a
difference of two stored products.  A prefix row refers to the stored turn that it ends in
(the turn's digest and size; texts never move).

Prefix rows with one (depth, fingerprint) are one node.  That they are the same turns is
verified: within every group the referred turns must have one digest and the prefixes
before them one fingerprint, so by induction the whole sequences agree.  A collision changes
the base and starts again, so the result is exact.

Subtree sums need no walk over levels.  Every node belongs to its smallest member, whose
nodes are a chain down to its end.  A node's subtree is the whole chains of all its
members, less what its own chain has above it: one sum over the prefix rows and one scan
along the chains, whatever the depth.

Hot keys: a conversation of any length is spread by the range scan; the root and other common nodes
are partial aggregates; joins on a conversation or a node carry the many rows on one side only,
which Spark splits (AQE); ids that end in one node are packed in sorted pieces before they meet, and
hashed as a stream.

Defined results: turns stand by (turn, role, digest of role and text), nulls first; null role and
text are empty; turns without conv_id are left out; repeated rows are turns of their own;
``%`` of a negative id rounds towards zero, as in SQL; an empty table has no node; other columns
never matter.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphssl.llm.common import partitions
from graphssl.llm.scan import runs, segmented_scan
from graphssl.session import write_table

#: The primes of the two fingerprints (products of two residues fit a long).
PRIMES = (2147483647, 2147483629)
#: Bases that are tried before giving up (each fails with a chance of about rows^2 / 2^62).
TRIES = 8
#: Ids that one packed piece holds at most.
PIECE = 4096

_ELEMENTS = ["pos", *(f"{c}{k}" for k in (1, 2) for c in "wia")]
_UNIT = [0, 1, 1, 0, 1, 1, 0]


def monoid(primes: tuple[int, int]):
    """Its operation on ``(length, power, inverse power, hash)``, the last three per prime."""
    def combine(x, y):
        out = [x[0] + y[0]]
        for k, p in enumerate(primes):
            (w, i, a), (v, j, b) = x[3 * k + 1:3 * k + 4], y[3 * k + 1:3 * k + 4]
            out += [w * v % p, i * j % p, (a + w * b) % p]
        return out
    return combine


def stored_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, bytes`` of every turn; digest and role order ties."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    size = F.octet_length(role).cast("string")
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(size, F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"))


def fifth_heads(turns: DataFrame) -> DataFrame:
    """``conv_id, base, h``: conversation c begins with the first crc32(c) % 9 turns of c - c % 5."""
    c = F.col("conv_id")
    return turns.select("conv_id").distinct().select(
        c, (c - c % 5).alias("base"), (F.crc32(c.cast("string").cast("binary")) % 9).alias("h"))


def head_products(turns: DataFrame, seed: int, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """``turns`` with ``pos`` (from 1), the product of the conversation's head up to there, and
    what the turn itself adds to its hashes (``e1, e2``)."""
    rng, one, own = random.Random(seed), [F.lit(1).cast("long").alias("pos")], []
    for k, p in enumerate(primes, 1):
        base = rng.randrange(2, p)
        back, value = pow(base, -1, p), F.pmod(F.xxhash64("digest", F.lit(seed), F.lit(k)), F.lit(p))
        one += [F.lit(base).cast("long").alias(f"w{k}"), F.lit(back).cast("long").alias(f"i{k}"), value.alias(f"a{k}")]
        own.append((F.col(f"w{k}") * F.lit(back) % p * value % p).alias(f"e{k}"))
    scanned = segmented_scan(turns.select("conv_id", "turn", "role", "digest", "bytes", *one), "conv_id",
                             ["turn", "role", "digest"], _ELEMENTS, _UNIT, monoid(primes), "heads")
    return scanned.select("conv_id", "digest", "bytes", *_ELEMENTS, *own)


def _packed(values):
    return values[0] * F.lit(1 << 31) + values[1]


def prefix_rows(heads: DataFrame, splice: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """Every prefix of every rebuilt conversation (``splice``: ``conv_id, base, h``): ``c, depth, fp, above``
    (the fingerprint one turn shorter), ``digest, bytes`` of the turn it ends in, ``last``."""
    cols, zero = _ELEMENTS[1:], F.lit(0).cast("long")
    sizes = heads.groupBy("conv_id").agg(F.max("pos").alias("n"))
    s = (splice.join(sizes, "conv_id")
         .join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
         .withColumn("hb", F.least("h", F.coalesce("n_base", zero))))
    for of, to, tag in (("base", "hb", "b_"), ("conv_id", "h", "o_")):
        product = heads.select(F.col("conv_id").alias(of), F.col("pos").alias(to), *[F.col(c).alias(tag + c) for c in cols])
        s = s.join(product, [of, to], "left")
    s = write_table(s.select(
        F.col("conv_id").alias("c"), "base", "h", "hb",
        (F.col("hb") + F.greatest(zero, F.col("n") - F.col("h"))).alias("whole"),
        *[F.coalesce(t + c, F.lit(u).cast("long")).alias(t + c) for t in ("b_", "o_") for c, u in zip(cols, _UNIT[1:])]), "splice")
    head = heads.join(s.select("c", F.col("base").alias("conv_id"), "hb", "whole"), "conv_id").where("pos <= hb")
    head = head.select("c", F.col("pos").alias("depth"), _packed([F.col("a1"), F.col("a2")]).alias("fp"), _packed(
        [F.pmod(F.col(f"a{k}") - F.col(f"e{k}"), F.lit(p)) for k, p in enumerate(primes, 1)]).alias("above"),
        "digest", "bytes", "whole")
    tail = heads.join(s.withColumnRenamed("c", "conv_id").drop("base"), "conv_id").where("pos > h")
    now, above = [], []
    for k, p in enumerate(primes, 1):
        # The base's head, then the tail: its products moved from place h to place hb.
        move = F.col(f"b_w{k}") * F.col(f"o_i{k}") % p
        now.append((F.col(f"b_a{k}") + move * F.pmod(F.col(f"a{k}") - F.col(f"o_a{k}"), F.lit(p))) % p)
        above.append(F.pmod(now[-1] - move * F.col(f"e{k}") % p, F.lit(p)))
    tail = tail.select(F.col("conv_id").alias("c"), (F.col("hb") + F.col("pos") - F.col("h")).alias("depth"),
                       _packed(now).alias("fp"), _packed(above).alias("above"), "digest", "bytes", "whole")
    root = s.select("c", zero.alias("depth"), zero.alias("fp"), zero.alias("above"),
                    F.lit(None).cast("binary").alias("digest"), zero.alias("bytes"), "whole")
    return (root.unionByName(head).unionByName(tail)
            .withColumn("last", F.col("depth") == F.col("whole")).drop("whole"))


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per (depth, fingerprint); ``one`` tells whether it is one sequence of turns."""
    return rows.groupBy("depth", "fp").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("last").cast("long")).alias("n_ends"),
        F.min("above").alias("above"), F.max("bytes").alias("bytes"),
        (F.min("above").eqNullSafe(F.max("above")) & F.min("digest").eqNullSafe(F.max("digest"))).alias("one"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive ids of one node as pieces of at most ``PIECE`` ids."""
    for run in runs(batches, ["depth", "fp"]):
        ids = run["c"].to_pylist()
        at = range(0, len(ids), PIECE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([run["depth"][0].as_py()] * len(at), pa.int64()), pa.array([run["fp"][0].as_py()] * len(at), pa.int64()),
             pa.array([ids[i] for i in at], pa.int64()), pa.array([",".join(map(str, ids[i:i + PIECE])) for i in at])],
            names=["depth", "fp", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's pieces, fed as they come."""
    node, state, out = None, None, []
    for batch in batches:
        for depth, fp, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "ids"))):
            if (depth, fp) == node:
                state.update(b",")
            else:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (depth, fp), sha256()
            state.update(ids.encode())
        if out:
            yield _digest_batch(out)
            out = []
    if node:
        yield _digest_batch([(*node, state.hexdigest())])


def _digest_batch(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["depth", "fp", "ends_sha256"])


def end_digests(rows: DataFrame) -> DataFrame:
    """``depth, fp, ends_sha256`` of the nodes in which conversations end."""
    n, key = partitions(rows.sparkSession), ["depth", "fp"]
    ends = write_table(rows.where("last").select("depth", "fp", "c"), "ends")
    packed = ends.repartitionByRange(n, *key, "c").sortWithinPartitions(*key, "c").mapInArrow(
        _pieces, "depth long, fp long, first long, ids string")
    return (packed.repartition(n, *key).sortWithinPartitions(*key, "first")
            .mapInArrow(_digests, "depth long, fp long, ends_sha256 string"))


def prefix_trie(turns: DataFrame, splice: DataFrame | None = None, seed: int = 1,
                primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The nodes of the trie of all conversations of ``turns`` rebuilt by ``splice`` (``conv_id, base, h``; by
    default :func:`fifth_heads`): ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256``."""
    stored = write_table(stored_turns(turns), "turns")
    splice = fifth_heads(stored) if splice is None else splice
    for attempt in range(seed, seed + TRIES):
        rows = write_table(prefix_rows(head_products(stored, attempt, primes), splice, primes), "prefixes")
        nodes = write_table(_nodes(rows), "nodes")
        if nodes.where("not one").isEmpty():
            break
    else:
        raise RuntimeError("the fingerprints of every base collide")
    leaf, saved = (F.col("n_ends") == F.col("n_convs")).cast("long"), (F.col("n_convs") - 1) * F.col("bytes")
    one = F.lit(1).cast("long")
    chains = segmented_scan(
        nodes.select("conv_id", "depth", "fp", "above", "n_convs", leaf.alias("leaf"), saved.alias("saved"),
                     one.alias("place"), leaf.alias("leaf_to"), saved.alias("saved_to")),
        "conv_id", ["depth"], ["place", "leaf_to", "saved_to"], [0, 0, 0], lambda a, b: [x + y for x, y in zip(a, b)], "chains")
    totals = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum(leaf).alias("leaf"), F.sum(saved).alias("saved"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")

    def part(df, depth="depth", fp="fp", children=zero, leaf=zero, saved=zero, conv_id=null, n_convs=null, parent=null, ends=None):
        return df.select(F.col(depth).alias("depth") if isinstance(depth, str) else depth.alias("depth"), F.col(fp).alias("fp"),
                         children.alias("n_children"), leaf.alias("n_leaves"), saved.alias("saved_tokens"), conv_id.alias("conv_id"),
                         n_convs.alias("n_convs"), parent.alias("parent_conv_id"),
                         (F.lit(None).cast("string") if ends is None else ends).alias("ends_sha256"))

    below = part(rows.join(totals, "c"), leaf=F.col("leaf"), saved=F.col("saved"))
    own = part(chains, leaf=F.col("leaf") - F.col("leaf_to"), saved=F.col("saved") - F.col("saved_to"), conv_id=F.col("conv_id"),
               n_convs=F.col("n_convs"), parent=F.when(F.col("place") > 1, F.col("conv_id")))
    children = part(nodes.where("depth > 0"), depth=F.col("depth") - 1, fp="above", children=one)
    tops = chains.where("place = 1 and depth > 0").select("depth", "fp", "above")
    hung = tops.join(nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("above"), "conv_id"), ["depth", "above"])
    parents = part(hung, parent=F.col("conv_id"))
    ends = part(end_digests(rows), ends=F.col("ends_sha256"))
    every = below.unionByName(own).unionByName(children).unionByName(parents).unionByName(ends)
    return every.groupBy("depth", "fp").agg(
        F.max("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
        F.coalesce(F.max("ends_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
