"""Links between items that collide in hash buckets, and their components.

``bucket_links`` never forms all pairs of a bucket.  First every bucket's smallest
item is compared with its other items.  A bucket whose items are then all in one
component is done; that settles groups of near copies, however large.  In the
others (texts around a common passage, copies with many changes) the items meet
again in the finer buckets of an exact prefix filter (with place and bitmap
filters), and only items of different components are compared there: some leaders per bucket and round with the items
outside their component, after which they lead no more.  The end is reached when
no bucket has two components with an untested pair, so the components are those
that testing all colliding pairs would give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphssl.llm.common import mix64, shingles, steps, utf8, word_hashes
from graphssl.operators.sizing import small_hint
from graphssl.session import write_table

#: Rows of a few longs that may be broadcast.
BROADCAST_ROWS = 500_000
#: Words of 64 bits of an item's parity sketch.
SKETCH = [f"s{i}" for i in range(16)]
#: Comparisons with one item that travel together (more are salted).
PER_SALT = 256
#: Leaders of a bucket in the first round, and how many times more there are after each round.
FIRST_LEADERS, MORE_LEADERS = 16, 16


def components(links: DataFrame) -> DataFrame:
    """``(item, label)`` of every item in ``links(a, b)``: the smallest item of its
    component.  Each round hangs every item on its smallest neighbour, follows these to their
    roots and keeps the links between different roots only, so that later rounds have
    fewer links and at most half the items; tables are broadcast while they are small."""
    both = write_table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .filter("a != b"), "links")
    label = None
    while label is None or both.limit(1).count():
        root = write_table(both.groupBy(F.col("a").alias("item")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
        n, moved = root.count(), True

        def of(key: str, value: str) -> DataFrame:
            return small_hint(root.select(F.col("item").alias(key), F.col("label").alias(value)), n, BROADCAST_ROWS)

        while n and moved:
            new = write_table(root.join(of("label", "up"), "label").select(
                "item", F.col("label").alias("old"), F.col("up").alias("label")), "labels")
            moved = new.filter("label != old").limit(1).count()
            root = new.select("item", "label")
        label = root if label is None else write_table(label.join(of("label", "up"), "label", "left").select(
            "item", F.coalesce("up", "label").alias("label")), "labels")
        both = write_table(both.join(of("a", "x"), "a").join(of("b", "y"), "b").filter("x != y")
                           .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return label


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """``label`` of :func:`components` after more ``links(a, b)``: only the components that these touch are
    joined, as items of a small graph of labels."""
    n = label.count()

    def named(key: str) -> DataFrame:
        return small_hint(label.select(F.col("item").alias(key), F.col("label").alias(f"_{key}")), n, BROADCAST_ROWS)

    between = links.join(named("a"), "a", "left").join(named("b"), "b", "left").select(
        F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    up = components(between).select(F.col("item").alias("label"), F.col("label").alias("up"))
    many = up.count()
    if not many:
        return label
    # a component is named by its smallest item, also one of a single item, which has no row yet
    every = label.unionByName(up.select(F.col("label").alias("item"), "label")).distinct()
    return write_table(every.join(small_hint(up, many, BROADCAST_ROWS), "label", "left").select(
        "item", F.coalesce("up", "label").alias("label")), "labels")


def overlap(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    """``(a, b, text_a, text_b)`` rows whose texts' shingle multisets have a Jaccard
    similarity of at least ``least``, as ``(a, b)``."""
    for batch in batches:
        cols = [batch.column(c).cast(pa.large_string()) for c in ("text_a", "text_b")]
        size = utf8(cols[0])[1] + utf8(cols[1])[1]
        keep = np.zeros(batch.num_rows, bool)
        for i, j in steps(size):
            n = j - i
            found = []
            for c in cols:
                data, off = utf8(c.slice(i, n))
                h, row = word_hashes(data, off)
                found.append(shingles(h, row, n, width))
            h = np.concatenate([x[0] for x in found])
            row = np.concatenate([x[1] for x in found])
            side = np.repeat([0, 1], [len(found[0][0]), len(found[1][0])])
            order = np.lexsort((h, row))
            h, row, side = h[order], row[order], side[order]
            if not len(h):
                keep[i:j] = True            # two texts without words
                continue
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
            in_b = np.add.reduceat(side, head)
            in_a = np.diff(np.append(head, len(h))) - in_b
            both = np.bincount(row[head], np.minimum(in_a, in_b), n)
            union = np.bincount(row[head], np.maximum(in_a, in_b), n)
            keep[i:j] = (both >= least * union - 1e-9) & ((union > 0) | (np.bincount(row, minlength=n) == 0))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], names=["a", "b"])


def texts_of(texts: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """``fetch`` for a table ``(item, text)``."""
    return lambda need: texts.join(small_hint(need, need.count(), BROADCAST_ROWS), "item")


def similar_pairs(pairs: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, least: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose texts are similar.  ``fetch`` adds ``text`` to a
    table of items.  An item with many partners is salted: its text travels once
    per ``PER_SALT`` pairs."""
    need = write_table(pairs.select(F.col("a").alias("item")).unionByName(pairs.select(F.col("b").alias("item")))
                       .groupBy("item").agg(F.count(F.lit(1)).alias("n")), "need")
    held = write_table(fetch(need).select("item", "n", "text"), "held")
    salts = F.ceil(F.col("n") / PER_SALT).cast("int")
    many = need.filter(F.col("n") > PER_SALT).select(F.col("item").alias("a"), salts.alias("salts"))
    left = (pairs.join(small_hint(many, many.count(), BROADCAST_ROWS), "a", "left")
            .withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int")))
    text_a = held.select(F.col("item").alias("a"), F.col("text").alias("text_a"),
                         F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)).alias("salt"))
    text_b = held.select(F.col("item").alias("b"), F.col("text").alias("text_b"))
    met = left.select("a", "b", "salt").join(text_a, ["a", "salt"]).join(text_b, "b")
    return (met.select("a", "b", "text_a", "text_b")
            .mapInArrow(lambda it: overlap(it, width, least), "a long, b long").distinct())


def verified_links(buckets: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, least: float) -> DataFrame:
    """``bucket_links`` with the Jaccard similarity of the items' texts, refined by
    ``prefix_elements``."""
    return verified_classes(buckets, fetch, width, least)[0]


def verified_classes(buckets: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, least: float,
                     sketch: tuple[list[str], Callable | None, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """The links of ``verified_links`` and their components; ``sketch`` as for ``bucket_links``."""
    return bucket_classes(buckets, lambda pairs: similar_pairs(pairs, fetch, width, least),
                          lambda items: prefix_elements(items, fetch, width, least), least, sketch)


def _elements(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """``(item, element, size)``: a shingle's k-th occurrence in a text is one element."""
    for batch in batches:
        ids = batch.column("item").to_numpy(zero_copy_only=False)
        _, off = utf8(batch.column("text"))
        for i, j in steps(off):
            data, o = utf8(batch.column("text").slice(i, j - i))
            h, row = shingles(*word_hashes(data, o), j - i, width)
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            head = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[:len(h)]
            nth = np.arange(len(h)) - np.maximum.accumulate(np.where(head, np.arange(len(h)), 0)) if len(h) else h
            element = mix64(h + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            size = np.bincount(row, minlength=j - i)
            yield pa.RecordBatch.from_arrays([pa.array(ids[i + row]), pa.array(element), pa.array(size[row])],
                                             names=["item", "element", "size"])


def prefix_elements(items: DataFrame, fetch: Callable[[DataFrame], DataFrame], width: int, least: float) -> DataFrame:
    """``(bucket, item, size, place, rare, lead, s0, ...)``: an exact cover of the
    similar pairs among ``items(item)``.

    Order all elements by how many of the items have them, the rarest first.  If two
    multisets have a Jaccard similarity of ``least``, one of the first ``size -
    ceil(2 least / (1 + least) size) + 1`` elements of the smaller one (its ``lead``
    rows) is one of the first ``size - ceil(least size) + 1`` elements of the larger
    (prefix filter).  Items that share a common passage only have other, rarer
    elements first and do not meet.  ``place`` is the element's place in the item's
    order, ``rare`` the number of elements that no other item has.  The sketch ``s0,
    ...`` has one bit per hash value, the parity of the item's elements there."""
    texts = fetch(items.select("item", F.lit(1).cast("long").alias("n")))
    every = write_table(texts.select("item", "text").mapInArrow(
        lambda it: _elements(it, width), "item long, element long, size long"), "elements")
    shared = every.groupBy("element").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    per = Window.partitionBy("item")                        # a text's own elements
    rare = F.col("size") - F.count(F.lit(1)).over(per)

    def prefix(share: float):
        return F.col("size") - F.ceil(F.lit(share) * F.col("size") - F.lit(1e-9)) + 1

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("element").bitwiseAND(F.lit(63)).cast("int"))
    word = F.pmod(F.shiftright("element", 6), F.lit(len(SKETCH)))
    parity = every.groupBy("item").agg(*[
        F.bit_xor(F.when(word == i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(SKETCH)])
    return (every.join(shared, "element").withColumn("rare", rare)
            .withColumn("place", F.col("rare") + F.row_number().over(per.orderBy("n", "element")))
            .filter(F.col("place") <= prefix(least))
            .select(F.col("element").alias("bucket"), "item", "size", "place", "rare",
                    (F.col("place") <= prefix(2 * least / (1 + least))).alias("lead")).join(parity, "item"))


def _ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with their ``turn`` to lead in their bucket: those with the fewest elements of their own first, as
    what others were made from connects most.  Buckets only leave whole, so a turn holds for all rounds."""
    return rows.withColumn("turn", F.row_number().over(
        Window.partitionBy("bucket").orderBy(F.desc("lead"), "rare", "item")))


def _open(rows: DataFrame, label: DataFrame) -> DataFrame:
    """``rows`` with their component as ``label``, of the buckets that hold two
    components and a row that may lead."""
    known = rows.drop("label").join(small_hint(label, label.count(), BROADCAST_ROWS), "item", "left").withColumn(
        "label", F.coalesce("label", "item"))
    per = Window.partitionBy("bucket")
    mixed = known.withColumns({"_x": F.min("label").over(per), "_y": F.max("label").over(per), "_z": F.max("lead").over(per)})
    return write_table(mixed.filter("_x != _y and _z").drop("_x", "_y", "_z"), "open")


def _between(rows: DataFrame, heads: DataFrame, tested: DataFrame, least: float,
             sketch: tuple[list[str], Callable | None, Callable] | None = None) -> DataFrame:
    """The untested pairs of a leader and an item of another component that is not
    smaller, without those that cannot be similar: what two items have in common
    from a shared element on is at most one more than what either has left (their
    first shared element always passes), and they differ in at least as many
    elements as their sketches do in bits.  A caller's ``sketch`` says more."""
    names, _, may_be = sketch or ([], None, lambda: F.lit(True))
    lead = heads.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("item", "label", "size", "place", *SKETCH, *names)])
    both = F.col("size") + F.col("_size")
    common = F.least(F.col("size") - F.col("place"), F.col("_size") - F.col("_place")) + 1
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in SKETCH), F.lit(0))
    met = (rows.join(lead, "bucket")
           .filter((F.col("label") != F.col("_label")) & (F.col("size") >= F.col("_size"))
                   & (common >= F.lit(least / (1 + least)) * both - F.lit(1e-9))
                   & (differ <= F.lit((1 - least) / (1 + least)) * both + F.lit(1e-9)) & may_be())
           .select(F.least("item", "_item").alias("a"), F.greatest("item", "_item").alias("b")).distinct())
    return write_table(met.join(tested, ["a", "b"], "left_anti"), "pairs")


def bucket_links(buckets: DataFrame, alike: Callable[[DataFrame], DataFrame],
                 refine: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.0,
                 sketch: tuple[list[str], Callable | None, Callable] | None = None) -> DataFrame:
    """``(a, b)`` links between similar items that share a bucket, enough of them to
    connect every component; ``buckets(bucket, item)``; ``alike`` keeps the similar
    rows of ``(a, b)``; ``refine`` gives the rows of ``prefix_elements`` for the items
    that it is given.  ``sketch`` names columns, adds them to the rows of buckets with more
    than one item (None: ``buckets`` has them), and gives a condition on them and on the other item's (``_`` before
    the name) that all similar pairs meet; pairs that do not meet it are never written."""
    return bucket_classes(buckets, alike, refine, least, sketch)[0]


def bucket_classes(buckets: DataFrame, alike: Callable[[DataFrame], DataFrame],
                   refine: Callable[[DataFrame], DataFrame] | None = None, least: float = 0.0,
                   sketch: tuple[list[str], Callable | None, Callable] | None = None) -> tuple[DataFrame, DataFrame]:
    """The links of ``bucket_links`` and their components, as ``components`` gives them."""
    own = sketch[0] if sketch else []
    there = [c for c in own if c in buckets.columns]
    per = Window.partitionBy("bucket")          # the rows move once
    low = buckets.withColumns({"_low": F.min(F.struct("item", *there)).over(per), "_high": F.max("item").over(per)})
    rows = write_table(low.filter("_low.item != _high").select(
        *buckets.columns, F.col("_low.item").alias("a"), *[F.col(f"_low.{c}").alias(f"_{c}") for c in there])
        .dropDuplicates(["bucket", "item"]), "buckets")
    if sketch and sketch[1]:
        rows = write_table(sketch[1](rows), "sketched")
    first = rows.filter("a != item")
    if sketch:
        heads = rows.filter("a = item").select("bucket", *[F.col(c).alias(f"_{c}") for c in own if c not in there])
        first = (first if len(there) == len(own) else first.join(heads, "bucket")).filter(sketch[2]())
    tested = write_table(first.select("a", F.col("item").alias("b")).distinct(), "pairs")
    links = write_table(alike(tested), "verified")
    label = components(links)
    zero = F.lit(0).cast("long")
    rows = _open(rows.filter("a != item").select(
        "bucket", "item", *own, *[zero.alias(c) for c in ("size", "place", "rare", *SKETCH)], F.lit(True).alias("lead")), label)
    if refine is not None and rows.limit(1).count():
        rows, sketch = _open(refine(write_table(rows.select("item").distinct(), "crowd")), label), None
    if not rows.limit(1).count():
        return links, label
    rows = _ranked(rows)
    for last in (FIRST_LEADERS * MORE_LEADERS ** k for k in count()):
        # Every round has many more leaders than all before it, so that the rows of a bucket are read in a few rounds,
        # however many they are.
        pairs = _between(rows, rows.filter(F.col("lead") & (F.col("turn") <= last)), tested, least, sketch)
        if pairs.limit(1).count():
            found = write_table(alike(pairs), "verified")
            tested = tested.unionByName(pairs)
            if found.limit(1).count():
                links = links.unionByName(found)
                label = merged(label, found)
        rows = _open(rows.withColumn("lead", F.col("lead") & (F.col("turn") > last)), label)
        if not rows.limit(1).count():
            return links, label
