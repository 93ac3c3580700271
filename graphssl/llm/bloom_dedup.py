"""Exact duplicates by two passes over a Bloom filter.

Pass 1 builds a blocked Bloom filter of two planes: the bits that some row has
set, and the bits that at least two rows have set.  Every row sets four bits in
one 64-bit word.  Partial planes are merged per task first, so a group of copies
leaves a task as one entry.  In pass 2 a row whose four bits all stand in the
second plane may be repeated; only those rows shuffle, on their SHA-256, and are
counted exactly.  Every other row is provably unique and passes straight through.

The filter has 16 to 32 bits a row at every input size.  Only its second plane
is joined, by broadcast if its measured row count is within ``BROADCAST_ROWS``,
else by a shuffle join on the word.

Defined results: null text counts as empty; empty texts are equal to each other;
texts that differ only in runs of ``[\\x20\\x09-\\x0D]`` are equal; a null doc_id
sorts first; of rows with equal text *and* equal doc_id exactly one is kept; an
empty table gives an empty table; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphssl.operators.sizing import small_hint
from graphssl.session import write_table

#: Fixed value: the white-space class of the contract (a run becomes one space).
WHITE_SPACE = r"[\x20\x09-\x0D]+"
#: Rows per word of the filter, before rounding the words up to a power of two.
ROWS_PER_WORD = 4
#: Words whose entries travel together between the partial and the final merge.
CHUNK = 1 << 14
#: Rows of 16 bytes that the second plane may have to be broadcast.
BROADCAST_ROWS = 4_000_000
#: Rows of a doc_id and a digest that may be broadcast.
DIGEST_ROWS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def digests(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_sha256)`` of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))


def _bits(key: Column, n_words: int) -> tuple[Column, Column]:
    """Word and four-bit mask of a row."""
    h = F.xxhash64(key, F.lit(1))
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.xxhash64(key), F.lit(n_words).cast("long")), mask


def merge_planes(word: np.ndarray, seen: np.ndarray, twice: np.ndarray):
    """One entry per word: bits seen at all, bits seen at least twice."""
    order = np.argsort(word, kind="stable")
    word, seen, twice = word[order], seen[order], twice[order]
    while len(word) > 1:
        same = np.flatnonzero(word[1:] == word[:-1])
        if not len(same):
            break
        head = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        place = np.arange(len(word)) - np.repeat(head, np.diff(np.append(head, len(word))))
        left = np.flatnonzero((place % 2 == 0) & np.append(word[1:] == word[:-1], False))
        right = left + 1
        twice[left] |= twice[right] | (seen[left] & seen[right])
        seen[left] |= seen[right]
        keep = np.ones(len(word), bool)
        keep[right] = False
        word, seen, twice = word[keep], seen[keep], twice[keep]
    return word, seen, twice


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = None
    for b in batches:
        word = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        mask = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = (word, mask, np.zeros_like(mask))
        held = merge_planes(*(np.concatenate(x) for x in zip(held, new))) if held else merge_planes(*new)
        if len(held[0]) > 1 << 20:      # bounded memory: what was merged so far leaves the task
            yield from _packed(held)
            held = None
    if held:
        yield from _packed(held)


def _packed(planes) -> Iterator[pa.RecordBatch]:
    word, seen, twice = planes
    cut = np.flatnonzero(np.diff(word // CHUNK)) + 1
    for w, s, t in zip(*(np.split(x, cut) for x in (word, seen, twice))):
        if len(w):
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([int(w[0]) // CHUNK], pa.int64()),
                "planes": pa.array([np.stack([w, s, t]).tobytes()], pa.binary())})


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    held = None
    for raw in pdf["planes"]:
        new = tuple(np.frombuffer(raw, np.int64).reshape(3, -1).copy())
        held = merge_planes(*(np.concatenate(x) for x in zip(held, new))) if held else new
    word, _, twice = held
    return pd.DataFrame({"word": word[twice != 0], "twice": twice[twice != 0]})


def repeated_bits(keys: DataFrame, key: str, n_words: int) -> DataFrame:
    """Pass 1: ``(word, twice)``, the filter's second plane without its zero words."""
    word, mask = _bits(F.col(key), n_words)
    return (keys.select(word.alias("word"), mask.alias("mask"))
            .mapInArrow(_partial, "chunk long, planes binary")
            .groupBy("chunk").applyInPandas(_merged, "word long, twice long"))


def split_by_filter(keys: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Pass 2: ``keys`` with ``maybe_repeated`` (false: provably unique)."""
    n_words = 1 << max(10, (n_rows // ROWS_PER_WORD).bit_length())
    plane = write_table(repeated_bits(keys, key, n_words), "bloom")
    if plane.count() <= BROADCAST_ROWS:
        plane = F.broadcast(plane)
    word, mask = _bits(F.col(key), n_words)
    return (keys.withColumn("_word", word).withColumn("_mask", mask)
            .join(plane.withColumnRenamed("word", "_word").withColumnRenamed("twice", "_twice"), "_word", "left")
            .withColumn("maybe_repeated", F.coalesce(F.col("_twice"), F.lit(0).cast("long"))
                        .bitwiseAND(F.col("_mask")) == F.col("_mask"))
            .drop("_word", "_mask", "_twice"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    keys = write_table(digests(docs), "digests")
    split = split_by_filter(keys, "text_sha256", keys.count())
    alone = split.filter(~F.col("maybe_repeated")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    rows = write_table(split.filter("maybe_repeated").select("doc_id", "text_sha256"), "maybe_repeated")
    # First per (text, doc_id), then per text; both sums start inside the map tasks.
    same = rows.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("f"), F.col("doc_id").alias("d"), F.col("n").alias("n")))
    groups = (same.groupBy("text_sha256").agg(first.alias("m"), F.sum("n").alias("group_size"))
              .select("text_sha256", F.col("m.d").alias("keep_id"), F.col("m.n").alias("_ties"), "group_size"))
    groups = write_table(groups, "groups")
    met = (rows.join(small_hint(groups, groups.count(), BROADCAST_ROWS // 8), "text_sha256")
           .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))))
    # Rows that share text and doc_id with the kept one: the first of them stays.
    tied = (met.filter("kept and _ties > 1").withColumn("kept", F.row_number().over(
        Window.partitionBy("text_sha256").orderBy("group_size")) == 1))
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return (alone.select(cols).unionByName(met.filter("not kept or _ties = 1").select(cols))
            .unionByName(tied.select(cols)))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are.

    Rows travel only where a doc_id and a text stand in several rows (the one with
    the smallest content stays).  The others meet the digests of the rows that go, a
    table of few columns, broadcast while it is small."""
    found = (exact_duplicates(docs).groupBy("doc_id", "text_sha256")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("long")).alias("kept"))
             .filter("n > kept"))
    gone = write_table(found.select(F.col("doc_id").alias("_id"), F.unhex("text_sha256").alias("_key"),
                                    (F.col("kept") > 0).alias("_one")), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"),
                         F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("key"))
    met = packed.join(small_hint(gone, gone.count(), DIGEST_ROWS),
                      F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    one = (met.filter("_one").groupBy("id", "key")
           .agg(F.min_by("row", F.md5(F.to_json("row").cast("binary"))).alias("row")))
    return met.filter("_one is null").select("row.*").unionByName(one.select("row.*"))
