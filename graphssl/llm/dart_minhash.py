"""MinHash near-duplicates with DartMinHash signatures.

A document is the weighted set of its five-word shingles (weight: how often).
Every shingle owns a region of the plane, its weight wide; hashed darts fall on
it as a Poisson process of rate one, the same ones in every document that has
the region.  A dart has a coordinate of the signature and a height; the lowest
dart of each coordinate is the signature.  Two documents agree in a coordinate
with a probability equal to their weighted Jaccard similarity.

Darts are thrown in order of height, only below a bound at which each coordinate
is expected to hold ``ln k + 3`` darts, so a document costs its length plus about
``k (ln k + 3)`` darts.  A document with an empty coordinate gets twice the bound.

Signatures are banded; documents that share a band are compared exactly
(``similar.verified_classes``), and classes are the components of the links.
Equal texts are one item from the start.

Defined results: null text counts as empty; texts without words are similar to
each other only if equal; a text of one to four words is one shingle; rows without
doc_id or with a shared one are documents of their own, told apart by a row number
(null first; rows that share one, by the digest of their text); a class is
named by the doc_id of its first row, null if that row has none, and ``class_key``
tells such classes apart; an empty table gives an empty table; other columns never matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphssl.llm.common import mix64, numbered, release, shingles, steps, utf8, word_hashes
from graphssl.llm.similar import BROADCAST_ROWS, merged, texts_of, verified_classes
from graphssl.operators.sizing import small_hint
from graphssl.session import write_table

#: Words per shingle and similarity from which documents are near-duplicates.
WIDTH, LEAST = 5, 0.8
#: Bands and rows per band: a pair at 0.8 shares a band with probability 0.9995.
BANDS, ROWS = 25, 6

_STEP = np.uint64(0x9E3779B97F4A7C15)


def dart_signatures(hashes: np.ndarray, weights: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """``(n_rows, k)`` signature of weighted sets: element ``hashes[i]`` of set
    ``row[i]`` weighs ``weights[i]``; all zero for an empty set."""
    sig = np.zeros((n_rows, k), np.uint64)
    total = np.bincount(row, weights, n_rows)
    todo = total > 0
    bound = np.where(todo, k * (math.log(k) + 3) / np.where(todo, total, 1), 0.0)
    while todo.any():
        mine = todo[row]
        h, w, r = hashes[mine], weights[mine], row[mine]
        slots = np.ceil(w).astype(np.int64)
        at = np.repeat(np.arange(len(h)), slots)
        unit = np.arange(len(at)) - np.repeat(np.cumsum(slots) - slots, slots)   # unit-wide part of the region
        key = mix64(h[at] + (unit.astype(np.uint64) + np.uint64(1)) * _STEP)
        wide, r = w[at] - unit, r[at]
        height = np.zeros(len(key))
        cells, heights, darts = [], [], []
        while len(key):
            key = mix64(key + _STEP)
            height = height - np.log(((key >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
            low = height < bound[r]
            key, height, wide, r = key[low], height[low], wide[low], r[low]
            dart = mix64(key ^ np.uint64(0xD6E8FEB86659FD93))
            hit = (dart >> np.uint64(40)).astype(np.float64) * 2.0 ** -24 < wide
            cells.append(r[hit] * k + (dart[hit] % np.uint64(k)).astype(np.int64))
            heights.append(height[hit])
            darts.append(dart[hit] | np.uint64(1))
        cell, dart = np.concatenate(cells), np.concatenate(darts)
        order = np.argsort(-np.concatenate(heights), kind="stable")
        sig[np.flatnonzero(todo)] = 0
        sig.reshape(-1)[cell[order]] = dart[order]          # the lowest dart is written last
        todo &= (sig == 0).any(axis=1)
        bound[todo] *= 2
    return sig


def weighted_shingles(data: np.ndarray, offsets: np.ndarray, width: int):
    """``(hash, weight, row)``: the distinct shingles of every row with their counts."""
    h, row = word_hashes(data, offsets)
    h, row = shingles(h, row, len(offsets) - 1, width)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if not len(h):
        return h, np.zeros(0), row
    head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])]))
    return h[head], np.diff(np.append(head, len(h))).astype(float), row[head]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``(n, bands)`` keys; a band's key depends on the band and all its rows."""
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * _STEP + sig[:, b * rows + r])
        out[:, b] = key
    return out.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch], width: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        _, off = utf8(batch.column("text"))
        for i, j in steps(off):
            part = batch.slice(i, j - i)
            data, o = utf8(part.column("text"))
            h, w, row = weighted_shingles(data, o, width)
            sig = dart_signatures(h, w, row, j - i, bands * rows)
            keys = list(band_keys(sig, bands, rows))
            some = sig.any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc"), part.column("text_key"),
                 pa.array([x if s else [] for x, s in zip(keys, some)], pa.list_(pa.int64()))],
                names=["doc", "text_key", "bands"])


def near_duplicates(docs: DataFrame, width: int = WIDTH, least: float = LEAST,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, kept, class_key``
    (class_id: the doc_id of the class's first row; class_key: its row number)."""
    return _classes(numbered(docs), width, least, bands, rows).select(
        "doc_id", "class_id", "class_size", "kept", "class_key")


def _classes(rows_of: tuple[DataFrame, bool], width: int = WIDTH, least: float = LEAST,
             bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc, doc_id, class_key, class_id, class_size, kept`` of rows as :func:`numbered` gives them."""
    texts, plain = rows_of
    banded = write_table(
        texts.select("doc", "text").withColumn("text_key", F.unhex(F.md5("text")))
        .mapInArrow(lambda it: _banded(it, width, bands, rows), "doc long, text_key binary, bands array<long>"),
        "banded")
    # Equal texts are one item: the smallest row.
    copies = (banded.groupBy("text_key").agg(F.min("doc").alias("item"), F.max("doc").alias("high"))
              .filter("item != high"))
    copies = write_table(copies, "copies")
    known = banded.join(small_hint(copies.select("text_key", "item"), copies.count(), BROADCAST_ROWS), "text_key", "left")
    shared = write_table(known.filter("item is not null and item != doc").select(
        F.col("item").alias("a"), F.col("doc").alias("b")), "shared")
    buckets = (known.filter("item is null or item = doc")
               .select(F.col("doc").alias("item"), F.explode("bands").alias("bucket")))
    _, label = verified_classes(buckets, texts_of(texts.select(F.col("doc").alias("item"), "text")), width, least)
    label = merged(label, shared)
    out = banded.select("doc").join(
        small_hint(label, label.count(), BROADCAST_ROWS).withColumnRenamed("item", "doc"), "doc", "left")
    out = write_table(out.select("doc", F.coalesce("label", "doc").alias("class_key")), "classes")
    size = out.groupBy("class_key").agg(F.count(F.lit(1)).alias("class_size")).filter("class_size > 1")
    size = write_table(size, "sizes")
    out = out.join(small_hint(size, size.count(), BROADCAST_ROWS), "class_key", "left").select(
        "doc", "class_key", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        (F.col("doc") == F.col("class_key")).alias("kept"))
    if plain:
        return out.select(F.col("doc"), F.col("doc").alias("doc_id"), "class_key", F.col("class_key").alias("class_id"),
                          "class_size", "kept")
    # Names of the classes of several rows; any other row names its own.
    ids = texts.select("doc", "doc_id")
    first = write_table(ids.join(out.filter("kept and class_size > 1").select("doc"), "doc").select(
        F.col("doc").alias("class_key"), F.col("doc_id").alias("class_id")), "first")
    named = out.join(ids, "doc").join(small_hint(first, first.count(), BROADCAST_ROWS), "class_key", "left")
    return named.select("doc", "doc_id", "class_key",
                        F.when(F.col("kept"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                        "class_size", "kept")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that represent their class, with their columns as they are."""
    rows_of = numbered(docs)
    gone = _classes(rows_of, **how).filter("not kept")
    if rows_of[1]:
        gone = write_table(gone.select(F.col("doc").alias("_gone")), "gone")
        return docs.join(small_hint(gone, gone.count(), BROADCAST_ROWS),
                         docs["doc_id"].cast("long") == gone["_gone"], "left_anti")
    # Rows are not told apart by doc_id: of each (doc_id, text) as many go as the classes lose.
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    lost = write_table(gone.select("doc").join(rows_of[0], "doc").groupBy(
        F.col("doc_id").alias("_id"), digest.alias("_text")).agg(F.count(F.lit(1)).alias("_lost")), "gone")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), digest.alias("key"))
    met = packed.join(small_hint(lost, lost.count(), BROADCAST_ROWS // 4),
                      F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_text")), "left")
    alone = met.filter("_lost is null").select("row.*")
    # Equal texts are of one class, so at most one row of a (doc_id, text) stays: the one
    # with the smallest content.
    had = met.filter("_lost is not null").groupBy("id", "key").agg(
        F.count(F.lit(1)).alias("n"), F.max("_lost").alias("lost"),
        F.min_by("row", F.md5(F.to_json("row").cast("binary"))).alias("row"))
    return alone.unionByName(had.filter("n > lost").select("row.*"))
