"""Substring dedup by MinHash banding of paragraphs.

A paragraph is a line with a word, or a sentence of eight words or more of a line that has more than that
sentence (a sentence ends after ``.``, ``!`` or ``?`` before white space, or with its line), so that
passages set into longer lines are found.  Its MinHash signature over five-word shingles is
banded; ``tuned`` picks the bands so that a pair at the threshold shares one with
probability ``RECALL`` or more.  A paragraph of so few shingles that only equal shingles
reach the threshold has one band, a hash of them all; a line of fewer than five words
is one shingle, so that it is like equal lines only.  Paragraphs that share a band are
compared exactly (Jaccard similarity of their shingles), and the links'
components are clusters.  Of a cluster the first paragraph (smallest doc_id, then
place) stays.  Other lines are removed from their documents; other sentences are where a
run of repeated paragraphs has ``RUN_WORDS`` words (a single repeated sentence is no copied passage).

A first pass over the texts packs all keys into eight bytes each and finds those that several paragraphs
have; a second pass writes the paragraphs that have one of these, and nothing of the others.

Equal paragraphs (same words) are one item from the start, so a line that many
documents share never forms pairs.

Defined results: null text counts as empty; lines end at ``\\n``; lines without
words are never removed; rows that share a doc_id are documents of their own, by the digest
of their text; a null doc_id sorts first; an empty table gives an empty table; other columns never matter; texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphssl.llm.common import mix64, numbered, shingles, steps, utf8, word_hashes
from graphssl.llm.similar import BROADCAST_ROWS, verified_classes
from graphssl.operators.sizing import small_hint
from graphssl.session import discard, write_table

#: Words per shingle, similarity of near-duplicates, recall at that similarity.
WIDTH, LEAST, RECALL = 5, 0.8, 0.995
#: Removed lines of so many words are counted as paragraphs, shorter ones apart.
LONG_WORDS = 20
#: Words of a sentence that is a paragraph of its own, and of a run of repeated ones that goes.
SENTENCE_WORDS, RUN_WORDS = 8, 30
#: Bands that a paragraph may have at most.
MOST_BANDS = 8
#: Codes that a task packs together, documents per chunk of codes.
PACKED_CODES, CHUNK_DOCS = 2_000_000, 20_000
#: Codes per row of the filter, its words (16 bits a code), and codes whose filter may be broadcast (2 bytes each).
ROW_CODES, ROW_WORDS, FILTER_CODES = 4096, 1024, 40_000_000

#: Rows of items, or clusters, that may be broadcast (the driver holds each such table; a quarter where a
#: row has lists).
ITEM_ROWS = 100_000

#: Words of 64 bits of a unit's parities.
PARITY = ["p0", "p1"]

_STOP = np.isin(np.arange(256), list(b".!?"))


def tuned(least: float = LEAST, recall: float = RECALL, most: int = MOST_BANDS) -> tuple[int, int]:
    """``(bands, rows)``: the most selective banding (most rows) with at most ``most``
    bands in which a pair at ``least`` shares a band with probability ``recall``."""
    best = (1, 1)
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - least ** rows))) if least < 1 else 1
        if bands <= most:
            best = (bands, rows)
    return best


def minhash(hashes: np.ndarray, row: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """``(n_rows, k)`` smallest hash of each row under ``k`` hash functions; ``row`` ascends
    and holds every row."""
    head = np.searchsorted(row, np.arange(n_rows))
    out = np.zeros((n_rows, k), np.uint64)
    x, y = np.empty_like(hashes), np.empty_like(hashes)
    for j in range(k):
        np.bitwise_xor(hashes, np.uint64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)), out=x)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):     # mix64 without copies
            np.right_shift(x, np.uint64(shift), out=y)
            np.bitwise_xor(x, y, out=x)
            if factor:
                np.multiply(x, np.uint64(factor), out=x)
        out[:, j] = np.minimum.reduceat(x, head)
    return out


def _signed(h: np.ndarray, unit: np.ndarray, n: int, bands: int, rows: int, parities: bool) -> tuple[np.ndarray | None, ...]:
    """Per unit of words: 16-byte key, band keys, number of bands, parities of its shingles (if asked for); ``unit`` ascends and holds every unit."""
    n_words = np.bincount(unit, minlength=n)
    s, of = shingles(h, unit, n, WIDTH)
    sig = minhash(s, of, n, bands * rows)
    keys = np.zeros((n, bands), np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r])
        keys[:, b] = key
    n_shingles = np.bincount(of, minlength=n)
    whole = np.add.reduceat(mix64(s), np.searchsorted(of, np.arange(n)))
    few = n_shingles < (LEAST - 1e-9) * (n_shingles + 1)
    keys[few, 0] = whole[few]
    at = np.searchsorted(unit, np.arange(n + 1))
    key = np.frombuffer(b"".join(hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest()
                                 for a, b in zip(at, at[1:])), np.uint64).reshape(n, 2)
    shared = np.where(n_words < WIDTH, 0, np.where(few, 1, bands))              # equal short lines are one item
    return key, keys, shared, _parity(s, of, n) if parities else None


def _parity(s: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """``(n, len(PARITY))`` words with a bit per hash value: the parity of a unit's shingles there."""
    place = (mix64(s + np.uint64(1)) % np.uint64(64 * len(PARITY))).astype(np.int64)
    odd = np.bincount(of * 64 * len(PARITY) + place, minlength=n * 64 * len(PARITY)) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, -1), axis=1).view(np.int64)


def _may_be_alike():
    """What all pairs of units of a similarity of ``LEAST`` meet: they differ in few shingles, hence in no more bits
    of their parities."""
    size, other = (F.greatest(F.col(c) - F.lit(WIDTH - 1), F.lit(1)) for c in ("words", "_words"))
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"_{c}"))) for c in PARITY), F.lit(0))
    return ((differ <= F.lit((1 - LEAST) / (1 + LEAST)) * (size + other) + F.lit(1e-6))
            & (F.least(size, other) >= F.lit(LEAST) * F.greatest(size, other) - F.lit(1e-6)))


def _units(batches: Iterator[pa.RecordBatch], bands: int, rows: int, parities: bool = False) -> Iterator[tuple]:
    """``(doc, begin, end, words, whole, key, band keys, bands, parities)`` arrays: the lines of some rows,
    then the sentences of lines that have several."""
    for batch in batches:
        ids = batch.column("doc").to_numpy(zero_copy_only=False)
        _, off = utf8(batch.column("text"))
        for i, j in steps(off):
            data, o = utf8(batch.column("text").slice(i, j - i))
            ends = np.flatnonzero(data == 10)
            lines = np.unique(np.concatenate([o, ends, ends + 1]))
            white = (data == 32) | ((data >= 9) & (data <= 13))
            stops = np.flatnonzero(_STOP[data[:-1]] & white[1:]) + 1
            cut = np.unique(np.concatenate([lines, stops]))
            h, part = word_hashes(data, cut)
            line_of = np.searchsorted(lines, cut[:-1], "right") - 1
            in_part = np.bincount(part, minlength=len(cut) - 1)
            in_line = np.bincount(line_of[part], minlength=len(lines) - 1)
            for whole, at, count, unit, keep in (
                    (True, lines, in_line, line_of[part], in_line > 0),
                    (False, cut, in_part, part, (in_part >= SENTENCE_WORDS) & (in_part < in_line[line_of]))):
                keep = np.flatnonzero(keep)
                if not len(keep):
                    continue
                new = np.full(len(count), -1)
                new[keep] = np.arange(len(keep))
                mine = new[unit] >= 0
                signed = _signed(h[mine], new[unit[mine]], len(keep), bands, rows, parities)
                row = np.searchsorted(o, at[keep], "right") - 1
                yield (ids[i + row], at[keep] - o[row], at[keep + 1] - o[row], count[keep], whole, *signed)


def _codes(key: np.ndarray, keys: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit codes of all keys of the units, unit by unit (even: the unit's words, odd: a band),
    the unit of each, and where each unit's codes begin."""
    every = np.concatenate([key[:, :1], keys], axis=1)
    there = np.arange(every.shape[1]) <= shared[:, None]
    code = (every >> np.uint64(16)) * np.uint64(2) + (np.arange(every.shape[1]) > 0).astype(np.uint64)
    return code[there], np.repeat(np.arange(len(key)), shared + 1), np.concatenate([[0], np.cumsum(shared + 1)])


def _packed(batches: Iterator[pa.RecordBatch], bands: int, rows: int, bits: int) -> Iterator[pa.RecordBatch]:
    """``(chunk, packed)``: the codes of a task, each with 24 bits of its unit's key, by their first ``bits`` bits
    and kind.  Of equal entries a task sends two for a unit's words, one for a band."""
    held, size = [], 0

    def flush():
        code, tag = (np.concatenate(x) for x in zip(*held))
        low = np.uint64(48 - bits)
        kind = code & np.uint64(1)
        chunk = (code >> np.uint64(1) >> low) * np.uint64(2) + kind
        value = ((code >> np.uint64(1)) & ((np.uint64(1) << low) - np.uint64(1))) << np.uint64(24) | np.where(kind == 1, tag, np.uint64(0))
        order = np.lexsort((value, chunk))
        chunk, value = chunk[order], value[order]
        same = np.concatenate([[False], (chunk[1:] == chunk[:-1]) & (value[1:] == value[:-1])])
        third = same & np.concatenate([[False], same[:-1]])
        keep = ~np.where(chunk & np.uint64(1) == 1, same, third)
        chunk, value = chunk[keep], value[keep]
        head = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(chunk[head].astype(np.int64)), pa.array(
            [value[a:b].tobytes() for a, b in zip(head, np.append(head[1:], len(value)))], pa.binary())], names=["chunk", "packed"])

    for *_, key, keys, shared, _ in _units(batches, bands, rows):
        code, unit, _ = _codes(key, keys, shared)
        held.append((code, key[unit, 1] & np.uint64((1 << 24) - 1)))
        size += len(code)
        if size >= PACKED_CODES:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _twice(bits: int):
    def of(chunk: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind = int(chunk[0]) & 1
        value = np.sort(np.frombuffer(b"".join(pdf["packed"]), np.uint64))
        if kind:                    # a band counts once per key
            value = value[np.concatenate([[True], value[1:] != value[:-1]])]
        low = value >> np.uint64(24)
        code = np.unique(low[1:][low[1:] == low[:-1]])
        code = (np.uint64((int(chunk[0]) >> 1) << (48 - bits)) + code) * np.uint64(2) + np.uint64(kind)
        return pd.DataFrame({"code": code.astype(np.int64)})
    return of


def repeated_codes(texts: DataFrame, bands: int, rows: int) -> DataFrame:
    """``(code)`` of the words that several units have, and of the bands that units of different words share.

    Only packed codes move, eight bytes each; a code with many units leaves a task as two entries at most."""
    bits = max(8, math.ceil(math.log2(max(1, texts.count()) / CHUNK_DOCS + 1)))
    packed = texts.select("doc", "text").mapInArrow(lambda it: _packed(it, bands, rows, bits), "chunk long, packed binary")
    return write_table(packed.groupBy("chunk").applyInPandas(_twice(bits), "code long"), "codes")


def _filter_row(row: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The words of one row of the filter: each code sets four bits of one word."""
    words = np.zeros(ROW_WORDS, np.int64)
    np.bitwise_or.at(words, pdf["word"].to_numpy(), pdf["mask"].to_numpy())
    return pd.DataFrame({"row": [int(row[0])], "bits": [words]})


def with_repeated(units: DataFrame, codes: DataFrame) -> DataFrame:
    """The rows of ``units(..., code)`` whose code is in ``codes``.  Up to ``FILTER_CODES`` of them go as a Bloom filter,
    which lets a few others pass; more are joined."""
    n = codes.count()
    if n > FILTER_CODES:
        return units.join(codes, "code", "left_semi")
    n_rows = 1 << max(0, (n // ROW_CODES).bit_length())
    h = F.xxhash64("code")
    mask = F.lit(0).cast("long")
    for k in range(4):
        bit = F.shiftrightunsigned(h, 40 + 6 * k).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    word = h.bitwiseAND(F.lit(ROW_WORDS - 1)).cast("int")
    row = F.shiftrightunsigned(h, 10).bitwiseAND(F.lit(n_rows - 1)).cast("int")
    rows = write_table(codes.select(row.alias("row"), word.alias("word"), mask.alias("mask"))
                       .groupBy("row").applyInPandas(_filter_row, "row int, bits array<long>"), "filter")
    met = units.join(F.broadcast(rows.toDF("_row", "_bits")), row == F.col("_row"))
    return met.filter(F.get("_bits", word).bitwiseAND(mask) == mask).drop("_row", "_bits")


def _lines(batches: Iterator[pa.RecordBatch], bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    for doc, begin, end, words, whole, key, keys, shared, parity in _units(batches, bands, rows, True):
        code, _, at = _codes(key, keys, shared)
        yield pa.RecordBatch.from_arrays([
            pa.array(doc), pa.array(begin), pa.array(end - begin), pa.array(words.astype(np.int64)),
            pa.array(np.full(len(doc), whole)), pa.array([k.tobytes() for k in key], pa.binary()),
            *[pa.array(np.ascontiguousarray(c)) for c in parity.T],
            pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(code.astype(np.int64)))], names=[*UNIT, *PARITY, "codes"])


UNIT = ["doc", "begin", "size", "words", "whole", "line_key"]


def repeated_paragraphs(docs: DataFrame, rows_of: tuple[DataFrame, bool] | None = None) -> DataFrame:
    """``(doc, begin, size, words, whole, first_doc_id)`` of every line (``whole``) and sentence that repeats an
    earlier one, in bytes of the text of row ``doc`` (see :func:`numbered`), with the document of the first."""
    bands, rows = tuned()
    texts, plain = rows_of or numbered(docs)
    codes = repeated_codes(texts, bands, rows)
    units = texts.select("doc", "text").mapInArrow(
        lambda it: _lines(it, bands, rows),
        f"doc long, begin long, size long, words long, whole boolean, line_key binary, {' long, '.join(PARITY)} long, codes array<long>")
    hits = with_repeated(units.select(*UNIT, *PARITY, F.posexplode("codes").alias("nth", "code")), codes)
    # the first code is of the words, the others of the bands; they and the parities follow from the words
    lines = write_table(hits.groupBy(UNIT).agg(*[F.max(F.when(F.col("nth") == k + 1, F.col("code"))).alias(f"band{k}")
                                                for k in range(bands)], *[F.max(c).alias(c) for c in PARITY]), "lines")
    discard(codes)
    place = F.struct("doc", "begin", (-F.col("size")).alias("less"))       # a line before its first sentence
    every = [f"band{k}" for k in range(bands)]
    said = ["words", *PARITY]
    items = write_table(lines.groupBy("line_key").agg(F.min(place).alias("f"), *[F.max(c).alias(c) for c in (*every, *said)])
                        .select("line_key", F.monotonically_increasing_id().alias("item"), F.col("f.doc").alias("doc"),
                                F.col("f.begin").alias("begin"), (-F.col("f.less")).alias("size"), *every, *said), "items")
    item_of = small_hint(items.select("line_key", "item"), items.count(), ITEM_ROWS)
    buckets = items.select("item", *said, F.explode(F.array(*every)).alias("bucket")).filter("bucket is not null")
    place_of = items.select("item", "doc", "begin", "size")

    def fetch(need: DataFrame) -> DataFrame:
        n = need.count()
        at = write_table(place_of.join(small_hint(need, n, ITEM_ROWS), "item"), "at")
        raw = F.encode("text", "UTF-8")
        own = texts.select("doc", "text")
        if n > ITEM_ROWS:           # texts without such an item do not move
            docs_of = write_table(at.select(F.col("doc").alias("code")).distinct(), "wanted")
            own = with_repeated(own.withColumn("code", F.col("doc")), docs_of).drop("code")
        met = own.join(small_hint(at, n, ITEM_ROWS), "doc")
        return met.select("item", "n", F.decode(F.substring(raw, F.col("begin").cast("int") + 1, F.col("size").cast("int")),
                                                "UTF-8").alias("text"))

    _, label = verified_classes(buckets, fetch, WIDTH, LEAST, (said, None, _may_be_alike))
    clustered = lines.join(item_of, "line_key").join(
        small_hint(label, label.count(), BROADCAST_ROWS), "item", "left").select(
        F.coalesce("label", "item").alias("cluster"), *UNIT[:-1])
    clustered = write_table(clustered, "clustered")
    discard(lines)
    discard(items)
    head = clustered.groupBy("cluster").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    head = head.select("cluster", F.col("f.doc").alias("first"), F.col("f.begin").alias("first_begin"),
                       (F.col("f.begin") - F.col("f.less")).alias("first_end"))
    head = head.withColumn("first_doc_id", F.col("first")) if plain else head.join(
        texts.select(F.col("doc").alias("first"), F.col("doc_id").alias("first_doc_id")), "first")
    head = write_table(head, "heads")
    # A line and its own sentence do not repeat each other.
    return (clustered.join(small_hint(head, head.count(), ITEM_ROWS), "cluster")
            .filter("doc != first or begin >= first_end or begin + size <= first_begin")
            .select(*UNIT[:-1], "first_doc_id"))


RESULT = "doc_id long, n_bytes long, n_paragraphs_removed long, n_short_lines_removed long, n_removed long, first_doc_ids array<long>, kept_sha256 string"


def removed_spans(raw: bytes, gone: list[dict]) -> tuple[list[dict], int, int]:
    """What goes of a text, how many paragraphs that is (lines of ``LONG_WORDS``, runs of sentences of
    ``RUN_WORDS``), and how many shorter lines.  A run is a stretch of repeated units with fewer than ``SENTENCE_WORDS``
    words between neighbours; its sentences go if its units have ``RUN_WORDS`` words together."""
    lines = [g for g in gone if g["whole"]]
    inside = sorted((g["begin"], g["begin"] + g["size"]) for g in lines)
    begins = [b for b, _ in inside]

    def free(g):
        k = bisect_right(begins, g["begin"]) - 1
        return k < 0 or inside[k][1] <= g["begin"]

    parts = sorted(lines + [g for g in gone if not g["whole"] and free(g)], key=lambda g: g["begin"])
    long = sum(g["words"] >= LONG_WORDS for g in lines)
    out, runs, run = [], 0, []
    for g in [*parts, None]:
        if run and (g is None or len(raw[run[-1]["begin"] + run[-1]["size"]:g["begin"]].split()) >= SENTENCE_WORDS):
            enough = sum(x["words"] for x in run) >= RUN_WORDS
            out += [x for x in run if x["whole"] or enough]
            runs += enough and not all(x["whole"] for x in run)
            run = []
        run.append(g)
    return out, long + runs, len(lines) - long


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            rows = []
            for doc, text, gone in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "gone"))):
                raw = text.encode()
                spans, paragraphs, short = removed_spans(raw, gone or [])
                kept, end = [], 0
                for g in spans:
                    kept.append(raw[end:g["begin"]])
                    end = g["begin"] + g["size"]
                    end += g["whole"] and raw[end:end + 1] == b"\n"        # the line goes with its end
                kept = b"".join([*kept, raw[end:]])
                rows.append((doc, len(raw), paragraphs, short, len(raw) - len(kept),
                             sorted({g["first_doc_id"] for g in spans}, key=lambda x: (x is not None, x or 0)), hashlib.sha256(kept).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string()]
            names = ["doc_id", "n_bytes", "n_paragraphs_removed", "n_short_lines_removed", "n_removed", "first_doc_ids", "kept_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def remove_paragraphs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: what it loses, to whom, and the digest of what is left."""
    texts = numbered(docs)
    gone = repeated_paragraphs(docs, texts).groupBy("doc").agg(
        F.collect_list(F.struct("begin", "size", "words", "whole", "first_doc_id")).alias("gone"))      # a document's own lines
    gone = write_table(gone, "gone")
    met = texts[0].join(small_hint(gone, gone.count(), ITEM_ROWS // 4), "doc", "left").select("doc_id", "text", "gone")
    return met.mapInArrow(_cut, RESULT)
