"""Repeated 100-byte strings, found with a logarithmic family of suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or the same document and an earlier start).

Dealing.  The smallest hash among a string's ``GRAM``-byte grams (the leftmost on
a tie) is its *anchor*; equal strings have equal anchors at equal places, so
strings can be compared anchor by anchor.  Successive strings of a document with
one anchor travel as one *stretch* of about 130 bytes.

1. Each task cuts its documents into stretches and sends only two 64-bit hashes
   (anchor, whole stretch) and the place.  Of equal stretches in one step it sends
   the earliest; the others are settled on the spot.
2. Per anchor: of equal stretches (equal in both hashes) all but the earliest go.
   An anchor with a single kind of stretch is settled.  Only the earliest stretch
   of each kind of the other anchors goes on, with its bytes.
3. Per bucket of anchors the stretches arrive in batches, earliest first.  A batch
   gets a suffix array (the starts of its strings, sorted by their bytes), is
   merge-scanned against the arrays of the existing levels for strings that stand
   there already, and becomes a level; equal-sized levels merge, so there are
   logarithmically many.
4. The settled spans meet their documents, which are cut and digested.

Defined results: null text counts as empty; a null doc_id sorts first; rows that
share a doc_id are documents of their own, by the digest of their text; texts under ``LENGTH`` bytes lose nothing; a long text is cut into
overlapping parts and loses what it would lose in one; an empty table gives an
empty table; other columns never matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphssl.llm.common import mix64, numbered, partitions, prefix_hash, steps, utf8
from graphssl.operators.sizing import small_hint
from graphssl.session import write_table

#: Length of a string, and of the grams that anchors are chosen from.
LENGTH, GRAM = 100, 32
#: Bytes that one step cuts into stretches (places take 23 bits).
PART = 2 << 20
#: Strings of a batch of the index.
BATCH = 1 << 17
#: Buckets of step 3 per shuffle partition.
FINER = 4
BROADCAST_ROWS = 500_000

_PLACE = np.uint64((1 << 23) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def stretches(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Every stretch of some texts: row, first and last string (``lo``, ``hi``, starts
    within the row), hash of the anchor and of the stretch around it."""
    n = len(data)
    none = {k: np.zeros(0, np.int64) for k in ("row", "lo", "hi")}
    none |= {k: np.zeros(0, np.uint64) for k in ("anchor", "whole")}
    if n < LENGTH:
        return none
    h, inv = prefix_hash(data)
    gram = mix64((h[GRAM:] - h[:-GRAM]) * inv[:n - GRAM + 1])
    low = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[:span - width], low[width - span:])
    at = (low & _PLACE).astype(np.int64)
    row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    start = np.flatnonzero(row_of[:n - LENGTH + 1] == row_of[LENGTH - 1:])
    if not len(start):
        return none
    cut = np.flatnonzero((start[1:] != start[:-1] + 1) | (at[start[1:]] != at[start[:-1]])) + 1
    lo = start[np.concatenate([[0], cut])]
    hi = start[np.concatenate([cut, [len(start)]]) - 1]
    a = at[lo]
    whole = (h[hi + LENGTH] - h[lo]) * inv[lo]
    whole = mix64(whole + (hi - lo).astype(np.uint64) * _MIX) ^ mix64((a - lo).astype(np.uint64) + _MIX)
    row = row_of[lo]
    return {"row": row, "lo": lo - offsets[row], "hi": hi - offsets[row], "anchor": gram[a], "whole": whole}


def parts(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(first row, bytes, offsets, shift)``: some rows, or a part of one long row."""
    data, off = utf8(text)
    for i, j in steps(off, PART):
        if j == i + 1 and off[j] - off[i] > PART + LENGTH:
            for s in range(int(off[i]), int(off[j]), PART):
                e = min(int(off[j]), s + PART + LENGTH - 1)
                yield i, data[s:e], np.array([0, e - s]), np.array([s - off[i]])
        else:
            yield i, data[off[i]:off[j]], off[i:j + 1] - off[i], np.zeros(j - i, np.int64)


def _earliest(s: dict[str, np.ndarray]):
    """Order by (anchor, stretch, document, place) and a mark on the first of each stretch."""
    order = np.lexsort((s["lo"], s["doc"], s["whole"], s["anchor"]))
    a, w = s["anchor"][order], s["whole"][order]
    return order, np.concatenate([[True], (a[1:] != a[:-1]) | (w[1:] != w[:-1])])[:len(a)]


def _again(s: dict[str, np.ndarray], order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places in ``order`` that repeat an earlier stretch.  (The same place of a
    document given twice repeats nothing.)"""
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
    return ~first & ((s["doc"][order] != s["doc"][head]) | (s["lo"][order] != s["lo"][head]))


FIELDS = (("anchor", np.uint64), ("whole", np.uint64), ("doc", np.int64), ("lo", np.int64), ("hi", np.int64))


def _pack(s: dict[str, np.ndarray]) -> bytes:
    return b"".join(s[k].astype(t).tobytes() for k, t in FIELDS)


def _unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list] = {k: [] for k, _ in FIELDS}
    for blob in blobs:
        n = len(blob) // (8 * len(FIELDS))
        for i, (k, t) in enumerate(FIELDS):
            out[k].append(np.frombuffer(blob, t, n, 8 * n * i))
    return {k: np.concatenate(v) for k, v in out.items()}


def _cut(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1: per part, the sent stretches by bucket (bucket >= 0) and the settled
    ones (bucket -1)."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for i, data, off, shift in parts(batch.column("text")):
            s = stretches(data, off)
            if not len(s["row"]):
                continue
            row = s.pop("row")
            s |= {"doc": ids[i + row], "lo": s["lo"] + shift[row], "hi": s["hi"] + shift[row]}
            order, first = _earliest(s)
            again = order[_again(s, order, first)]
            sent = order[first]
            to = (s["anchor"][sent] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            sent, to = sent[by], to[by]
            groups = [(int(to[g[0]]), sent[g]) for g in np.split(np.arange(len(to)), np.flatnonzero(np.diff(to)) + 1) if len(g)]
            if len(again):
                groups.append((-1, again))
            yield pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in groups], pa.int32()),
                 pa.array([_pack({k: v[g] for k, v in s.items()}) for _, g in groups], pa.binary())],
                names=["bucket", "packed"])


SETTLED = "doc long, lo long, hi long, bucket int"


def _settle(pdf: pd.DataFrame, finer: int) -> pd.DataFrame:
    """Step 2 for one bucket: spans that go (bucket -1), stretches that go on (>= 0)."""
    s = _unpack(list(pdf["packed"]))
    order, first = _earliest(s)
    again = order[_again(s, order, first)]
    kind = order[first]                      # sorted by anchor
    anchor = s["anchor"][kind]
    several = np.zeros(len(kind), bool)
    several[1:] |= anchor[1:] == anchor[:-1]
    several[:-1] |= anchor[1:] == anchor[:-1]
    on = kind[several]
    to = (mix64(s["anchor"][on]) % np.uint64(finer)).astype(np.int64)
    pick = np.concatenate([again, on])
    return pd.DataFrame({"doc": s["doc"][pick], "lo": s["lo"][pick], "hi": s["hi"][pick],
                         "bucket": np.concatenate([np.full(len(again), -1), to])})


def suffix_order(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The starts' order by their ``LENGTH`` bytes (stable), and for each place in that
    order whether its string equals the one before.  Eight bytes are compared at a
    time; a string that differs from all others is left alone from then on."""
    n = len(starts)
    rank = np.zeros(n, np.int64)            # place of the first string of the same bytes so far
    open_ = np.arange(n)
    for w in range(0, LENGTH, 8):
        if not len(open_):
            break
        width = min(8, LENGTH - w)
        word = np.zeros((len(open_), 8), np.uint8)
        word[:, :width] = text[starts[open_][:, None] + np.arange(w, w + width)]
        word = word.reshape(-1).view(">u8").astype(np.uint64)
        order = np.lexsort((word, rank[open_]))
        open_, word = open_[order], word[order]
        r = rank[open_]
        new_group = np.concatenate([[True], r[1:] != r[:-1]])
        new_word = new_group | np.concatenate([[True], word[1:] != word[:-1]])
        group_at = np.maximum.accumulate(np.where(new_group, np.arange(len(r)), 0))
        word_at = np.maximum.accumulate(np.where(new_word, np.arange(len(r)), 0))
        rank[open_] = r + (word_at - group_at)
        single = new_word & np.concatenate([new_word[1:], [True]])
        open_ = open_[~single]
    order = np.argsort(rank, kind="stable")
    same = np.concatenate([[False], rank[order][1:] == rank[order][:-1]])[:n]
    return order, same


class Levels:
    """A logarithmic family: each level is a text and the sorted starts of its strings."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _joined(a: tuple, b: tuple):
        return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1] + len(a[0])])

    def add(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Adds a batch, later than all before; marks its strings that stood already, in
        a level or earlier in the batch."""
        known = np.zeros(len(starts), bool)
        order, same = suffix_order(text, starts)
        known[order[same]] = True               # stable: the earliest of equals is not marked
        for level in self.levels:
            both, at = self._joined(level, (text, starts[order]))
            merged, same = suffix_order(both, at)
            # A string of the batch whose run of equals begins in the level stands there.
            head = merged[np.maximum.accumulate(np.where(same, 0, np.arange(len(merged))))]
            mine = merged >= len(level[1])
            known[order[merged[mine & (head < len(level[1]))] - len(level[1])]] = True
        new = (text, starts[order][~known[order]])
        while self.levels and len(self.levels[-1][1]) <= 2 * len(new[1]):
            both, at = self._joined(self.levels.pop(), new)
            new = (both, at[suffix_order(both, at)[0]])
        self.levels.append(new)
        return known


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    """Step 3 for one bucket of anchors: the spans that go."""
    pdf = pdf.sort_values(["doc", "lo"], kind="stable").drop_duplicates(["doc", "lo"])
    raw, doc, lo = pdf["bytes"].to_list(), pdf["doc"].to_numpy(), pdf["lo"].to_numpy()
    strings = np.array([len(b) - LENGTH + 1 for b in raw])
    index, out = Levels(), []
    cut = np.searchsorted(np.cumsum(strings), np.arange(0, strings.sum(), BATCH), "left")
    cut = np.unique(np.concatenate([cut, [0, len(raw)]]))
    for i, j in zip(cut, cut[1:]):
        text = np.frombuffer(b"".join(raw[i:j]), np.uint8)
        size = strings[i:j] + LENGTH - 1
        base = np.cumsum(size) - size
        owner = np.repeat(np.arange(i, j), strings[i:j])
        place = np.arange(len(owner)) - np.repeat(np.cumsum(strings[i:j]) - strings[i:j], strings[i:j])
        known = index.add(text, base[owner - i] + place)
        hit = np.flatnonzero(known)
        if len(hit):
            head = np.concatenate([[True], (np.diff(hit) != 1) | (owner[hit][1:] != owner[hit][:-1])])
            tail = np.concatenate([head[1:], [True]])
            out.append(pd.DataFrame({"doc": doc[owner[hit[head]]], "lo": lo[owner[hit[head]]] + place[hit[head]],
                                     "hi": lo[owner[hit[tail]]] + place[hit[tail]]}))
    return pd.concat(out) if out else pd.DataFrame({k: np.zeros(0, np.int64) for k in ("doc", "lo", "hi")})


def repeated_spans(texts: DataFrame) -> DataFrame:
    """``(doc, lo, hi)`` of ``(doc, text)``: the strings that start at ``lo`` to ``hi`` of a document start
    earlier somewhere."""
    spark = texts.sparkSession
    n = partitions(spark)
    texts = texts.select(F.col("doc").alias("doc_id"), "text")
    cut = write_table(texts.mapInArrow(lambda it: _cut(it, n), "bucket int, packed binary"), "stretches")
    local = cut.filter("bucket < 0").mapInArrow(_unpacked, "doc long, lo long, hi long")
    settled = write_table(cut.filter("bucket >= 0").groupBy("bucket").applyInPandas(
        lambda pdf: _settle(pdf, FINER * n), SETTLED), "settled")
    on = settled.filter("bucket >= 0")
    per = on.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "bucket")).alias("want"))
    per = write_table(per, "wanted")
    text = texts.select(F.col("doc_id").alias("doc"), "text").join(
        small_hint(per, per.count(), BROADCAST_ROWS // 20), "doc")
    kinds = text.mapInArrow(_with_bytes, "bucket int, doc long, lo long, bytes binary")
    indexed = write_table(kinds.groupBy("bucket").applyInPandas(_index, "doc long, lo long, hi long"), "indexed")
    return local.unionByName(settled.filter("bucket < 0").select("doc", "lo", "hi")).unionByName(indexed)


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        s = _unpack(batch.column("packed").to_pylist() or [b""])
        yield pa.RecordBatch.from_arrays([pa.array(s[k]) for k in ("doc", "lo", "hi")], names=["doc", "lo", "hi"])


def _with_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64).to_pydict()
            rows = [(w["bucket"], doc, w["lo"], raw[w["lo"]:w["hi"] + LENGTH])
                    for doc, raw, want in zip(part["doc"], (t.encode() for t in part["text"]), part["want"]) for w in want]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["bucket", "doc", "lo", "bytes"])


def merged_runs(lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans ``[lo, end)`` as maximal runs."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], lo[1:] > end[:-1]])
    return lo[new], end[np.concatenate([new[1:], [True]])]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _finish(batches: Iterator[pa.RecordBatch], emit) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
            spans = zip(part.column("lo").to_pylist(), part.column("hi").to_pylist())
            rows = []
            for doc, text, (lo, hi) in zip(ids, texts, spans):
                raw = text.encode()
                begin, end = merged_runs(np.array(lo, np.int64), np.array(hi, np.int64) + LENGTH) if lo else ([], [])
                kept = b"".join(raw[a:b] for a, b in zip([0, *end], [*begin, len(raw)]))
                rows.append(emit(doc, raw, kept, len(begin)))
            yield from rows_to_batches(rows)


def rows_to_batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [c.split()[0] for c in RESULT.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: what it loses, and the digest of what is left."""
    texts, _ = numbered(docs)
    spans = repeated_spans(texts).groupBy("doc").agg(
        F.collect_list(F.struct("lo", "hi")).alias("s"))           # a document's own spans
    spans = spans.select("doc", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi"))
    met = texts.join(spans, "doc", "left").select("doc_id", "text", "lo", "hi")

    def emit(doc, raw, kept, n_spans):
        return doc, len(raw), len(raw) - len(kept), n_spans, hashlib.sha256(kept).hexdigest()

    return met.mapInArrow(lambda it: _finish(it, emit), RESULT)
