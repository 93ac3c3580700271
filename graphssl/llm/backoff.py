"""Language-model scores of documents by stupid backoff.

The model is the corpus itself, each document scored by the counts of all
*other* documents:

    S(w | v) = c(v w) / c(v)                if v w stands in another document,
               ALPHA * max(c(w), 1/2) / N   otherwise;

the first word has no context and no factor ``ALPHA``.  ``N`` is the number of
words of all other documents (1 at least).  A document's score is the sum of
``ln S`` over its words.  ``order`` may be higher; the context then shortens by a
word at a time.

Relationally: the n-grams of the documents (exploded per chunk of documents, with
their counts) are dealt by hash, and each hash partition holds its part of the
count tables; the totals are joined back to the chunk's n-grams and summed per
document.  A chunk sends every distinct n-gram once, as a 64-bit hash in a packed
row, and gets one total back for each, so a frequent n-gram is one entry per
chunk, not one per occurrence.  Two n-grams share a hash with probability 2^-64.

Defined results: null and empty texts have no words, log_score 0 and a null mean;
repeated rows and rows that share a doc_id are documents of their own; an empty
table gives an empty table; other columns never matter; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphssl.llm.common import id_text, mix64, partitions, utf8, word_hashes
from graphssl.session import write_table

#: Fixed value: the factor of a shorter context.
ALPHA = 0.4
ORDER = 2
#: Chunks of documents per shuffle partition.
FINER = 4


def pack(counts: np.ndarray) -> bytes:
    """A byte per count below 255; larger ones follow in full."""
    counts = counts.astype(np.uint64)
    return np.minimum(counts, np.uint64(255)).astype(np.uint8).tobytes() + counts[counts >= 255].tobytes()


def unpack(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.uint64)
    counts[counts == 255] = np.frombuffer(raw[n:], np.uint64)
    return counts


class Grams:
    """All n-grams (1 to ``order`` words) of some texts."""

    def __init__(self, text: pa.ChunkedArray, order: int):
        data, offsets = utf8(text)
        h, self.row = word_hashes(data, offsets)
        self.n_words = np.bincount(self.row, minlength=len(offsets) - 1)
        n = len(h)
        place = np.arange(n) - (np.cumsum(self.n_words) - self.n_words)[self.row] if n else np.zeros(0, np.int64)
        kinds, g = [h], h
        for m in range(2, order + 1):       # g[i]: the m-gram that ends at word i
            before = np.concatenate([g[:1], g[:-1]])
            g = mix64(before * np.uint64(0x9E3779B97F4A7C15) + h + np.uint64(m))
            kinds.append(g)
        self.place = place
        #: Per length, the words where an n-gram of that length ends.
        self.ends = [np.flatnonzero(place >= m) for m in range(order)]
        every = np.concatenate([k[e] for k, e in zip(kinds, self.ends)])
        self.hash, which, self.count = np.unique(every, return_inverse=True, return_counts=True)
        self.which = []
        at = 0
        for e in self.ends:
            index = np.full(n, -1)
            index[e] = which[at:at + len(e)]
            at += len(e)
            self.which.append(index)

    def by_bucket(self, n: int):
        """``(bucket, places in self.hash)`` of every bucket that has n-grams."""
        to = (self.hash % np.uint64(n)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.flatnonzero(np.diff(to[order])) + 1
        return [(int(to[g[0]]), g) for g in np.split(order, cut) if len(g)]

    def scores(self, total: np.ndarray):
        """Per row: the sum of ``ln S`` without the terms ``-ln N``, and their number."""
        n = len(self.row)
        others = []
        for index in self.which:            # occurrences in other documents
            there = index >= 0
            key = self.row[there] * len(self.hash) + index[there]
            _, place, own = np.unique(key, return_inverse=True, return_counts=True)
            c = np.zeros(n)
            c[there] = total[index[there]] - own[place]
            others.append(c)
        s, open_ = np.zeros(n), np.ones(n, bool)
        longest = np.minimum(self.place, len(self.which) - 1)       # words of context
        for m in range(len(self.which) - 1, 0, -1):
            hit = open_ & (longest >= m) & (others[m] > 0)
            context = np.concatenate([[0.0], others[m - 1][:-1]]) if n else others[m - 1]
            s[hit] += np.log(others[m][hit] / context[hit])
            open_ &= ~hit
            s[open_ & (longest >= m)] += np.log(ALPHA)
        s[open_] += np.log(np.maximum(others[0][open_], 0.5))
        rows = len(self.n_words)
        return np.bincount(self.row, s, rows).astype(float), np.bincount(self.row[open_], minlength=rows)


def _send(table: pa.Table, order: int, buckets: int) -> pa.Table:
    """The distinct n-grams of a chunk and their counts, by bucket."""
    grams = Grams(table.column("text"), order)
    groups = grams.by_bucket(buckets)
    chunk = table.column("chunk")[0].as_py()
    return pa.table({
        "bucket": pa.array([b for b, _ in groups], pa.int32()), "chunk": pa.array([chunk] * len(groups), pa.int32()),
        "hashes": pa.array([grams.hash[g].tobytes() for _, g in groups], pa.binary()),
        "counts": pa.array([pack(grams.count[g]) for _, g in groups], pa.binary())})


def _total(table: pa.Table) -> pa.Table:
    """A hash partition of the count tables, joined to what the chunks have sent."""
    table = table.sort_by("chunk")
    hashes = [np.frombuffer(b, np.uint64) for b in table.column("hashes").to_pylist()]
    counts = [unpack(b, len(h)) for b, h in zip(table.column("counts").to_pylist(), hashes)]
    _, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts)).astype(np.uint64)[which]
    cut = np.cumsum([len(h) for h in hashes])[:-1]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"),
                     "totals": pa.array([pack(t) for t in np.split(total, cut)], pa.binary())})


def _score(docs: pa.Table, totals: pa.Table, order: int, buckets: int) -> pa.Table:
    grams = Grams(docs.column("text"), order)
    of = dict(zip(totals.column("bucket").to_pylist(), totals.column("totals").to_pylist()))
    total = np.zeros(len(grams.hash))
    for b, g in grams.by_bucket(buckets):
        total[g] = unpack(of[b], len(g))
    s, n_uni = grams.scores(total)
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(grams.n_words, pa.int64()),
                     "part": pa.array(s), "n_short": pa.array(n_uni, pa.int64())})


def backoff_scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_short`` (words scored without
    context), ``log_score, mean_log_score``."""
    n = partitions(docs.sparkSession)
    chunks = FINER * n
    dealt = id_text(docs).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
                                 "doc_id", "text").repartition(n, "chunk")
    sent = dealt.groupBy("chunk").applyInArrow(
        lambda t: _send(t, order, n), "bucket int, chunk int, hashes binary, counts binary")
    totals = sent.groupBy("bucket").applyInArrow(_total, "chunk int, bucket int, totals binary")
    scored = dealt.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(
        lambda d, t: _score(d, t, order, n), "doc_id long, n_words long, part double, n_short long")
    scored = write_table(scored, "backoff")
    every = scored.agg(F.coalesce(F.sum("n_words"), F.lit(0))).head()[0]
    rest = F.greatest(F.lit(every) - F.col("n_words"), F.lit(1)).cast("double")
    log = F.col("part") - F.col("n_short") * F.log(rest)
    return scored.select("doc_id", "n_words", "n_short", F.round(log, 4).alias("log_score"),
                         F.when(F.col("n_words") > 0, F.round(log / F.col("n_words"), 6)).alias("mean_log_score"))
