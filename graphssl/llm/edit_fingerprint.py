"""Document fingerprints by a randomised edit embedding.

All documents share one source of coins.  A pointer starts at the first character;
at step ``j`` the embedding emits the character under the pointer, and coin
``(j, character)`` decides whether the pointer moves on.  A text of ``n``
characters takes about ``2 n`` steps; its walk ends where the text does, however long
it waits.  Texts at a small edit distance
have embeddings at a small Hamming distance: once the pointers of two walks meet
on equal text, they stay together.

A fingerprint samples the embedding at steps that are shared as well: step ``j``
has a level, ``l`` or more with probability ``2^-l``, and a text of ``n``
characters keeps the steps of level ``s`` or more, the smallest ``s`` that leaves
at most about ``SAMPLES`` of them.  Fingerprints of different levels are compared
on the steps that both keep.  Each sample is one byte of a hash of the character.
As text: two hex digits for ``s``, then two per sample, up to the text's end.

``near_pairs`` bands sampled bits, joins documents that share a band and verifies
the Hamming likeness of whole fingerprints.  Four bits of each of the first samples
travel with a band, so that texts with a common opening and little else are told
apart inside the join and never become pairs.

The walk runs over many texts at once in numpy, and an edited text's goes on from its text's; texts are dealt
by ranges of doc_id, so a document and its successor meet without a global sort.

Defined results: null text counts as empty; empty texts have the fingerprint
``00`` and likeness 1 to each other, 0 to any other; a null doc_id sorts first;
rows that share a doc_id sort by text; a single document follows itself; an empty
table gives an empty table; other columns never matter; a text is walked whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphssl.llm.common import id_text, mix64, with_next
from graphssl.llm.similar import BROADCAST_ROWS, bucket_classes
from graphssl.operators.sizing import small_hint
from graphssl.session import write_table

#: Expected samples of a text that has more characters than this.
SAMPLES = 128
#: Steps whose coins are drawn together.
BLOCK = 4096
#: Steps between two looks at which walks have ended or begin.
STRIDE = 256
#: Characters that a task walks together, as a step costs much the same for few walks as for many (a longer text is
#: walked alone).
STEP_CHARS = 16 << 20
#: Bands, bits of the samples in a band, and likeness from which a pair is near.
BANDS, BAND_SAMPLES, LEAST = 16, 8, 0.8

_COINS = 0xC01
_LEVELS = np.uint64(0xA5A5)


def _coins(block: int) -> np.ndarray:
    """``(BLOCK, 256)`` moves; the end mark (0) never moves."""
    r = np.random.Generator(np.random.Philox(key=_COINS, counter=[0, 0, 0, block]))
    coins = r.integers(0, 2, (BLOCK, 256), np.uint8).astype(np.int64)
    coins[:, 0] = 0
    return coins


def _levels(first: int, n: int) -> np.ndarray:
    """Level of steps ``first`` to ``first + n - 1``: trailing zeros of a hash."""
    h = mix64(np.arange(first, first + n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + _LEVELS)
    low = h & (~h + np.uint64(1))
    return np.log2(low.astype(np.float64)).astype(np.int64)


def _symbols(text: str) -> np.ndarray:
    """A byte from 1 to 255 per character, then the end mark."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.zeros(len(code) + 1, np.uint8)
    out[:-1] = mix64(code + np.uint64(1)) % np.uint64(255) + np.uint64(1)
    return out


def scale_of(n: np.ndarray) -> np.ndarray:
    """Level from which a text of ``n`` characters keeps steps (two steps a character)."""
    return np.ceil(np.log2(np.maximum(1.0, 2 * np.asarray(n) / SAMPLES))).astype(np.int64)


def walk(texts: list[str], forks: dict[int, tuple[int, int]] | None = None) -> list[bytes]:
    """The fingerprint of every text: its level, then its samples.

    ``forks``: of some texts, another one without a fork (as ``(index, n)``) that begins with the same ``n``
    characters; if both have one level, the text takes that walk's steps over them."""
    parts = [_symbols(t) for t in texts]
    length = np.array([len(p) - 1 for p in parts], np.int64)
    scale = scale_of(length)
    start = np.cumsum(length + 1) - (length + 1)
    symbols = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    out = [bytes([s]) for s in scale]
    for s in np.unique(scale[length > 0]):
        mine = np.flatnonzero((scale == s) & (length > 0))
        place = {int(i): k for k, i in enumerate(mine)}
        fork = [(k, place[forks[i][0]], forks[i][1]) for i, k in place.items()
                if forks and i in forks and forks[i][0] in place]
        child, parent, common = np.array(fork, np.int64).reshape(-1, 3).T
        joined = np.zeros(len(mine), np.int64)      # samples that the other walk had taken
        pointer, taken, step = start[mine].copy(), [], 0
        alive = np.setdiff1d(np.arange(len(mine)), child)
        most = 3 * int(length[mine].max())      # few walks are longer
        while len(alive):
            first = step % BLOCK
            if not step or not first:
                coins, levels = _coins(step // BLOCK), _levels(step, BLOCK)
            last = min(BLOCK, first + STRIDE, first + max(most - step, 64))
            if len(child):      # a step moves by one at most: what may reach the end of the common part goes on apart
                walked = pointer[parent] - start[mine[parent]]
                now = walked + (last - first) >= common
                pointer[child[now]] = start[mine[child[now]]] + walked[now]
                joined[child[now]] = len(taken)
                alive = np.concatenate([alive, child[now]])
                child, parent, common = child[~now], parent[~now], common[~now]
            at = pointer[alive]
            symbol, move = np.empty(len(at), np.uint8), np.empty(len(at), np.int64)
            for j in range(first, last):
                np.take(symbols, at, out=symbol, mode="clip")
                if levels[j] >= s:
                    taken.append((alive, symbol.copy()))
                np.take(coins[j], symbol, out=move, mode="clip")
                at += move
            pointer[alive] = at
            alive = alive[symbols[at] != 0]
            step += last - first
        if taken:
            who = np.concatenate([a for a, _ in taken])
            what = np.concatenate([b for _, b in taken])
            order = np.argsort(who, kind="stable")
            who, what = who[order], what[order]
            who, what = who[what != 0], what[what != 0]
            cut = np.searchsorted(who, np.arange(len(mine) + 1))
            origin = {k: o for k, o, _ in fork}
            for k, i in enumerate(mine):
                if k in origin:         # every step that is sampled gives a walk one sample until it ends
                    o = cut[origin[k]]
                    out[i] += what[o:o + joined[k]].tobytes()
                out[i] += what[cut[k]:cut[k + 1]].tobytes()
    return out


_KEPT: dict[int, np.ndarray] = {}


def _kept(low: int, high: int, n: int) -> np.ndarray:
    """Of the first ``n`` steps of level ``low`` or more: those of level ``high`` or more."""
    have = _KEPT.get(low)
    if have is None or len(have) < n:
        levels, first, found = [], 0, 0
        while found < max(n, 4 * SAMPLES):
            block = _levels(first, 1 << 16)
            levels.append(block[block >= low])
            found += len(levels[-1])
            first += 1 << 16
        have = _KEPT[low] = np.concatenate(levels)
    return have[:n] >= high


def likeness(a: bytes, b: bytes) -> float:
    """Share of the steps that either text reaches and both keep, with equal samples."""
    if a == b:
        return 1.0
    high = max(a[0], b[0])
    x, y = (np.frombuffer(f[1:], np.uint8) for f in (a, b))
    x, y = (v[_kept(f[0], high, len(v))] if f[0] < high else v for f, v in ((a, x), (b, y)))
    long, short = max(len(x), len(y)), min(len(x), len(y))
    return float((x[:short] == y[:short]).sum() / long) if long else 0.0


def edited_text(text: str, following: str) -> str:
    """The last quarter replaced by as much of the following text's beginning."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k] if k else text


COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ranges, in order; every row needs the one after it in its range."""
    held: list[tuple] = []          # (range, guest, doc_id, text)
    size = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
        texts = [a[3] for a, _ in pairs]
        edited = [edited_text(a[3], b[3]) for a, b in pairs]
        # Successors are mostly the next pair's text, so each text is walked once; an edited text is walked from
        # where it leaves its text.
        whole = dict.fromkeys([*texts, *(b[3] for _, b in pairs)])
        distinct = list(dict.fromkeys([*whole, *edited]))
        place = {t: k for k, t in enumerate(distinct)}
        forks = {place[e]: (place[t], len(t) - len(t) // 4) for t, e in zip(texts, edited) if e not in whole}
        print_of = dict(zip(distinct, walk(distinct, forks)))
        rows = [(a[2], len(t), hashlib.sha256(e.encode()).hexdigest(), print_of[t].hex(), print_of[e].hex(),
                 likeness(print_of[t], print_of[e]), likeness(print_of[t], print_of[b[3]]))
                for (a, b), t, e in zip(pairs, texts, edited)]
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        columns = list(zip(*rows)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row in zip(*(part.column(c).to_pylist() for c in ("_range", "_guest", "doc_id", "text"))):
                held.append(row)
                size += len(row[3])
                if size >= STEP_CHARS:
                    yield flush(held)
                    held, size = held[-1:], len(held[-1][3])
    if held:
        yield flush(held)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    dealt = with_next(id_text(docs), "doc_id", ["text"])
    return dealt.select("_range", "_guest", "doc_id", "text").mapInArrow(_rows, COLUMNS)


@cache
def _places(size: int) -> np.ndarray:
    """``(size, BANDS, BAND_SAMPLES)`` places for fingerprints of 1 to ``size`` samples.

    Every slot ranks all places by a hash and takes the first one that a fingerprint
    has.  Of two lengths both take the same place, or the longer one takes a place
    beyond the shorter's end: a slot agrees as often as the likeness says."""
    place = np.arange(size, dtype=np.uint64)[:, None]
    slot = mix64(np.arange(1, BANDS * BAND_SAMPLES + 1, dtype=np.uint64))
    rank = mix64(mix64(place + np.uint64(1)) ^ slot)
    low = np.minimum.accumulate(rank, axis=0)
    at = np.maximum.accumulate(np.where(rank == low, np.arange(size)[:, None], 0), axis=0)
    return at.reshape(size, BANDS, BAND_SAMPLES)


def _bands(fingerprint: pd.Series) -> pd.Series:
    """Per fingerprint, hashes of ``BANDS`` draws of ``BAND_SAMPLES`` samples and their
    places, over the whole fingerprint.

    Bands use the samples of the steps of two successive levels, so that texts on
    either side of a level's bound meet."""
    codes, level, count = [np.zeros((0, BANDS, BAND_SAMPLES), np.uint64)], [], []
    for text in fingerprint:
        f = bytes.fromhex(text)
        x = np.frombuffer(f[1:], np.uint8)
        before = len(level)
        for high in (f[0], f[0] + 1):
            y = x[_kept(f[0], high, len(x))]
            if len(y):
                at = _places(max(512, 1 << len(y).bit_length()))[len(y) - 1]
                codes.append((at * 256 + y[at]).astype(np.uint64)[None])
                level.append(high)
        count.append(len(level) - before)
    code = np.concatenate(codes)
    key = np.array(level, np.uint64)[:, None] * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_SAMPLES):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + code[:, :, k])
    cut = np.cumsum([0, *count])
    return pd.Series([key[a:b].reshape(-1).view(np.int64) for a, b in zip(cut, cut[1:])], dtype=object)


#: Samples of a fingerprint whose planes of bits are its sketch, and the bits of each.
SKETCHED, SKETCH_BITS = 128, 4
#: Columns of a sketch: the planes of the own level as words of 64 samples, those of the next level's first
#: 64 samples, and the numbers of samples at both.
OWN, NEXT = [f"p{i}" for i in range(SKETCH_BITS * SKETCHED // 64)], [f"q{i}" for i in range(SKETCH_BITS)]
PLANES = [*OWN, *NEXT, "own", "at"]


def _planes(x: np.ndarray, n: int) -> list[int]:
    first = np.zeros(n, np.uint8)
    first[:min(len(x), n)] = x[:n]
    return np.concatenate([np.packbits((first >> k) & 1) for k in range(SKETCH_BITS)]).view(np.int64).tolist()


def _sketches(fingerprint: pd.Series) -> pd.Series:
    """Per fingerprint the values of ``PLANES``."""
    out = []
    for text in fingerprint:
        f = bytes.fromhex(text)
        x = np.frombuffer(f[1:], np.uint8)
        y = x[_kept(f[0], f[0] + 1, len(x))]
        out.append([*_planes(x, SKETCHED), *_planes(y, 64), len(x), len(y)])
    return pd.Series(out, dtype=object)


def _may_be_near(least: float):
    """A pair of likeness ``least`` differs in at most ``1 - least`` of the samples of the longer
    one, hence in no more of the first ones, nor in their bits (a sample beyond a text's end
    differs from any).  Two fingerprints of one level are compared at that level, whichever bands they share; else
    the next level of one is the other's own."""
    def differ(one: list[str], other: list[str]):
        bits = F.lit(0).cast("long")
        for x, y in zip(one, other):
            bits = bits.bitwiseOR(F.col(x).bitwiseXOR(F.col(f"_{y}")))
        return F.bit_count(bits)

    def condition():
        words = len(OWN) // SKETCH_BITS
        heads = OWN[::words]            # the first 64 samples
        level = sum((differ(OWN[i::words], OWN[i::words]) for i in range(words)), F.lit(0))
        cases = ((F.col("up") == F.col("_up"), level, "own", "own"),
                 (F.col("up"), differ(NEXT, heads), "at", "own"), (F.col("_up"), differ(heads, NEXT), "own", "at"))
        near = F.lit(False)
        for case, bits, n, m in reversed(cases):
            apart = F.greatest(bits, F.abs(F.col(n) - F.col(f"_{m}")))
            near = F.when(case, apart <= F.lit(1 - least) * F.greatest(F.col(n), F.col(f"_{m}")) + F.lit(1e-9)).otherwise(near)
        return near
    return condition


def near_pairs(prints: DataFrame, least: float = LEAST) -> DataFrame:
    """``prints(doc_id, fingerprint, ...)`` with ``class_id`` and ``class_key``: classes
    are components of fingerprints that share a band and are alike by at least
    ``least``.  ``class_id`` is the smallest doc_id of the class (null if no row of it has
    one), ``class_key`` a hash of its smallest fingerprint."""
    own = write_table(prints, "prints")
    items = write_table(own.groupBy("fingerprint").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n"))
                        .withColumn("item", F.monotonically_increasing_id()), "items")      # equal fingerprints are one item
    bands = F.pandas_udf(_bands, "array<long>")
    sketches = F.pandas_udf(_sketches, "array<long>")
    keyed = write_table(items.select("item", bands("fingerprint").alias("keys"), sketches("fingerprint").alias("planes")), "banded")
    # The first bands are of the fingerprint's own level, the others of the next.
    buckets = keyed.select("item", F.posexplode("keys").alias("nth", "bucket")).select(
        "item", "bucket", (F.col("nth") >= BANDS).alias("up"))

    def sketched(rows: DataFrame) -> DataFrame:
        own = small_hint(keyed.select("item", "planes"), keyed.count(), BROADCAST_ROWS // 2)
        return rows.join(own, "item").select(*rows.columns, *[F.col("planes")[i].alias(c) for i, c in enumerate(PLANES)])

    def alike(pairs: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def near(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([likeness(bytes.fromhex(x), bytes.fromhex(y)) for x, y in zip(a, b)], dtype=float)

        x = items.select(F.col("item").alias("a"), F.col("fingerprint").alias("x"))
        y = items.select(F.col("item").alias("b"), F.col("fingerprint").alias("y"))
        return pairs.join(x, "a").join(y, "b").filter(near("x", "y") >= least).select("a", "b")

    _, label = bucket_classes(buckets, alike, sketch=([*PLANES, "up"], sketched, _may_be_near(least)))
    many = label.count()
    met = items.join(small_hint(label, many, BROADCAST_ROWS), "item", "left")
    # A fingerprint of one row and without links is its row's own class.
    met = write_table(met.filter("n > 1 or label is not null").select(
        "fingerprint", "low", F.coalesce("label", "item").alias("label")), "met")
    of = met.groupBy("label").agg(F.min("low").alias("class_id"), F.xxhash64(F.min("fingerprint")).alias("class_key"))
    known = write_table(met.join(of, "label").select("fingerprint", "class_id", "class_key"), "classes")
    found = own.join(small_hint(known, known.count(), BROADCAST_ROWS // 8), "fingerprint", "left")
    return found.select(*[own[c] for c in own.columns], F.coalesce("class_id", "doc_id").alias("class_id"),
                        F.coalesce("class_key", F.xxhash64("fingerprint")).alias("class_key"))
