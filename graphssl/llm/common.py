"""Shared helpers of the training-data operators: table access, Arrow text
buffers, word and shingle hashes in numpy, neighbour rows in id order.

White space is the ASCII set ``[\\x20\\x09-\\x0D]`` everywhere in this package.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphssl.session import write_table

#: Bytes of text that one numpy step works on (a longer text is a step alone).
STEP_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


#: What this worker process keeps between tasks (at most one object).
_HELD: dict = {}


def held(key: str, make):
    """The object of ``key``, made once per worker and kept until another is asked for."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Frees what another operator has kept in this worker, and gives the memory back."""
    _HELD.clear()
    trim()


def trim() -> None:
    """Gives memory that this process has freed back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # not every C library has it
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """``(doc_id long, text string)`` with null texts as empty; drops every other
    column, so that extra columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``(doc, doc_id, text)`` of every row, and whether ``doc`` is ``doc_id``.

    ``doc`` is a long that no two rows share and that ascends with doc_id (null first; rows that share one,
    by the digest of their text).  It is doc_id itself where all are there and differ; else the
    rows are sorted and written with a number."""
    texts = id_text(docs)
    odd = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is null or n > 1")
    if odd.isEmpty():
        return texts.select(F.col("doc_id").alias("doc"), "doc_id", "text"), True
    order = ["doc_id", "_digest", "_tie"]
    dealt = (texts.withColumns({"_digest": F.sha2("text", 256), "_tie": F.monotonically_increasing_id()})
             .repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order))
    return write_table(dealt.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered"), False


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (uint64 in, uint64 out)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _BASE)


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets (nulls are empty)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    _, off, data = col.buffers()
    off = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (a longer row is a range alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(H, inv)``: the polynomial hash of ``data[s:e]`` is ``(H[e]-H[s])*inv[s]``
    (mod 2^64), wherever the bytes stand."""
    n = len(data)
    power = np.full(n + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    h = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], dtype=np.uint64, out=h[1:])
    inv = np.full(n + 1, _INVERSE, np.uint64)
    inv[0] = 1
    return h, np.cumprod(inv, dtype=np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray | None = None):
    """``(start, end, row)`` of every run of ``solid`` bytes within a row (default: of
    every white-space separated word)."""
    if solid is None:
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray):
    """``(hash, row)`` of every word, in text order."""
    start, end, row = words(data, offsets)
    h, inv = prefix_hash(data)
    return mix64((h[end] - h[start]) * inv[start] + (end - start).astype(np.uint64)), row


def shingles(hashes: np.ndarray, row: np.ndarray, n_rows: int, width: int):
    """``(hash, row)`` of every run of ``width`` words; a row with fewer words (but
    at least one) has one shingle of all its words."""
    count = np.bincount(row, minlength=n_rows)
    begin = np.concatenate([[0], np.cumsum(count)])
    n = len(hashes)
    place = np.arange(n) - begin[row] if n else np.zeros(0, np.int64)
    keep = (place + width <= count[row]) | ((place == 0) & (count[row] < width))
    at = np.flatnonzero(keep)
    out = np.zeros(len(at), np.uint64)
    r = row[at]
    for k in range(width):
        there = np.minimum(at + k, max(n - 1, 0))
        part = mix64(hashes[there] + np.uint64((k + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        out += np.where(place[at] + k < count[r], part, np.uint64(0))
    return mix64(out), r


def splitters(df: DataFrame, key: str, n: int) -> list[int]:
    """At most ``n - 1`` increasing bounds that cut ``key`` (a long) into ``n``
    ranges of about equal counts: ``n`` numbers on the driver, whatever the rows."""
    if n < 2:
        return []
    row = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], max(10_000, 20 * n)).alias("p")).head()
    return sorted(set(row["p"] or []))


def range_of(col, bounds: list[int]):
    """Index of the range that holds ``col``: the number of bounds below it (null: 0).

    Two levels, so that a row looks at about ``2 * sqrt(n)`` of the ``n`` bounds."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))

    def literal(values):
        return F.array(*[F.lit(int(b)).cast("long") for b in values])

    coarse = F.size(F.filter(literal(bounds[step - 1::step]), lambda b: b < col))
    fine = F.size(F.filter(F.slice(literal(bounds), coarse * step + 1, step), lambda b: b < col))
    return F.when(col.isNull(), F.lit(0)).otherwise(coarse * step + fine)


def ranges_with_next(df: DataFrame, key: str, n: int) -> DataFrame:
    """``df`` in at most ``n`` ranges of ``key`` (a long), each with the first row of
    the next range as a guest; the last range has the first row of all.

    Adds ``_range`` and ``_guest`` (1 for the row lent by the next range).  Rows
    with equal keys share a range; a null key is the smallest."""
    bounds = splitters(df, key, n)
    placed = df.withColumn("_range", range_of(F.col(key), bounds).cast("int"))
    own = F.coalesce(F.col(key), F.lit(-(1 << 63)))
    # One row per range (at most n): where each range begins.
    begins = sorted((r["_range"], r["k"]) for r in placed.groupBy("_range").agg(F.min(own).alias("k")).collect())
    if not begins:
        return placed.withColumn("_guest", F.lit(0))
    at = F.create_map(*[x for r, k in begins for x in (F.lit(r), F.lit(k).cast("long"))])
    to = F.create_map(*[x for i, (r, _) in enumerate(begins) for x in (F.lit(r), F.lit(begins[i - 1][0]))])
    host = F.when(own == F.element_at(at, F.col("_range")), F.element_at(to, F.col("_range")))
    copies = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")),
                     F.struct(host.alias("r"), F.lit(1).alias("g")))
    placed = placed.withColumn("_to", F.explode(F.filter(copies, lambda x: x.r.isNotNull())))
    return placed.withColumn("_range", F.col("_to.r")).withColumn("_guest", F.col("_to.g")).drop("_to")


def with_next(df: DataFrame, key: str, order: list) -> DataFrame:
    """``ranges_with_next`` with the rows of a range in one partition, sorted by
    ``_range, _guest, key, order``.  Every row moves once."""
    n = partitions(df.sparkSession)
    return (ranges_with_next(df, key, n).repartitionById(n, F.pmod(F.col("_range"), F.lit(n)).cast("int"))
            .sortWithinPartitions("_range", "_guest", key, *order))
