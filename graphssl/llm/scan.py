"""Running products of an associative operation inside segments of a sorted table.

``segmented_scan`` sorts a table by (segment, order) over range partitions, so that a
segment of any size is spread over as many partitions as it fills.  Every task
multiplies up its own rows; one row per partition goes to the driver, which
works out what each partition's first segment has before it; a broadcast of one
row per partition adds that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphssl.llm.common import partitions
from graphssl.session import write_table


def _same_as_last(column: pa.Array) -> np.ndarray:
    """Whether each value but the first equals the one before it (nulls are equal)."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.equal(a, b), False), both).to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal ``keys`` in a sorted stream, one table each."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for key in keys:
            same &= _same_as_last(batch.column(key))
        edges = [0, *(np.flatnonzero(~same) + 1).tolist(), batch.num_rows]
        for k, (i, j) in enumerate(zip(edges, edges[1:])):
            if held and (k or any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in keys)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def _local(segment: str, elements: list[str], combine: Callable):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, seg, last, state = TaskContext.get().partitionId(), 0, -1, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column(segment)
            start = np.ones(n, bool)
            start[1:] = ~_same_as_last(column)
            start[0] = state is None or column[0].as_py() != last
            number = seg + np.cumsum(start)
            head = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            place = np.arange(n) - head
            x = [np.array(batch.column(c), np.int64) for c in elements]
            shift = 1
            while shift <= place.max():
                to = np.flatnonzero(place >= shift)
                for c, v in zip(x, combine([c[to - shift] for c in x], [c[to] for c in x])):
                    c[to] = v
                shift *= 2
            if not start[0]:
                to = np.flatnonzero(number == seg)
                for c, v in zip(x, combine(state, [c[to] for c in x])):
                    c[to] = v
            seg, last, state = int(number[-1]), column[n - 1].as_py(), [int(c[-1]) for c in x]
            kept = [batch.column(c) if c not in elements else pa.array(x[elements.index(c)]) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(np.full(n, part, np.int32)), pa.array(number), pa.array(np.arange(at, at + n))],
                names=[*batch.schema.names, "_part", "_seg", "_at"])
            at += n
    return kernel


def segmented_scan(df: DataFrame, segment: str, order: list[str], elements: list[str], unit: list[int],
                   combine: Callable, name: str) -> DataFrame:
    """``df`` with every column of ``elements`` (longs) replaced by the product of the
    rows of its segment up to and with this one, in ``order`` (nulls first), and with
    ``_seg``, the rank of its segment (0 first).

    ``combine`` takes two lists of numbers, arrays or columns and must be associative with
    ``unit`` as its neutral element.  Rows that agree in segment and order stand in
    any order.  ``df`` is read twice and should be a written, narrow table."""
    spark = df.sparkSession
    n = partitions(spark)
    keys = [segment, *order]
    tied = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(n, *keys, "_tie").sortWithinPartitions(*keys, "_tie").drop("_tie")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in dealt.schema), T.StructField("_part", T.IntegerType()),
                           T.StructField("_seg", T.LongType()), T.StructField("_at", T.LongType())])
    local = write_table(dealt.mapInArrow(_local(segment, elements, combine), schema), name)
    ends = local.groupBy("_part").agg(
        F.min_by(F.struct(segment), "_at").alias("first"),
        F.max_by(F.struct(F.col(segment).alias("segment"), "_seg", *elements), "_at").alias("last"))
    rows, rank, before = [], -1, None
    for r in sorted(ends.collect(), key=lambda r: r["_part"]):          # one row per partition
        goes_on = before is not None and before[0] == r["first"][0]
        had = before[1] if goes_on else list(unit)
        rank += 0 if goes_on else 1
        rows.append((r["_part"], rank, *had))
        own = [r["last"][c] for c in elements]
        if r["last"]["_seg"] == 0:
            own = [int(v) for v in combine(had, own)]
        rank += r["last"]["_seg"]
        before = (r["last"]["segment"], own)
    carry = spark.createDataFrame(rows, T.StructType(
        [T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())]
        + [T.StructField(f"_had{i}", T.LongType()) for i in range(len(elements))]))
    both = local.join(F.broadcast(carry), "_part")
    whole = combine([F.col(f"_had{i}") for i in range(len(elements))], [F.col(c) for c in elements])
    total = {c: F.when(F.col("_seg") == 0, w).otherwise(F.col(c)) for c, w in zip(elements, whole)}
    return both.select(*[total[c].alias(c) if c in total else F.col(c) for c in df.columns],
                       (F.col("_seg") + F.col("_rank")).alias("_seg"))
