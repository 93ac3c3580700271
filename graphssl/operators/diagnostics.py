"""Data checks and diagnostics (V1-V3, D1-D5) -- DataFrames, run on request."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def has_column(df: DataFrame, col: str, with_type: DataType) -> None:
    """V1: column exists and has the given type (schema only, no job)."""
    if col not in df.columns:
        raise AssertionError(f"column {col!r} is missing; there are {df.columns}")
    found = df.schema[col].dataType
    if found != with_type:
        raise AssertionError(
            f"{col!r} holds {found.simpleString()} values, {with_type.simpleString()} is needed")


def has_columns(df: DataFrame, cols) -> None:
    """V3: required columns present (schema only)."""
    missing = set(cols) - set(df.columns)
    if missing:
        raise AssertionError(
            f"no column named {sorted(missing)} among {df.columns}")


def column_unique_frame(df: DataFrame, col: str) -> DataFrame:
    """V2 as a frame: ``(column, n, n_distinct, is_unique)`` in one pass."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.count_distinct(F.col(col)).alias("n_distinct")).select(
        F.lit(col).alias("column"), "n", "n_distinct",
        (F.col("n") == F.col("n_distinct")).alias("is_unique"))


def column_is_unique(df: DataFrame, col: str) -> None:
    """V2: raise when ``col`` has duplicates."""
    row = column_unique_frame(df, col).first()
    if not row["is_unique"]:
        raise AssertionError(f"{row['n'] - row['n_distinct']} rows repeat a value of {col!r}")


def finished_by_group(df: DataFrame) -> DataFrame:
    """Distinct ``(grp, finished)``."""
    return df.select("grp", "finished").distinct()


def group_sizes(df: DataFrame) -> DataFrame:
    """Rows per group."""
    return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def label_report(df: DataFrame) -> DataFrame:
    """D3: per ``(grp, finished, label)`` the row count (label NULL = unlabelled)."""
    return df.groupBy("grp", "finished", "label").agg(F.count(F.lit(1)).alias("n"))


def _count_rows(batches):
    """One row per partition, also for one without rows."""
    n = sum(batch.num_rows for batch in batches)
    yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64())],
                                     names=["partition", "n"])


def partition_rows(df: DataFrame) -> DataFrame:
    """Rows per physical Spark partition, empty ones too.

    Every task counts its rows as they stream by and emits one number; only a constant is
    sent per row."""
    return df.select(F.lit(True).alias("row")).mapInArrow(_count_rows, "partition int, n long")


def partition_skew(df: DataFrame) -> DataFrame:
    """The largest and smallest partition, how many are empty, and ``max / mean`` rows.

    ``max / min`` (``skew``) is NULL where a partition is empty."""
    return partition_rows(df).agg(
        F.max("n").alias("max_rows"), F.min("n").alias("min_rows"),
        F.sum((F.col("n") == 0).cast("bigint")).alias("n_empty"),
        F.try_divide(F.max("n").cast("double"), F.min("n").cast("double")).alias("skew"),
        F.try_divide(F.max("n").cast("double"), F.avg("n")).alias("over_mean"))
