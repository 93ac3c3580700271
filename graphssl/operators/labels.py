"""Label-level operators: histogram, balanced class weights, seed signs, majority.

All of them aggregate first (partial/map-side), so what moves through a
shuffle is one row per (group, class), never the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizing import join_small


def label_histogram(df: DataFrame) -> DataFrame:
    """``(label, n)`` over labelled rows."""
    return (df.where(F.col("label").isNotNull())
            .groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def class_weights(df: DataFrame) -> DataFrame:
    """Balanced class weight ``labelled / (classes * n_label)``.

    Computed once on the whole input (the histogram has one row per class, so
    the global window below runs over a class-sized table, not over rows).
    """
    hist = label_histogram(df)
    everything = Window.partitionBy()
    return hist.select(
        "label", "n",
        (F.sum("n").over(everything).cast("double")
         / (F.count(F.lit(1)).over(everything) * F.col("n"))).alias("weight"))


def seed_signs(df: DataFrame) -> DataFrame:
    """``(grp, label, sign)``: labels of each unfinished group in ascending
    order alternate +1, -1, +1, ...; finished rows are ignored."""
    pairs = (df.where(F.col("label").isNotNull() & ~F.col("finished"))
             .select("grp", "label").distinct())
    rank = F.dense_rank().over(Window.partitionBy("grp").orderBy("label"))
    return pairs.select(
        "grp", "label",
        F.when(rank % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign"))


def majority_by_group(df: DataFrame) -> DataFrame:
    """C2 (per group): ``(grp, prediction)`` = most frequent label, ties to the
    smaller label.  ``max(struct(n, -label))`` is a partial aggregate, so no
    group is ever gathered in one task."""
    counts = (df.where(F.col("label").isNotNull())
              .groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy("grp").agg(
        F.max(F.struct(F.col("n"), (-F.col("label")).alias("neg"))).alias("best"))
    return best.select("grp", (-F.col("best.neg")).alias("prediction"))


def assign_labels(df: DataFrame) -> DataFrame:
    """Every row (labelled ones too) gets its group's majority label.

    A group without any labelled row gets ``prediction = NULL`` (the reference
    would fail on it)."""
    return join_small(df, majority_by_group(df), "grp", "left")
