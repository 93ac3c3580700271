"""Evaluation metrics (M1-M4) as single-pass aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_truth(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Inner equi-join of predictions and ground truth on ``id``."""
    return pred.join(truth.select("id", "correct_label"), "id", "inner")


def success_rate(df: DataFrame) -> DataFrame:
    """M1: accuracy over the *originally unlabelled* rows; NULL when none."""
    unl = F.col("label").isNull()
    return df.agg(
        F.sum(F.when(unl, 1).otherwise(0)).cast("bigint").alias("n_unlabelled"),
        F.sum(F.when(unl & (F.col("prediction") == F.col("correct_label")), 1)
              .otherwise(0)).cast("bigint").alias("n_correct"),
    ).select("n_unlabelled", "n_correct",
             F.try_divide(F.col("n_correct").cast("double"),
                          F.col("n_unlabelled").cast("double")).alias("success_rate"))


def confusion(df: DataFrame) -> DataFrame:
    """M2: binary confusion counts over all rows; any label other than 0/1
    raises (two-class metric, as in the reference)."""
    p, t = F.col("prediction"), F.col("correct_label")
    checked = F.when(p.isin(0, 1) & t.isin(0, 1), F.lit(1)).otherwise(
        F.raise_error(F.lit("labels and predictions have to be 0 or 1 here")))

    def n(cond):      # ``checked`` is evaluated for every row, so a third class raises
        return F.sum(F.when(cond, 1).otherwise(0) * checked).cast("bigint")

    return df.agg(n((t == 1) & (p == 1)).alias("tp"), n((t == 0) & (p == 1)).alias("fp"),
                  n((t == 0) & (p == 0)).alias("tn"), n((t == 1) & (p == 0)).alias("fn"))


def g_mean(df: DataFrame) -> DataFrame:
    """M3: ``sqrt(sensitivity * specificity)`` from M2."""
    c = confusion(df)
    sens = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double"))
    spec = F.try_divide(F.col("tn").cast("double"), (F.col("tn") + F.col("fp")).cast("double"))
    return c.select("tp", "fp", "tn", "fn", sens.alias("sensitivity"),
                    spec.alias("specificity"), F.sqrt(sens * spec).alias("g_mean"))


def neighbour_recall(found: DataFrame, expected: DataFrame) -> DataFrame:
    """M4: mean over rows of the share of found neighbours that are also in the
    expected graph.  Both are long edge tables ``(id, nbr)``."""
    hit = (found.select("id", "nbr").distinct()
           .join(expected.select("id", "nbr").distinct().withColumn("_hit", F.lit(1)),
                 ["id", "nbr"], "left"))
    per_row = hit.groupBy("id").agg(
        (F.sum(F.coalesce("_hit", F.lit(0))) / F.count(F.lit(1))).alias("share"))
    return per_row.agg(F.count(F.lit(1)).alias("n_rows"), F.avg("share").alias("recall"))
