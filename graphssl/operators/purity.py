"""Row state, class-balanced Gini purity and the stopping rule.

The reference runs three separate jobs and three driver collects for one stop
test.  Here it is **one** aggregation over ``(grp, label)`` (partial
aggregation map-side; its output has one row per group and class), a second
tiny aggregation per group, and a size-checked broadcast join back onto rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sizing import bounded, join_small


def init_state(df: DataFrame) -> DataFrame:
    """Every row starts in group 0 and is not finished."""
    return df.withColumn("grp", F.lit(0).cast("bigint")).withColumn(
        "finished", F.lit(False))


def group_label_mass(df: DataFrame, weights: DataFrame) -> DataFrame:
    """P5: ``(grp, label, n, mass)`` over unfinished rows; ``mass = n * w[label]``
    (``label``/``mass`` are NULL for the unlabelled count of a group)."""
    per_label = (df.where(~F.col("finished"))
                 .groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n")))
    w = bounded(weights).select("label", "weight")
    return (per_label.join(w, "label", "left")
            .select("grp", "label", "n", (F.col("n") * F.col("weight")).alias("mass")))


def group_stats(df: DataFrame, weights: DataFrame) -> DataFrame:
    """P4 + P6: per unfinished group ``n_unlabelled, n_labelled, mass, purity,
    impurity``.  ``purity = sum(mass_l^2) / (sum mass_l)^2``; NULL without
    labelled rows."""
    m = group_label_mass(df, weights)
    agg = m.groupBy("grp").agg(
        F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_unlabelled"),
        F.sum(F.when(F.col("label").isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("n_labelled"),
        F.sum("mass").alias("mass"),
        F.sum(F.col("mass") * F.col("mass")).alias("mass_sq"))
    purity = F.try_divide(F.col("mass_sq"), F.col("mass") * F.col("mass"))
    return agg.select("grp", "n_unlabelled", "n_labelled", "mass",
                      purity.alias("purity"), (F.lit(1.0) - purity).alias("impurity"))


def finished_rule(max_gini: float, k: int):
    """P7 rule over :func:`group_stats` columns (order as in the reference):
    nothing unlabelled -> done; fewer than ``2k`` rows -> done; else impurity
    strictly below ``max_gini``.  A group with no labelled row is done (NULL
    impurity), where the reference would fail."""
    return ((F.col("n_unlabelled") == 0)
            | ((F.col("n_labelled") + F.col("n_unlabelled")) < 2 * k)
            | F.coalesce(F.col("impurity") < F.lit(max_gini), F.lit(True)))


def group_finished(df: DataFrame, weights: DataFrame, max_gini: float = 0.1,
                   k: int = 5) -> DataFrame:
    """Per unfinished group: the stats plus the new ``finished`` flag."""
    st = group_stats(df, weights)
    return st.withColumn("finished", finished_rule(max_gini, k))


def compute_finished(df: DataFrame, weights: DataFrame, max_gini: float = 0.1,
                     k: int = 5) -> DataFrame:
    """Re-evaluate the stopping rule; finished rows stay finished."""
    flags = group_finished(df, weights, max_gini, k).select(
        "grp", F.col("finished").alias("_done"))
    cols = [c for c in df.columns]
    out = join_small(df, flags, "grp", "left")
    return out.select(*[
        (F.col("finished") | F.coalesce(F.col("_done"), F.lit(False))).alias("finished")
        if c == "finished" else F.col(c) for c in cols])


def all_finished_frame(df: DataFrame) -> DataFrame:
    """P8 as a one-row frame ``(all_finished boolean)``."""
    return df.agg(F.coalesce(F.bool_and("finished"), F.lit(True)).alias("all_finished"))


def is_finished(df: DataFrame) -> bool:
    """True when no row is unfinished (stops at the first unfinished row)."""
    return df.where(~F.col("finished")).isEmpty()
