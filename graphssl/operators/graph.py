"""Graph tables and one bisection step (G2-G6, B1-B6) as DataFrame joins.

GraphX has no Python API; a graph here is a vertex table
``(id, grp, lab, m, l, frozen)`` plus an edge table ``(src, dst, a)`` where
``a = w / sqrt(D_src * D_dst)`` is pre-scaled once per outer iteration.  One
gradient step on the normalised-cut objective (the Rayleigh quotient
``M'LM / M'M`` of the symmetric normalised Laplacian) is:

1. B1 messages: edges joined to active vertices on ``src``, summed per ``dst``
   (partial aggregation), joined back on ``id``:  ``l = m - sum`` (a vertex
   that receives nothing keeps its previous ``l``).
2. B2 group moments ``1/sum(m^2)`` and ``sum(m * l_previous)`` -- one tiny
   aggregate per group, broadcast back after a size check.
3. B3 ``grad = 2 (m2 l - m2^2 l2 m)``, ``new_m = m - grad``.
4. B4 centring of labelled and unlabelled vertices separately (per-(group,
   labelled) means, broadcast back), B5 frozen groups keep ``m``.
5. B6 sign changes per group, as an exact aggregate.

Every per-group table has one or two rows per group; the row tables are only
ever joined on the unique vertex id, so a hot group never meets one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import sign
from .sizing import BROADCAST_MAX_ROWS


def _join_known(big: DataFrame, small: DataFrame, on, how: str, small_rows: int) -> DataFrame:
    """Join a per-group table whose row count is already known to the caller."""
    return big.join(F.broadcast(small) if small_rows <= BROADCAST_MAX_ROWS else small, on, how)


def symmetric_edges(knn: DataFrame) -> DataFrame:
    """Both directions of every kNN edge; a mutual pair keeps both copies,
    summed into one edge (``(src, dst, grp, w)``)."""
    fwd = knn.select(F.col("id").alias("src"), F.col("nbr").alias("dst"), "grp",
                     F.col("sim").alias("w"))
    bwd = knn.select(F.col("nbr").alias("src"), F.col("id").alias("dst"), "grp",
                     F.col("sim").alias("w"))
    return fwd.unionByName(bwd).groupBy("src", "dst", "grp").agg(F.sum("w").alias("w"))


def degrees(edges: DataFrame) -> DataFrame:
    """Weighted in-degree ``(id, d)``."""
    return edges.groupBy(F.col("dst").alias("id")).agg(F.sum("w").alias("d"))


def scaled_edges(edges: DataFrame, deg: DataFrame) -> DataFrame:
    """Edges with ``a = w / sqrt(D_src * D_dst)`` (both joins on the unique id)."""
    ds = deg.select(F.col("id").alias("src"), F.col("d").alias("d_src"))
    dd = deg.select(F.col("id").alias("dst"), F.col("d").alias("d_dst"))
    e = edges.join(ds, "src").join(dd, "dst")
    return e.select("src", "dst", "grp",
                    (F.col("w") / F.sqrt(F.col("d_src") * F.col("d_dst"))).alias("a"))


def laplacian(v: DataFrame, e: DataFrame) -> DataFrame:
    """B1: adds ``l_new = m - sum_k a_ik m_k`` over active sources; vertices
    without any message keep ``l``."""
    act = v.where(~F.col("frozen")).select(F.col("id").alias("src"), F.col("m").alias("_mk"))
    msg = (e.join(act, "src").groupBy(F.col("dst").alias("id"))
           .agg(F.sum(F.col("a") * F.col("_mk")).alias("_s")))
    return (v.join(msg, "id", "left")
            .withColumn("l_new", F.coalesce(F.col("m") - F.col("_s"), F.col("l")))
            .drop("_s"))


def moments(v: DataFrame) -> DataFrame:
    """B2: ``(grp, m2 = 1/sum(m^2), l2 = sum(m * l))`` with the *stored* l; a group
    without mass has ``m2 = 0`` (its scores do not move)."""
    mass = F.sum(F.col("m") * F.col("m"))
    return v.groupBy("grp").agg(
        F.when(mass > 0, F.lit(1.0) / mass).otherwise(F.lit(0.0)).alias("m2"),
        F.sum(F.col("m") * F.col("l")).alias("l2"))


def gradient(v1: DataFrame, mom: DataFrame, n_groups: int) -> DataFrame:
    """``grad`` and the uncentred ``raw = m - grad``."""
    j = _join_known(v1, mom, "grp", "inner", n_groups)
    grad = F.lit(2.0) * (F.col("m2") * F.col("l_new")
                         - F.col("m2") * F.col("m2") * F.col("l2") * F.col("m"))
    return j.withColumn("grad", grad).withColumn("raw", F.col("m") - F.col("grad")) \
        .drop("m2", "l2")


def centre(v2: DataFrame, n_groups: int) -> DataFrame:
    """B4 + B5 + B6: centre per (group, labelled), frozen keeps ``m``, flag sign
    changes (NaN counts as sign 0)."""
    means = v2.groupBy("grp", "lab").agg(F.avg("raw").alias("_mu"))
    j = _join_known(v2, means, ["grp", "lab"], "inner", 2 * n_groups)
    new_m = F.when(F.col("frozen"), F.col("m")).otherwise(F.col("raw") - F.col("_mu"))
    return (j.withColumn("new_m", new_m).drop("_mu")
            .withColumn("changed", sign("m") != sign("new_m")))


def step_frame(v: DataFrame, e: DataFrame, n_groups: int) -> DataFrame:
    """B7 without materialisation: one full step as a single lazy plan."""
    v1 = laplacian(v, e)
    return centre(gradient(v1, moments(v), n_groups), n_groups)


def sign_changes(step: DataFrame) -> DataFrame:
    """``(grp, n, n_changed, ratio)`` per group."""
    return step.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("changed").cast("bigint")).alias("n_changed")
    ).withColumn("ratio", F.col("n_changed") / F.col("n"))
