"""ReliefF feature weights per group (R1-R12), as joins, windows and aggregates.

The reference collects every labelled row to the driver and loops there.  Here:

* R2 ranges: element-wise ``min``/``max`` per group as a JVM vector aggregate.
* R5 priors: counts per (group, class).
* R6 probes: the ``m`` rows with the smallest seeded hash per group, found by a
  salted two-phase top-m (no window ever spans a whole hot group).
* R7/R8 hits and misses: :func:`graphssl.operators.knn.blocked_top_k` with the
  range-normalised Manhattan distance, top-k per (probe, class).
* R9 accumulation: one signed coefficient per winner; the winners meet their two
  vectors again, and one vector sum of the scaled differences per group follows.
* R10 scaling/bias and R12 application: per-group tables joined back with a
  size-checked broadcast.

Deliberate differences (documented in the README): a zero-range feature adds 0
to distances; a group with a single class, or whose weights are all <= 0, gets
all-ones weights; the probe sample is seeded and deterministic.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import multiply, ones
from ..session import write_table
from . import local
from .knn import DEFAULT_BLOCK_ROWS, blocked_top_k
from .sizing import join_small, small_hint

#: Bias of the reference's final re-scaling (fixed value).
RELIEF_BIAS = 0.1
#: Rows per salt bucket in the two-phase probe sampling.
_SAMPLE_SALT_ROWS = 1 << 16
#: Salts that one phase merges.
_SALT_FAN = 64
#: Feature differences (probes x labelled rows x features) of a group that one task may take.
LOCAL_DIFFERENCES = 1 << 31


def labelled_rows(df: DataFrame) -> DataFrame:
    """Labelled rows of unfinished groups."""
    cond = F.col("label").isNotNull()
    if "finished" in df.columns:
        cond = cond & ~F.col("finished")
    return df.where(cond).select("grp", "id", "label", "features")


def feature_ranges(lab: DataFrame) -> DataFrame:
    """R2: ``(grp, pos, min, max, range)`` per feature over labelled rows.

    Element-wise min/max run as one JVM vector aggregate per group
    (``Summarizer``, partial aggregation) -- rows are not exploded per feature;
    only the small per-group result is."""
    summ = lab.groupBy("grp").agg(
        Summarizer.metrics("min", "max").summary(array_to_vector("features")).alias("_s"))
    per_grp = summ.select("grp", vector_to_array("_s.min").alias("_mn"),
                          vector_to_array("_s.max").alias("_mx"))
    ex = per_grp.select("grp", F.posexplode(F.arrays_zip("_mn", "_mx")).alias("pos", "_p"))
    return ex.select("grp", "pos", F.col("_p._mn").alias("min"), F.col("_p._mx").alias("max")) \
        .withColumn("range", F.col("max") - F.col("min"))


def range_vectors(ranges: DataFrame) -> DataFrame:
    """``(grp, rng array<double>)`` in feature order."""
    return ranges.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct("pos", "range"))).alias("_r")
    ).select("grp", F.transform("_r", lambda s: s["range"]).alias("rng"))


def class_priors(lab: DataFrame) -> DataFrame:
    """``(grp, label, n, prior)``; ``prior = n / labelled rows of the group``."""
    counts = lab.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy("grp"))
    return counts.withColumn("prior", F.col("n") / tot)


def sample_key(id_col, seed: int):
    """A multiplicative mix of ``id`` and ``seed`` modulo the prime 2^31 - 1 (integer
    arithmetic only, so plain SQL can reproduce the sample)."""
    p = F.lit(2147483647).cast("bigint")
    first = F.pmod(F.pmod(id_col, p) * F.lit(48271) + F.lit(seed % 2147483647 + 1), p)
    return F.pmod(first * F.lit(69621), p)


def sample_probes(lab: DataFrame, m: int | None, seed: int = 0) -> DataFrame:
    """``min(m, n)`` rows per group without replacement, chosen by the
    smallest :func:`sample_key` (deterministic; ``m=None`` keeps all).

    Phase 1 keeps the best ``m`` per (group, salt) where the salt count grows
    with the group; each further phase keeps the best ``m`` of ``_SALT_FAN`` salts,
    until one is left.  So the widest window holds ``_SALT_FAN * m`` rows for every
    ``m``, never a whole hot group.
    """
    if m is None:
        return lab
    sized = lab.withColumn("_h", sample_key(F.col("id"), seed))
    nsalt = lab.groupBy("grp").agg(
        F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / F.lit(_SAMPLE_SALT_ROWS)))
        .cast("bigint").alias("_ns"))
    salts = nsalt.agg(F.max("_ns")).first()[0] or 1
    kept = join_small(sized, nsalt, "grp", "inner").withColumn(
        "_salt", F.pmod(F.col("_h"), F.col("_ns")))
    w = Window.partitionBy("grp", "_salt").orderBy("_h", "id")
    while True:
        kept = kept.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= m)
        if salts == 1:
            return kept.drop("_h", "_ns", "_salt", "_r")
        salts = -(-salts // _SALT_FAN)
        kept = kept.withColumn("_salt", F.floor(F.col("_salt") / _SALT_FAN))


def relief_neighbours(lab: DataFrame, probes: DataFrame, rng: DataFrame, k: int,
                      block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """R7 + R8: for every probe the ``k`` nearest labelled rows of each class
    (its own class = hits, the probe itself excluded by id; other classes =
    misses).  ``(grp, qid, qlabel, cid, clabel, dist, rank)``: ids and distances only."""
    dim = lab.select(F.size("features")).first()
    q = join_small(probes.select("grp", F.col("id").alias("qid"),
                                 F.col("label").alias("qlabel"),
                                 F.col("features").alias("qvec")), rng, "grp", "inner",
                   row_cells=dim[0] if dim else 1)
    c = lab.select("grp", F.col("id").alias("cid"), F.col("label").alias("clabel"),
                   F.col("features").alias("cvec"))
    return blocked_top_k(q, c, k, metric="relief", per_label=True, exclude_self=True,
                         block_rows=block_rows)


def raw_weights(nbrs: DataFrame, probes: DataFrame, lab: DataFrame, priors: DataFrame, rng: DataFrame) -> DataFrame:
    """``(grp, pos, w)`` before scaling.

    Only here the winners of R7 and R8 meet their vectors again: one join for the
    probe's, one for the neighbour's.  The differences are summed per group and
    divided by the ranges after that.

    Per probe ``p`` of class ``c``: every hit adds ``-diff / (m * #hits)``,
    every miss of class ``C`` adds ``P(C) / (1 - P(c)) * diff / (m * avg)`` with
    ``avg = floor(#misses / (#classes - 1))`` (no term when it is 0);
    ``m`` = probes in the group.  Single-class groups produce no rows.
    """
    per_grp = probes.groupBy("grp").agg(F.count(F.lit(1)).alias("m_eff")).join(
        priors.groupBy("grp").agg(F.count(F.lit(1)).alias("n_classes")), "grp")
    per_grp = per_grp.where(F.col("n_classes") > 1)
    pq = priors.select("grp", F.col("label").alias("qlabel"), F.col("prior").alias("p_q"))
    pc = priors.select("grp", F.col("label").alias("clabel"), F.col("prior").alias("p_c"))
    pw = Window.partitionBy("grp", "qid")
    hit = F.col("clabel") == F.col("qlabel")
    x = (nbrs.withColumn("_hit", hit)
         .withColumn("n_hits", F.sum(F.when(hit, 1).otherwise(0)).over(pw))
         .withColumn("n_miss", F.sum(F.when(hit, 0).otherwise(1)).over(pw)))
    x = join_small(x, per_grp, "grp", "inner")
    x = join_small(x, pq, ["grp", "qlabel"], "left")
    x = join_small(x, pc, ["grp", "clabel"], "left")
    avg = F.floor(F.col("n_miss") / (F.col("n_classes") - 1))
    coef = F.when(F.col("_hit"), F.lit(-1.0) / (F.col("m_eff") * F.col("n_hits"))).otherwise(
        F.when(avg > 0, F.col("p_c") / (F.lit(1.0) - F.col("p_q"))
               / (F.col("m_eff") * avg)).otherwise(F.lit(0.0)))
    x = (x.select("grp", "qid", "cid", coef.alias("coef")).where("coef != 0")
         .join(probes.select(F.col("id").alias("qid"), F.col("features").alias("_q")), "qid")
         .join(lab.select(F.col("id").alias("cid"), F.col("features").alias("_c")), "cid"))
    # One vector sum per group: the rows are never exploded by feature.
    scaled = array_to_vector(F.zip_with("_q", "_c", lambda a, b: F.abs(a - b) * F.col("coef")))
    per = x.groupBy("grp").agg(vector_to_array(Summarizer.metrics("sum").summary(scaled)["sum"]).alias("_w"))
    dim = lab.select(F.size("features")).first()
    per = join_small(per, rng, "grp", "inner", row_cells=dim[0] if dim else 1)
    per = per.select("grp", F.zip_with("_w", "rng", lambda w, r: F.when(r > 0, w / r).otherwise(F.lit(0.0))).alias("_w"))
    # a group whose terms all vanish (no other class is near) keeps a weight per feature
    none = per_grp.join(per, "grp", "left_anti").join(rng, "grp").select(
        "grp", F.transform("rng", lambda r: F.lit(0.0)).alias("_w"))
    return per.unionByName(none).select("grp", F.posexplode("_w").alias("pos", "w"))


def scale_weights(raw: DataFrame, bias: float = RELIEF_BIAS) -> DataFrame:
    """NaN -> 0, divide by the group maximum, bias and clip at 0:
    ``max(0, (w / max + bias) / (1 + bias))``; a maximum <= 0 gives ones."""
    w = F.when(F.isnan("w"), F.lit(0.0)).otherwise(F.col("w"))
    clean = raw.select("grp", "pos", w.alias("w"))
    mx = F.max("w").over(Window.partitionBy("grp"))
    scaled = F.greatest(F.lit(0.0), (F.col("w") / F.col("_mx") + F.lit(bias)) / F.lit(1.0 + bias))
    return clean.withColumn("_mx", mx).select(
        "grp", "pos", F.when(F.col("_mx") > 0, scaled).otherwise(F.lit(1.0)).alias("weight"))


def _local_weights(lab: DataFrame, parts: int, m: int | None, k: int, seed: int, bias: float) -> DataFrame:
    """R2-R10 of small groups, a group in one task: ``(grp, pos, weight)``."""

    def solve(grp, table):
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        w = local.relief(ids[order], local.matrix(table.column("features").chunk(0))[order], table.column("label").to_numpy()[order],
                         m, k, seed, bias)
        return None if w is None else {"grp": np.full(len(w), grp, np.int64), "pos": np.arange(len(w), dtype=np.int32), "weight": w}

    return local.each_group(lab, parts, solve, "grp long, pos int, weight double")


def relief_weights(df: DataFrame, m: int | None = None, k: int = 3, seed: int = 0,
                   bias: float = RELIEF_BIAS,
                   block_rows: int = DEFAULT_BLOCK_ROWS, local_rows: int = 0) -> DataFrame:
    """``(grp, pos, weight)`` for every unfinished group with >= 2 classes.

    The labelled rows (a small share of the state) and the per-class priors
    are persisted for the duration of the computation, so the size checks and
    the several consumers do not re-read the whole state; the result (one row
    per group and feature) is written before they are released.

    Groups of at most ``local_rows`` labelled rows (unique ids), and of few enough
    differences, are solved in one task each (:func:`graphssl.operators.local.relief`).
    """
    rows, parts = labelled_rows(df), []
    if local_rows:
        sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("features")).alias("_d"))
        probes = F.col("_n") if m is None else F.least(F.col("_n"), F.lit(m))
        small = (F.col("_n") <= local_rows) & (F.col("_n") * probes * F.col("_d") <= LOCAL_DIFFERENCES)
        total = sizes.agg(F.count(F.lit(1)).alias("g"), F.sum(F.when(small, 1).otherwise(0)).alias("small_g"),
                          F.sum(F.when(small, F.col("_n")).otherwise(0)).alias("small_n")).first()
        whole = total["small_g"] == total["g"]
        little = None if whole else small_hint(write_table(sizes, "sizes").where(small).select("grp"), total["g"])
        if total["small_g"]:
            n = min(total["small_g"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["small_n"] // 128))
            parts.append(_local_weights(rows if whole else rows.join(little, "grp", "left_semi"), n, m, k, seed, bias))
        if whole and parts:
            return write_table(parts[0], "weights")
        rows = rows if whole else rows.join(little, "grp", "left_anti")
    lab = rows.persist()
    priors = class_priors(lab).persist()
    try:
        probes = sample_probes(lab, m, seed)
        rng = range_vectors(feature_ranges(lab))
        nbrs = relief_neighbours(lab, probes, rng, k, block_rows)
        parts.append(scale_weights(raw_weights(nbrs, probes, lab, priors, rng), bias))
        out = write_table(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), "weights")
    finally:
        priors.unpersist()
        lab.unpersist()
    return out


def weight_vectors(weights: DataFrame) -> DataFrame:
    """``(grp, weights array<double>)`` in feature order."""
    return weights.groupBy("grp").agg(
        F.sort_array(F.collect_list(F.struct("pos", "weight"))).alias("_w")
    ).select("grp", F.transform("_w", lambda s: s["weight"]).alias("weights"))


def apply_weights(df: DataFrame, weights: DataFrame) -> DataFrame:
    """``features * weights`` of the row's group; groups without weights
    (finished, single-class, no labels) keep their features (weights of one)."""
    vec = weight_vectors(weights)
    dim = df.select(F.size("features")).first()
    j = join_small(df, vec, "grp", "left", row_cells=dim[0] if dim else 1)
    w = F.coalesce(F.col("weights"), ones(F.size("features")))
    return j.withColumn("features", multiply("features", w)).drop("weights")


def weight_features(df: DataFrame, m: int | None = None, k: int = 3, seed: int = 0,
                    block_rows: int = DEFAULT_BLOCK_ROWS, local_rows: int = 0) -> DataFrame:
    """R11 + R12 composed: weights from unfinished labelled rows, applied to all."""
    return apply_weights(df, relief_weights(df, m, k, seed, block_rows=block_rows, local_rows=local_rows))
