"""Group bisection (B7-B12): iterate gradient steps until every group is stable,
then split each group by the sign of its score.

Two executions of the same loop, chosen per group by its vertex count:

* **distributed** (groups above ``local_group_rows``): one lock-step DataFrame
  plan per step; vertex and edge tables are bucketed on their join keys, and
  per-group counters live in a small table.  This is what the first iteration's
  single, all-rows group runs.
* **per group** (small groups): the graph and all steps of one group inside one
  task over its rows and kNN entries (numpy); :func:`bisect_local` takes vertices and edges.

Edges never leave a group, a group counts its own steps and a frozen group never
changes, so both give the same scores and step counts (tested).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import sign
from ..session import bucket_count, cut_lineage, discard, write_bucketed, write_table
from .graph import degrees, scaled_edges, symmetric_edges
from .labels import seed_signs
from .local import each_group
from .sizing import join_small, small_hint

DEFAULT_LOCAL_GROUP_ROWS = 20_000
#: A source with more edges is a hub (its edges are dealt by target).
HUB_EDGES = 100_000


def build_graph(df: DataFrame, knn: DataFrame):
    """``(vertices, scaled edges)`` for the unfinished rows of ``df``;
    ``knn`` is a long kNN table ``(id, nbr, grp, sim)``."""
    signs = seed_signs(df)
    v = df.where(~F.col("finished")).select("id", "grp", "label")
    v = join_small(v, signs, ["grp", "label"], "left")
    v = v.select("id", "grp", F.col("label").isNotNull().alias("lab"),
                 F.coalesce(F.col("sign"), F.lit(0.0)).alias("m"),
                 F.lit(0.0).alias("l"), F.lit(False).alias("frozen"))
    e = symmetric_edges(knn)
    return v, scaled_edges(e, degrees(e))


def _sgn(x: np.ndarray) -> np.ndarray:
    s = np.sign(x)
    s[np.isnan(s)] = 0
    return s


def _descend(n: int, src: np.ndarray, dst: np.ndarray, a: np.ndarray, lab: np.ndarray, m: np.ndarray,
             max_steps: int, max_stable: int, tol: float):
    """All steps of one group over positions: ``(scores, steps)``."""
    l = np.zeros(n)
    has_msg = np.bincount(dst, minlength=n) > 0
    stable, steps = 0, 0
    with np.errstate(divide="ignore", invalid="ignore"):
        while steps < max_steps and stable < max_stable:
            steps += 1
            s = np.bincount(dst, weights=a * m[src], minlength=n)
            l_new = np.where(has_msg, m - s, l)
            mass = np.sum(m * m)
            m2 = 1.0 / mass if mass > 0 else 0.0
            l2 = np.sum(m * l)
            raw = m - 2.0 * (m2 * l_new - m2 * m2 * l2 * m)
            new_m = raw.copy()
            for part in (lab, ~lab):
                if part.any():
                    new_m[part] = raw[part] - raw[part].mean()
            ratio = np.count_nonzero(_sgn(m) != _sgn(new_m)) / n
            stable = 0 if ratio > tol else stable + 1
            m, l = new_m, l_new
    return m, steps


def _make_local_fn(max_steps: int, max_stable: int, tol: float):
    def fn(vp: pd.DataFrame, ep: pd.DataFrame) -> pd.DataFrame:
        if len(vp) == 0:
            return pd.DataFrame({"id": [], "grp": [], "m": [], "steps": []})
        vp = vp.sort_values("id")
        ids = vp["id"].to_numpy(np.int64)
        n = len(ids)
        src = np.searchsorted(ids, ep["src"].to_numpy(np.int64))
        dst = np.searchsorted(ids, ep["dst"].to_numpy(np.int64))
        m, steps = _descend(n, src, dst, ep["a"].to_numpy(np.float64), vp["lab"].to_numpy(bool),
                            vp["m"].to_numpy(np.float64).copy(), max_steps, max_stable, tol)
        return pd.DataFrame({"id": ids, "grp": vp["grp"].to_numpy(np.int64), "m": m,
                             "steps": np.full(n, steps, dtype=np.int64)})

    return fn


_SCORE_SCHEMA = T.StructType([T.StructField("id", T.LongType()),
                              T.StructField("grp", T.LongType()),
                              T.StructField("m", T.DoubleType()),
                              T.StructField("steps", T.LongType())])


def bisect_local(v: DataFrame, e: DataFrame, max_steps: int = 1000, max_stable: int = 10,
                 tol: float = 0.005) -> DataFrame:
    """B9 per group in one task each: ``(id, grp, m, steps)``."""
    fn = _make_local_fn(max_steps, max_stable, tol)
    vv = v.select("grp", "id", "lab", "m")
    ee = e.select("grp", "src", "dst", "a")
    return vv.groupBy("grp").cogroup(ee.groupBy("grp")).applyInPandas(fn, _SCORE_SCHEMA)


def _score_local(df: DataFrame, knn: DataFrame, parts: int, max_steps: int, max_stable: int, tol: float) -> DataFrame:
    """G2-G6 and B9 of small groups, a group in one task: the graph of :func:`build_graph` from the rows and the kNN
    table, then all steps.  ``(id, grp, m, steps)``."""

    def solve(grp, table):
        is_row = table.column("nbr").is_null().to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        label = table.column("label").to_pandas()[is_row].to_numpy()
        order = np.argsort(ids[is_row], kind="stable")
        v, label = ids[is_row][order], label[order]
        n, lab = len(v), ~pd.isna(label)
        if not n:
            return None
        m = np.zeros(n)
        m[lab] = 1.0 - 2.0 * (np.unique(label[lab], return_inverse=True)[1] % 2)
        a, b = ids[~is_row], table.column("nbr").to_pandas()[~is_row].to_numpy(np.int64)
        w = table.column("sim").to_pandas()[~is_row].to_numpy(np.float64)
        # ids of the graph as numbers of their own, also those of rows that are not here
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = at[:len(a)], at[len(a):]
        pair, place = np.unique(np.concatenate([a * len(names) + b, b * len(names) + a]), return_inverse=True)
        w = np.bincount(place, weights=np.concatenate([w, w]), minlength=len(pair))
        if len(pair):
            a, b = np.divmod(pair, len(names))
        d = np.bincount(b, weights=w, minlength=len(names))
        with np.errstate(divide="ignore", invalid="ignore"):
            scaled = w / np.sqrt(d[a] * d[b])
        m, steps = _descend(n, np.searchsorted(v, names[a]), np.searchsorted(v, names[b]), scaled, lab, m, max_steps, max_stable, tol)
        return {"id": v, "grp": np.full(n, grp, np.int64), "m": m, "steps": np.full(n, steps, np.int64)}

    none = F.lit(None)
    rows = df.select("grp", "id", "label", none.cast("long").alias("nbr"), none.cast("double").alias("sim"))
    edges = knn.select("grp", "id", none.cast("long").alias("label"), "nbr", "sim")
    return each_group(rows.unionByName(edges), parts, solve, "id long, grp long, m double, steps long")


def _split_hubs(e: DataFrame, nb: int):
    """``(edges of ordinary sources, edges of hub sources, hub ids, their number)``; the second
    and third are None without hubs.  A hub has more than ``HUB_EDGES`` edges, so there are at
    most ``#edges / HUB_EDGES`` of them; their edges are never dealt by source."""
    hubs = write_table(e.groupBy("src").agg(F.count(F.lit(1)).alias("_n"))
                       .where(F.col("_n") > HUB_EDGES).select("src"), "hubs")
    n_hubs = hubs.count()
    if not n_hubs:
        return e, None, None, 0
    hubs = small_hint(hubs, n_hubs)
    return (e.join(hubs, "src", "left_anti"),
            cut_lineage(e.join(hubs, "src").repartition(max(nb, 2), "dst")), hubs, n_hubs)


def _messages(v: DataFrame, e: DataFrame, e_hub: DataFrame | None, hubs: DataFrame | None, n_hubs: int) -> DataFrame:
    """B1: ``(id, s)``: the scaled sum of the neighbours' scores."""
    act = v.select(F.col("id").alias("src"), F.col("m").alias("_mk"))
    parts = [e.join(act, "src").select("dst", (F.col("a") * F.col("_mk")).alias("_x"))]
    if e_hub is not None:
        parts.append(e_hub.join(small_hint(act.join(hubs, "src"), n_hubs), "src")
                     .select("dst", (F.col("a") * F.col("_mk")).alias("_x")))
    msg = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return msg.groupBy(F.col("dst").alias("id")).agg(F.sum("_x").alias("_s"))


def bisect_distributed(v: DataFrame, e: DataFrame, n_groups: int, max_steps: int = 1000,
                       max_stable: int = 10, tol: float = 0.005,
                       buckets: int | None = None) -> DataFrame:
    """B7-B9 in lock-step over all groups: ``(id, grp, m, steps)``.

    A step writes one vertex table (scores, Laplacian values before and after the
    message pass, and whether the step before changed the sign) and one table of a
    row per group.  The uncentred score is linear in ``m`` and ``l_new`` with one pair
    of factors per group, so its means over labelled and other rows follow from the sums
    of ``m``, ``l_new``, ``m^2`` and ``m l``; the centred score is a column expression that
    the next step reads.  The convergence test lags by a step: the sign changes of step
    ``t`` are summed in the aggregate of step ``t + 1``, so vertices are aggregated once a step.  By then the
    table holds the scores of step ``t``, so a group that proves stable loses nothing.

    A group's counter (B8) counts its own steps.  A group with ``max_stable``
    consecutive steps of a sign-change ratio of at most ``tol`` is moved to the
    output, and later steps do not read its vertices or edges any more.  Tables
    of superseded steps are dropped.
    """
    spark = v.sparkSession
    # the graph is computed once, whatever the plans behind v and e
    v = write_table(v.select("id", "grp", "lab", "m", F.col("l").cast("double").alias("l"), F.lit(False).alias("changed"),
                             F.lit(0).cast("bigint").alias("stable")), "vertices")
    whole = write_table(e.select("src", "dst", "a", "grp"), "edges")
    nb = buckets or bucket_count(spark, v.count())
    e, e_hub, hubs, n_hubs = _split_hubs(whole, nb)
    if nb > 1:
        # edges bucketed on src, vertices on id: the message join reads both
        # without an exchange
        e = write_bucketed(e.repartition(nb, "src"), "src", nb, "edges")

        def keep(frame):
            return write_bucketed(frame.repartition(nb, "id"), "id", nb, "step")
    else:
        e = e if e is whole else write_table(e, "edges")

        def keep(frame):
            return write_table(frame, "step")
    done, steps, written, state = [], 0, None, None
    while True:
        if steps < max_steps:
            j = v.join(_messages(v, e, e_hub, hubs, n_hubs), "id", "left").withColumn(
                "l_new", F.coalesce(F.col("m") - F.col("_s"), F.col("l"))).drop("_s")
        else:
            j = v.withColumn("l_new", F.col("l"))
        j = keep(j)
        # one row a group: the sums that both parts share, and those of each part
        lab, one = F.col("lab"), F.lit(1)
        sums = j.groupBy("grp").agg(
            F.count(one).alias("n"), F.sum(F.col("m") * F.col("m")).alias("smm"), F.sum(F.col("m") * F.col("l")).alias("sml"),
            F.sum(F.col("changed").cast("bigint")).alias("ch"), F.max("stable").alias("before"),
            *[F.sum(F.when(part, c)).alias(name + tag) for tag, part in (("1", lab), ("0", ~lab))
              for name, c in (("n", one), ("sm", F.col("m")), ("sl", F.col("l_new")))])
        m2 = F.when(F.col("smm") > 0, F.lit(1.0) / F.col("smm")).otherwise(F.lit(0.0))
        stable = F.when(F.lit(steps == 0) | (F.col("ch") / F.col("n") > tol), F.lit(0).cast("bigint")).otherwise(F.col("before") + 1)
        sums = (sums.withColumn("b", F.lit(-2.0) * m2).withColumn("a", F.lit(1.0) + F.lit(2.0) * m2 * m2 * F.col("sml"))
                .withColumn("stable", stable))
        mu = [((F.col("a") * F.col(f"sm{i}") + F.col("b") * F.col(f"sl{i}")) / F.col(f"n{i}")).alias(f"mu{i}") for i in (0, 1)]
        now = write_table(sums.select("grp", "a", "b", *mu, "stable", (
            (F.col("stable") >= max_stable) | F.lit(steps >= max_steps)).alias("done")), "state")
        for old in (written, state):
            if old is not None:
                discard(old)
        written, state = j, now
        if not now.where("done").isEmpty():
            ended = small_hint(now.where("done").select("grp"), n_groups)
            done.append(write_table(j.join(ended, "grp").select(
                "id", "grp", "m", F.lit(steps).cast("bigint").alias("steps")), "scores"))
            if now.where("not done").isEmpty():
                break
            live, old = small_hint(now.where("not done").select("grp"), n_groups), e
            left = e.join(live, "grp")
            if nb > 1:
                e = write_bucketed(left.repartition(nb, "src"), "src", nb, "edges")
            else:
                e = write_table(left, "edges")
            discard(old)
            if e_hub is not None:
                e_hub = cut_lineage(e_hub.join(live, "grp"))
        factors = now.where("not done").drop("done")
        mu = F.when(F.col("lab"), F.col("mu1")).otherwise(F.col("mu0"))
        new_m = F.col("a") * F.col("m") + F.col("b") * F.col("l_new") - mu
        v = j.drop("stable").join(small_hint(factors, n_groups), "grp").select(
            "id", "grp", "lab", new_m.alias("m"), F.col("l_new").alias("l"), (sign("m") != sign(new_m)).alias("changed"), "stable")
        steps += 1
    for old in (written, state, e):
        discard(old)
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def new_group_ids(scores: DataFrame, max_grp: int) -> DataFrame:
    """``m < 0`` keeps the group id; otherwise (>= 0 or NaN) the row moves
    to ``grp + max_grp + 1``."""
    keep = ~F.isnan("m") & (F.col("m") < 0)
    return scores.select("id", F.when(keep, F.col("grp"))
                         .otherwise(F.col("grp") + F.lit(max_grp) + 1).alias("new_grp"))


def merge_groups(df: DataFrame, new_ids: DataFrame) -> DataFrame:
    """Rows outside the graph keep their group."""
    j = df.join(new_ids, "id", "left")
    return j.withColumn("grp", F.coalesce(F.col("new_grp"), F.col("grp"))).drop("new_grp")


def score_groups(df: DataFrame, knn: DataFrame, max_steps: int = 1000, max_stable: int = 10,
                 tol: float = 0.005,
                 local_group_rows: int = DEFAULT_LOCAL_GROUP_ROWS) -> DataFrame:
    """B9 for all unfinished groups: ``(id, grp, m, steps)``; small groups per
    task, big ones distributed."""
    rows = df.where(~F.col("finished")).select("grp", "id", "label", "finished")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"))
    little = F.col("_n") <= local_group_rows
    total = sizes.agg(F.count(F.lit(1)).alias("g"), F.sum(little.cast("int")).alias("small"),
                      F.sum(F.when(little, F.col("_n"))).alias("rows")).first()
    n_groups, n_small = total["g"], total["small"] or 0
    parts = []
    if n_small:
        n = min(n_small, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["rows"] // 512))
    if n_small == n_groups:
        return (_score_local(rows, knn, n, max_steps, max_stable, tol) if n_small
                else rows.select("id", "grp", F.lit(0.0).alias("m"), F.lit(0).cast("bigint").alias("steps")))
    # explicit hints: joining rows to a group list on ``grp`` must never shuffle
    # the rows by group (the first iteration has a single group)
    small = small_hint(write_table(sizes, "sizes").where(little).select("grp"), n_groups)
    if n_small:
        parts.append(_score_local(rows.join(small, "grp", "left_semi"), knn.join(small, "grp", "left_semi"), n,
                                  max_steps, max_stable, tol))
        rows, knn = rows.join(small, "grp", "left_anti"), knn.join(small, "grp", "left_anti")
    parts.append(bisect_distributed(*build_graph(rows, knn), n_groups, max_steps, max_stable, tol))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def divide_groups(df: DataFrame, knn: DataFrame, max_steps: int = 1000, max_stable: int = 10,
                  tol: float = 0.005,
                  local_group_rows: int = DEFAULT_LOCAL_GROUP_ROWS) -> DataFrame:
    """Split every unfinished group in two by the sign of its score."""
    max_grp = df.agg(F.max("grp")).first()[0]
    scores = score_groups(df, knn, max_steps, max_stable, tol, local_group_rows)
    return merge_groups(df, write_table(new_group_ids(scores, max_grp), "new_groups"))
