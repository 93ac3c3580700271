"""k-nearest-neighbour search inside groups (G1, and R7/R8 for ReliefF).

Blocked top-k
-------------
Query rows and candidate rows of one group are hashed into blocks of
``block_rows`` rows on average.  Each (group, query block, candidate block) triple is one
cogroup task: numpy computes the block's distances in Arrow batches and emits
only the local top-k per query (and per candidate label when asked).  A final
``row_number`` window over ``(grp, qid[, clabel])`` -- a window over at most
``#candidate blocks * k`` rows per query -- keeps the global top-k.

* A hot group (the first iteration puts every row in group 0) is spread over
  ``#qblocks * #cblocks`` tasks; no task ever holds more than two blocks.
* What is shuffled is each row once per block of the other side, plus ``k``
  rows per query and block -- never all pairs.
* With a small probe side (ReliefF with a bounded ``m``) there is a single
  query block, so candidates are not replicated at all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table
from .sizing import bounded, small_hint

DEFAULT_BLOCK_ROWS = 1024
# float64 cells one distance chunk may hold (rows x candidates x features)
_CHUNK_CELLS = 1 << 22
# cells of a matrix product that one screening step looks at
SCREEN_CELLS = 1 << 19


def _stack(col: pd.Series) -> np.ndarray:
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in col.values])


def _block_distances(Q: np.ndarray, C: np.ndarray, metric: str,
                     rng: np.ndarray | None) -> np.ndarray:
    """Dense distance matrix ``|Q| x |C|`` computed in bounded chunks."""
    nq, nc = Q.shape[0], C.shape[0]
    d = max(1, Q.shape[1])
    out = np.empty((nq, nc))
    step = max(1, _CHUNK_CELLS // max(1, nc * d))
    if metric == "relief":
        r = np.asarray(rng, dtype=np.float64)
        safe = np.where(r > 0, r, 1.0)
        zero = r <= 0
    for s in range(0, nq, step):
        diff = np.abs(Q[s:s + step, None, :] - C[None, :, :])
        if metric == "euclidean":
            out[s:s + step] = np.sqrt((diff * diff).sum(axis=2))
        else:
            nd = diff / safe
            nd[..., zero] = 0.0
            out[s:s + step] = nd.sum(axis=2)
    return out


def _top_k_rows(D: np.ndarray, cid: np.ndarray, k: int):
    """Row-wise k smallest by (distance, candidate id): ``(row idx, col idx)``, in order.

    Only entries up to the row's k-th smallest distance are sorted."""
    if D.shape[1] == 0 or D.shape[0] == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = min(k, D.shape[1]) - 1
    limit = np.partition(D, at, axis=1)[:, at:at + 1]
    rows, cols = np.nonzero((D <= limit) & np.isfinite(D))
    order = np.lexsort((cid[cols], D[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(D.shape[0]))
    keep = np.arange(len(rows)) - first[rows] < k
    return rows[keep], cols[keep]


def screen_slack(qq: np.ndarray, cc: np.ndarray, d: int) -> np.ndarray:
    """Per query, a bound of the rounding error of squared distances that come from a matrix product."""
    return 8 * np.finfo(np.float64).eps * (d + 8) * (qq + cc.max(initial=0.0))


def squares(A: np.ndarray, aa: np.ndarray, B: np.ndarray, bb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two matrices whose product is that of all squared distances."""
    return (np.column_stack([-2.0 * A, aa, np.ones(len(A))]),
            np.ascontiguousarray(np.column_stack([B, np.ones(len(B)), bb]).T))


def copies(X: np.ndarray) -> np.ndarray:
    """A number per row that rows of equal bytes share."""
    if not X.size:
        return np.zeros(len(X), np.int64)
    whole = np.ascontiguousarray(X).view(np.dtype((np.void, X.dtype.itemsize * X.shape[1])))
    return np.unique(whole.ravel(), return_inverse=True)[1].reshape(-1)


def few_copies(same: np.ndarray, cid: np.ndarray, k: int) -> np.ndarray:
    """Positions, ascending, of the candidates that fewer than ``k`` copies with smaller ids stand before."""
    order = np.lexsort((cid, same))
    s = same[order]
    return np.sort(order[np.arange(len(s)) - np.searchsorted(s, s) < k])


def pair_distances(Q: np.ndarray, C: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of single pairs, as :func:`_block_distances` has them."""
    out = np.empty(len(r))
    step = max(1, _CHUNK_CELLS // max(1, Q.shape[1]))
    for s in range(0, len(r), step):
        diff = Q[r[s:s + step]] - C[c[s:s + step]]
        out[s:s + step] = np.sqrt((diff * diff).sum(axis=1))
    return out


def best_k(r: np.ndarray, dist: np.ndarray, cid: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` entries of every ``r`` that are first by ``(dist, cid)``, in that order."""
    order = np.lexsort((cid, dist, r))
    order = order[np.isfinite(dist[order])]
    rows = r[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def nearest(Q: np.ndarray, C: np.ndarray, cid: np.ndarray, k: int, not_q: np.ndarray, not_c: np.ndarray,
            same: np.ndarray | None = None):
    """``(row, column, dist)`` of the ``k`` nearest candidates of every query by ``(dist, cid)``, Euclidean; a
    candidate whose ``not_c`` equals the query's ``not_q`` is none of its own.  ``same``: :func:`copies` of ``C``.

    A matrix product screens: what can be among the ``k`` by more than rounding gets its distance from the
    differences, so distances and ties are those of :func:`_block_distances`."""
    if not len(Q) or not len(C):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    with np.errstate(over="ignore", invalid="ignore"):
        qq, cc = (Q * Q).sum(axis=1), (C * C).sum(axis=1)
    if not (np.isfinite(qq).all() and np.isfinite(cc).all()):
        D = _block_distances(Q, C, "euclidean", None)
        D[not_q[:, None] == not_c[None, :]] = np.inf
        r, c = _top_k_rows(D, cid, k)
        return r, c, D[r, c]
    _, times = np.unique(not_c, return_counts=True)
    kept = few_copies(copies(C) if same is None else same, cid, k + int(times.max()))
    C, cc, cid, own = C[kept], cc[kept], cid[kept], not_c[kept]
    by_own = np.argsort(own, kind="stable")
    low, high = (np.searchsorted(own[by_own], not_q, side) for side in ("left", "right"))
    slack, step, parts = screen_slack(qq, cc, Q.shape[1]), max(1, SCREEN_CELLS // len(C)), []
    at, left, right = min(k, len(C)) - 1, *squares(Q, qq, C, cc)
    for s in range(0, len(Q), step):
        S = left[s:s + step] @ right
        n = (high - low)[s:s + step]
        mine = np.repeat(np.arange(len(S)), n)
        S[mine, by_own[np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[s:s + step], n)]] = np.inf
        limit = np.minimum(np.partition(S, at, axis=1)[:, at] + 2 * slack[s:s + step], np.finfo(np.float64).max)
        r, c = np.divmod(np.flatnonzero(S <= limit[:, None]), S.shape[1])
        dist = pair_distances(Q[s:s + step], C, r, c)
        first = best_k(r, dist, cid[c], k)
        parts.append((r[first] + s, kept[c[first]], dist[first]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _rough_relief(Q: np.ndarray, C: np.ndarray, rng: np.ndarray):
    """``(range-normalised Manhattan distances in float32, a bound of their error)``; None if a value is not finite."""
    safe, some = np.where(rng > 0, rng, 1.0), ~(rng <= 0)
    with np.errstate(all="ignore"):
        mid = C.mean(axis=0)
        q, c = ((X[:, some] - mid[some]) / safe[some] for X in (Q, C))
        widest = max(np.abs(x).max(axis=0, initial=0.0).sum() for x in (q, c))
        moved = 4 * np.finfo(np.float64).eps * (np.abs(np.concatenate([Q[:1], C[:1], mid[None]])).max(axis=0)[some] / safe[some]).sum()
    if not np.isfinite(widest) or widest > 1e30 or not np.isfinite(moved):
        return None
    q, c = q.astype(np.float32), np.ascontiguousarray(c.T.astype(np.float32))
    out = np.zeros((len(q), c.shape[1]), np.float32)
    step = max(1, (1 << 16) // max(1, c.shape[1]))
    gap = np.empty((step, c.shape[1]), np.float32)
    for s in range(0, len(q), step):
        to, t = out[s:s + step], gap[:len(q) - s]
        for j in range(len(c)):
            np.subtract(q[s:s + step, j, None], c[j], out=t)
            np.abs(t, out=t)
            to += t
    return out, 8 * np.finfo(np.float32).eps * (Q.shape[1] + 8) * 2 * widest + moved


def nearest_by_class(Q: np.ndarray, C: np.ndarray, rng: np.ndarray, cid: np.ndarray, classes: list, k: int, own: np.ndarray):
    """``(row, column, dist)`` of the ``k`` nearest candidates of every query in each of ``classes`` (columns), by the
    range-normalised Manhattan distance and ``cid``; ``own`` pairs are left out.

    Rough distances screen; what can be among the ``k`` gets the distance that :func:`_block_distances` has."""
    rough, parts = _rough_relief(Q, C, rng), []
    if rough is None:
        D = _block_distances(Q, C, "relief", rng)
        D[own] = np.inf
        for idx in classes:
            r, c = _top_k_rows(D[:, idx], cid[idx], k)
            parts.append((r, idx[c], D[r, idx[c]]))
        return tuple(np.concatenate(x) for x in zip(*parts))
    A, slack = rough
    A[own] = np.inf
    safe, zero = np.where(rng > 0, rng, 1.0), rng <= 0
    for idx in classes:
        S = A[:, idx]
        limit = np.partition(S, min(k, len(idx)) - 1, axis=1)[:, min(k, len(idx)) - 1].astype(np.float64) + 2 * slack
        limit = np.minimum(limit * (1 + 1e-6), np.finfo(np.float32).max).astype(np.float32)
        r, c = np.divmod(np.flatnonzero(S <= limit[:, None]), len(idx))
        c, dist = idx[c], np.empty(len(r))
        step = max(1, _CHUNK_CELLS // max(1, Q.shape[1]))
        for s in range(0, len(r), step):
            nd = np.abs(Q[r[s:s + step]] - C[c[s:s + step]]) / safe
            nd[:, zero] = 0.0
            dist[s:s + step] = nd.sum(axis=1)
        first = best_k(r, dist, cid[c], k)
        parts.append((r[first], c[first], dist[first]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _block_result_schema(with_qlabel: bool, keys) -> T.StructType:
    fields = [T.StructField(c, T.LongType()) for c in keys] + [
        T.StructField("qid", T.LongType())]
    if with_qlabel:
        fields.append(T.StructField("qlabel", T.LongType()))
    fields += [
              T.StructField("cid", T.LongType()), T.StructField("clabel", T.LongType()),
              T.StructField("dist", T.DoubleType())]
    return T.StructType(fields)


def _make_block_fn(k: int, metric: str, per_label: bool, exclude_self: bool,
                   with_qlabel: bool, keys):
    cols = (list(keys) + ["qid"] + (["qlabel"] if with_qlabel else [])
            + ["cid", "clabel", "dist"])

    def solve(Q, q, qi, C, c_, ci, rngs, keyvals) -> dict:
        """Local top-k of one domain's query block against one candidate block."""
        qid = q["qid"][qi].astype(np.int64)
        cid, clabel = c_["cid"][ci].astype(np.int64), c_["clabel"][ci]
        rng = np.asarray(rngs[qi[0]], dtype=np.float64) if metric == "relief" else None
        if metric == "euclidean" and not per_label:
            own = (qid, cid) if exclude_self else (np.zeros(len(qid), np.int64), np.arange(1, len(cid) + 1))
            r, c, dist = nearest(Q, C, cid, k, *own)
            out = {key: np.full(len(r), val, dtype=np.int64) for key, val in zip(keys, keyvals)}
            out.update({"qid": qid[r], "cid": cid[c], "clabel": clabel[c], "dist": dist})
            if with_qlabel:
                out["qlabel"] = q["qlabel"][qi][r]
            return out
        if metric == "relief" and per_label:
            lab = pd.Series(clabel)
            own = qid[:, None] == cid[None, :] if exclude_self else np.zeros((len(qid), len(cid)), bool)
            r, c, dist = nearest_by_class(Q, C, rng, cid, [np.asarray(idx) for idx in lab.groupby(lab, dropna=False).indices.values()], k, own)
        else:
            D = _block_distances(Q, C, metric, rng)
            if exclude_self:
                D[qid[:, None] == cid[None, :]] = np.inf
            picks = []
            if per_label:
                lab = pd.Series(clabel)
                for _, idx in lab.groupby(lab, dropna=False).indices.items():
                    idx = np.asarray(idx)
                    r, c = _top_k_rows(D[:, idx], cid[idx], k)
                    picks.append((r, idx[c]))
            else:
                picks.append(_top_k_rows(D, cid, k))
            r = np.concatenate([p[0] for p in picks])
            c = np.concatenate([p[1] for p in picks])
            dist = D[r, c]
        out = {key: np.full(len(r), val, dtype=np.int64) for key, val in zip(keys, keyvals)}
        out.update({"qid": qid[r], "cid": cid[c], "clabel": clabel[c], "dist": dist})
        if with_qlabel:
            out["qlabel"] = q["qlabel"][qi][r]
        return out

    def split(pdf: pd.DataFrame) -> dict:
        """Row numbers of every domain: one sort, then the segments between keys."""
        cols_ = [pdf[key].to_numpy(np.int64) for key in keys]
        order = np.lexsort(cols_[::-1])
        sorted_ = [c[order] for c in cols_]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in sorted_:
            new[1:] |= c[1:] != c[:-1]
        heads = np.flatnonzero(new)
        return dict(zip(zip(*(c[heads].tolist() for c in sorted_)), np.split(order, heads[1:])))

    def fn(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
        # one task may carry several small domains (packed) or one block pair
        # of a big domain; either way every domain is solved on its own
        if len(qpdf) == 0 or len(cpdf) == 0:
            return pd.DataFrame({c: [] for c in cols})
        cgroups, parts = split(cpdf), []
        qvec, cvec = _stack(qpdf["qvec"]), _stack(cpdf["cvec"])
        q = {c: qpdf[c].to_numpy() for c in qpdf.columns if c not in ("qvec", "rng")}
        c = {x: cpdf[x].to_numpy() for x in ("cid", "clabel")}
        rngs = qpdf["rng"].to_numpy() if metric == "relief" else None
        for kv, qi in split(qpdf).items():
            ci = cgroups.get(kv)
            if ci is not None:
                parts.append(solve(qvec[qi], q, qi, cvec[ci], c, ci, rngs, kv))
        if not parts:
            return pd.DataFrame({c: [] for c in cols})
        res = pd.DataFrame({name: np.concatenate([p[name] for p in parts]) for name in cols})
        res["clabel"] = res["clabel"].astype("Int64")
        if with_qlabel:
            res["qlabel"] = res["qlabel"].astype("Int64")
        return res

    return fn


def blocked_top_k(queries: DataFrame, cands: DataFrame, k: int, *,
                  metric: str = "euclidean", per_label: bool = False,
                  exclude_self: bool = True,
                  block_rows: int = DEFAULT_BLOCK_ROWS, keys=("grp",)) -> DataFrame:
    """Top-``k`` candidates per query inside each search domain.

    ``queries``: ``keys..., qid, qvec`` (+ ``qlabel``; + ``rng`` array for
    ``metric="relief"``).  ``cands``: ``keys..., cid, cvec`` (+ ``clabel`` for
    ``per_label``).  Returns ``keys..., qid[, qlabel], cid, clabel, dist,
    rank`` with ``rank`` 1..k per ``(keys, qid)`` (per ``(keys, qid, clabel)``
    when ``per_label``), ordered by ``(dist, cid)``.  ``keys`` (default
    ``grp``) define a search domain.

    Domains bigger than ``block_rows`` on either side are split into block
    pairs (one task each); domains that fit one block are packed together,
    about ``2 * block_rows`` rows per task, so many small groups do not cost
    one task each.
    """
    keys = list(keys)
    if "clabel" not in cands.columns:
        cands = cands.withColumn("clabel", F.lit(None).cast("bigint"))
    qn = queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("_qn"))
    cn = cands.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cn"))
    nb = qn.join(cn, keys, "inner").select(
        *keys, "_qn", "_cn",
        F.ceil(F.col("_qn") / F.lit(block_rows)).cast("bigint").alias("_nqb"),
        F.ceil(F.col("_cn") / F.lit(block_rows)).cast("bigint").alias("_ncb"))
    nb = bounded(nb)
    single = (F.col("_nqb") == 1) & (F.col("_ncb") == 1)
    small_rows = nb.where(single).agg(F.sum(F.col("_qn") + F.col("_cn"))).first()[0] or 0
    n_pack = max(1, -(-int(small_rows) // (2 * block_rows)))
    dom = F.xxhash64(*[F.col(x) for x in keys])
    nb = nb.withColumn("_big", ~single).withColumn(
        "_task", F.when(single, F.pmod(dom, F.lit(n_pack))).otherwise(dom)).drop("_qn", "_cn")

    qcols = (keys + ["qid", "qvec"] + (["qlabel"] if "qlabel" in queries.columns else [])
             + (["rng"] if metric == "relief" else []))
    q = (queries.select(*qcols).join(nb, keys, "inner")
         .withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("_nqb")))
         .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ncb") - 1)))
         .drop("_nqb", "_ncb"))
    c = (cands.select(*keys, "cid", "cvec", "clabel").join(nb, keys, "inner")
         .withColumn("cb", F.pmod(F.xxhash64("cid"), F.col("_ncb")))
         .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_nqb") - 1)))
         .drop("_nqb", "_ncb"))

    # fresh attributes on both sides: queries and candidates usually come from
    # the same frame, and the cogroup keys must not resolve ambiguously
    q = q.select(*[F.col(x).alias(x) for x in q.columns])
    c = c.select(*[F.col(x).alias(x) for x in c.columns])
    with_qlabel = "qlabel" in queries.columns
    fn = _make_block_fn(k, metric, per_label, exclude_self, with_qlabel, keys)
    task = ["_big", "_task", "qb", "cb"]
    local = (q.groupBy(*task).cogroup(c.groupBy(*task))
             .applyInPandas(fn, _block_result_schema(with_qlabel, keys)))
    part = keys + ["qid"] + (["clabel"] if per_label else [])
    w = Window.partitionBy(*part).orderBy("dist", "cid")
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn_exact(df: DataFrame, k: int, block_rows: int = DEFAULT_BLOCK_ROWS, log: dict | None = None) -> DataFrame:
    """G1 (exact): ``(id, nbr, grp, rank, dist, sim)`` -- the ``k`` nearest other rows
    of the same group (Euclidean; ties to the smaller id) for every unfinished
    row.  ``sim = 1 / (1 + dist)``.

    Groups of one block are packed into tasks; groups of more go through
    :func:`graphssl.operators.pivots.pivot_top_k`, which lists the block pairs that can hold
    neighbours (reported in ``log``) and scores each once for both directions."""
    from .pivots import pivot_top_k

    rows = (df.where(~F.col("finished")) if "finished" in df.columns else df).select("grp", "id", "features")
    sizes = write_table(rows.groupBy("grp").agg((F.count(F.lit(1)) > block_rows).alias("_big")), "sizes")
    kinds = sizes.groupBy("_big").agg(F.count(F.lit(1)).alias("n")).collect()        # two rows at most
    n_groups = sum(r["n"] for r in kinds)
    parts = []
    for big in sorted(r["_big"] for r in kinds):
        own = rows if len(kinds) == 1 else rows.join(
            small_hint(sizes.where(F.col("_big") == big).select("grp"), n_groups), "grp")
        if big:
            parts.append(pivot_top_k(own, k, block_rows, log))
        else:
            parts.append(blocked_top_k(own.select("grp", F.col("id").alias("qid"), F.col("features").alias("qvec")),
                                       own.select("grp", F.col("id").alias("cid"), F.col("features").alias("cvec")),
                                       k, block_rows=block_rows).select("grp", "qid", "cid", "dist", "rank"))
    if not parts:
        return rows.select("id", F.col("id").alias("nbr"), "grp", F.lit(0).alias("rank"), F.lit(0.0).alias("dist"),
                           F.lit(1.0).alias("sim")).where("false")
    top = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return top.select(F.col("qid").alias("id"), F.col("cid").alias("nbr"), "grp", "rank",
                      "dist", (F.lit(1.0) / (F.lit(1.0) + F.col("dist"))).alias("sim"))
