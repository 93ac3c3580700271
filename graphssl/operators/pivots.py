"""Exact k-nearest-neighbour search with metric pruning (G1) for groups of many blocks.

1. *Cells.*  About one row in ``block_rows`` is a pivot; every row goes to its nearest pivot (the
   blocked top-1).  A crowded cell is dealt to blocks by hash; a block has the radius of its own rows.  Blocks are
   dealt to tiles of about ``TILE_CELLS`` numbers, which are what tasks hold.
2. *Home.*  Each block searches itself, which gives every row a bound: the distance of its k-th neighbour so far.
   Then the blocks of a tile meet, which tightens the bounds.
3. *Pairs.*  Two blocks have to meet only if their pivots' distance less both radii is within the bound
   of one of them (triangle inequality).  Pairs are judged once per pair of tiles, for both directions; what is
   kept is a row per block and tile that it meets.
4. *Meetings.*  A row goes to a pair of tiles if it may ask (its own bound reaches a block of the other
   tile) or answer (such a block's bound reaches it); all this is decided by scalars before any vector
   moves, and a row moves once per tile, however many blocks it meets there.  One matrix product of the blocks that
   meet serves both directions, and only entries within the asker's bound leave the task.
5. The best ``k`` of home and meetings stay.

Pruning removes only pairs that cannot hold a neighbour (bounds are widened by rounding's share), so
the result is that of all pairs.  On data without clusters every pair meets, each once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, write_table
from .knn import (DEFAULT_BLOCK_ROWS, SCREEN_CELLS, _block_distances, _stack, best_k, blocked_top_k, copies, few_copies,
                  nearest, pair_distances, screen_slack, squares)
from .sizing import small_hint

#: Numbers of the vectors of one tile (16,384 rows of 64 features).
TILE_CELLS = 1 << 20
#: Share of a distance by which bounds are widened against rounding.
SLACK = 1e-9

_NEAR = "grp long, qid long, cid long, dist double"


def _cells(rows: DataFrame, sizes: DataFrame, n_groups: int, block_rows: int, tile_rows: int) -> DataFrame:
    """``(grp, id, vec, cell, sub, r, tile)``: nearest pivot, block inside its cell, distance to the pivot, the block's tile."""
    sized = rows.join(small_hint(sizes, n_groups), "grp")
    some = F.pmod(F.xxhash64("id", F.lit(17)), F.col("_n")) < F.ceil(F.col("_n") / F.lit(block_rows))
    one = rows.groupBy("grp").agg(F.min("id").alias("id"))           # never a group without a pivot
    pivots = (sized.where(some).select("grp", "id").unionByName(one).distinct()
              .join(rows, ["grp", "id"]).select("grp", F.col("id").alias("cid"), F.col("features").alias("cvec")))
    near = blocked_top_k(rows.select("grp", F.col("id").alias("qid"), F.col("features").alias("qvec")), pivots, 1,
                         exclude_self=False, block_rows=max(block_rows, min(tile_rows, 4 * DEFAULT_BLOCK_ROWS)))
    near = write_table(near.select(F.col("qid").alias("id"), F.col("cid").alias("cell"), F.col("dist").alias("r")), "near")
    crowd = write_table(near.groupBy("cell").agg(F.count(F.lit(1)).alias("_c")), "crowd")
    placed = near.join(small_hint(crowd, crowd.count()), "cell").select(
        "id", "cell", "r", F.pmod(F.xxhash64("id"), F.ceil(F.col("_c") / F.lit(2 * block_rows))).alias("sub"))
    tile = F.pmod(F.xxhash64("cell", "sub"), F.ceil(F.col("_n") / F.lit(tile_rows))).cast("long")
    return write_table(sized.join(placed, "id").select(
        "grp", "id", F.col("features").alias("vec"), "cell", "sub", "r", tile.alias("tile")), "cells")


def _blocks_of(pdf: pd.DataFrame) -> list[np.ndarray]:
    """Row numbers of every block, in the order of (cell, sub)."""
    cell, sub = pdf["cell"].to_numpy(np.int64), pdf["sub"].to_numpy(np.int64)
    order = np.lexsort((sub, cell))
    return np.split(order, 1 + np.flatnonzero((np.diff(cell[order]) != 0) | (np.diff(sub[order]) != 0))) if len(order) else []


def _near_frame(pdf: pd.DataFrame, r, cid, dist) -> pd.DataFrame:
    return pd.DataFrame({"grp": pdf["grp"].to_numpy(np.int64)[r], "qid": pdf["id"].to_numpy(np.int64)[r], "cid": cid, "dist": dist})


def _home(k: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, X, parts = pdf["id"].to_numpy(np.int64), _stack(pdf["vec"]), []
        for own in _blocks_of(pdf):
            r, c, dist = nearest(X[own], X[own], ids[own], k, own, own)
            parts.append((own[r], ids[own[c]], dist))
        return _near_frame(pdf, *(np.concatenate(x) for x in zip(*parts)))
    return fn


def _least(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distances of the blocks' pivots, and how near rows of both blocks can be at least."""
    D = _block_distances(_stack(a["vec"]), _stack(b["vec"]), "euclidean", None)
    return D, D - a["radius"].to_numpy()[:, None] - b["radius"].to_numpy()[None, :] - SLACK * (1 + D)


def _tile(k: int):
    """The blocks of one tile meet: the ``k`` nearest inside the tile."""
    def fn(pdf: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        ids, X, rows, parts = pdf["id"].to_numpy(np.int64), _stack(pdf["vec"]), _blocks_of(pdf), []
        same = copies(X)
        blocks = blocks.drop_duplicates(["cell", "sub"]).sort_values(["cell", "sub"])
        asks = _least(blocks, blocks)[1] <= blocks["reach"].to_numpy()[:, None]
        np.fill_diagonal(asks, True)
        for own, meet in zip(rows, asks):
            other = np.concatenate([x for x, m in zip(rows, meet) if m])
            r, c, dist = nearest(X[own], X[other], ids[other], k, own, other, same[other])
            parts.append((own[r], ids[other[c]], dist))
        return _near_frame(pdf, *(np.concatenate(x) for x in zip(*parts)))
    return fn


def _list_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one pair of tiles (``side`` tells them apart) the blocks that have to meet a block of the other one."""
    same = pdf["ti"].iloc[0] == pdf["tj"].iloc[0]
    a = pdf[pdf["side"] == 0]
    b = a if same else pdf[pdf["side"] == 1]
    out = []
    if len(a) and len(b):
        D, least = _least(a, b)
        meet = least <= np.maximum(a["reach"].to_numpy()[:, None], b["reach"].to_numpy()[None, :])
        if same:
            meet &= np.triu(np.ones(D.shape, bool), 1)
        for own, opp, d, m in ((a, b, D, meet), (b, a, D.T, meet.T)):
            # from a row: the other block is at least as far as the pivots are apart, less the row's and the block's radii
            apart = np.where(m, d * (1 - SLACK) - opp["radius"].to_numpy()[None, :] - SLACK, np.inf)
            with np.errstate(invalid="ignore"):
                give = np.where(m, apart - opp["reach"].to_numpy()[None, :], np.inf)
            out.append(own[["grp", "ti", "tj", "side", "cell", "sub"]].assign(
                ask=apart.min(axis=1), give=give.min(axis=1), met=m.sum(axis=1).astype(np.int64))[m.any(axis=1)])
    return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("grp", "ti", "tj", "side", "cell", "sub", "ask", "give", "met")})


_PAIRS = "grp long, ti long, tj long, side int, cell long, sub long, ask double, give double, met long"


def tile_pairs(blocks: DataFrame, tiles: DataFrame, n_groups: int, inside: bool) -> DataFrame:
    """Every block once per pair of tiles (of one tile with itself, or of two)."""
    t = blocks.join(small_hint(tiles, n_groups), "grp")
    if inside:
        return t.withColumns({"ti": F.col("tile"), "tj": F.col("tile"), "side": F.lit(0)}).drop("_nt", "tile")
    t = t.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nt") - 1))).where("o != tile")
    return t.withColumns({"ti": F.least("tile", "o"), "tj": F.greatest("tile", "o"),
                          "side": (F.col("tile") > F.col("o")).cast("int")}).drop("_nt", "tile", "o")


def _within(A: np.ndarray, B: np.ndarray, bound_a: np.ndarray, bound_b: np.ndarray, give_a: np.ndarray, give_b: np.ndarray):
    """Entries ``(row, column, dist)`` of the distance matrix that are within the row's bound, and those within the
    column's; only rows and columns that ``give`` are found."""
    with np.errstate(over="ignore", invalid="ignore"):
        aa, bb = (A * A).sum(axis=1), (B * B).sum(axis=1)
    plain = not (np.isfinite(aa).all() and np.isfinite(bb).all())
    step, out = max(1, SCREEN_CELLS // len(B)), ([], [])
    if plain:
        near_a, near_b = bound_a, bound_b
    else:
        near_a = bound_a ** 2 * (1 + SLACK) + screen_slack(aa, bb, A.shape[1])
        near_b = bound_b ** 2 * (1 + SLACK) + screen_slack(bb, aa, A.shape[1])
        left, right = squares(A, aa, B, bb)
    for s in range(0, len(A), step):
        S = _block_distances(A[s:s + step], B, "euclidean", None) if plain else left[s:s + step] @ right
        for found, hit in zip(out, (S <= near_a[s:s + step, None], S <= near_b)):
            r, c = np.divmod(np.flatnonzero(hit), S.shape[1])
            may = give_b[c] if found is out[0] else give_a[s + r]
            r, c = r[may], c[may]
            found.append((r + s, c, pair_distances(A[s:s + step], B, r, c)))
    return [tuple(np.concatenate(x) for x in zip(*found)) for found in out]


def _meet(k: int):
    def fn(pdf: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == s].reset_index(drop=True) for s in (0, 1)]
        if any(x.empty for x in sides):
            return pd.DataFrame({"grp": [], "qid": [], "cid": [], "dist": []})
        rows, vec, ids, bound, give, meta = [], [], [], [], [], []
        for s, x in enumerate(sides):
            rows.append(_blocks_of(x))
            vec.append(_stack(x["vec"]))
            ids.append(x["id"].to_numpy(np.int64))
            bound.append(x["bound"].to_numpy(np.float64))
            mine = np.zeros(len(x), bool)
            mine[few_copies(copies(vec[s]), ids[s], k)] = True
            give.append(mine)
            heads = x.iloc[[r[0] for r in rows[s]]][["cell", "sub"]]
            meta.append(heads.merge(blocks[blocks["side"] == s].drop_duplicates(["cell", "sub"]), on=["cell", "sub"], how="left"))
        meets = _least(*meta)[1] <= np.maximum(meta[0]["reach"].to_numpy()[:, None], meta[1]["reach"].to_numpy()[None, :])
        found = ([], [])
        for own, meet in zip(rows[0], meets):
            if meet.any():
                other = np.concatenate([x for x, m in zip(rows[1], meet) if m])
                (ra, ca, da), (rb, cb, db) = _within(vec[0][own], vec[1][other], bound[0][own], bound[1][other],
                                                     give[0][own], give[1][other])
                found[0].append((own[ra], other[ca], da))
                found[1].append((other[cb], own[rb], db))
        parts = []
        for s in (0, 1):
            if found[s]:
                r, c, dist = (np.concatenate(x) for x in zip(*found[s]))
                asked = dist <= bound[s][r]
                r, c, dist = r[asked], ids[1 - s][c[asked]], dist[asked]
                first = best_k(r, dist, c, k)
                parts.append(_near_frame(sides[s], r[first], c[first], dist[first]))
        return pd.concat(parts) if parts else pd.DataFrame({"grp": [], "qid": [], "cid": [], "dist": []})
    return fn


def _bounded(cells: DataFrame, near: DataFrame, pivot: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """``(cells with every row's bound, blocks with their pivot, radius and reach)`` by the neighbours so far."""
    kth = near.groupBy(F.col("qid").alias("id")).agg(
        F.when(F.count(F.lit(1)) >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    bound = write_table(cells.select("grp", "id", "cell", "sub", "r", "tile").join(kth, "id", "left")
                        .withColumn("bound", F.coalesce("bound", F.lit(float("inf")))), "bound")
    blocks = write_table(bound.groupBy("grp", "tile", "cell", "sub").agg(F.max("r").alias("radius"), F.max("bound").alias("reach"))
                         .join(pivot, "cell"), "blocks")
    return bound, blocks


def pivot_top_k(rows: DataFrame, k: int, block_rows: int, log: dict | None = None, tile_rows: int | None = None) -> DataFrame:
    """``(grp, qid, cid, dist)``: the ``k`` nearest other rows of the group by ``(dist, cid)`` for every row of
    ``(grp, id, features)``.  ``log`` gets the numbers of blocks, of block pairs and of those that met."""
    dim = rows.select(F.size("features")).first()
    tile_rows = tile_rows or max(block_rows, DEFAULT_BLOCK_ROWS, TILE_CELLS // max(1, dim[0] if dim else 1))
    sizes = write_table(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n")), "sizes")
    n_groups, most = sizes.agg(F.count(F.lit(1)), F.max("_n")).first()
    tiles = sizes.select("grp", F.ceil(F.col("_n") / F.lit(tile_rows)).cast("long").alias("_nt"))
    cells = _cells(rows, sizes, n_groups, block_rows, tile_rows)
    pivot = write_table(cells.where("id = cell").select("cell", "vec").dropDuplicates(["cell"]), "pivot")
    pair = ["grp", "ti", "tj"]
    home = write_table(cells.groupBy("grp", "tile").applyInPandas(_home(k), _NEAR), "home")
    first, blocks = _bounded(cells, home, pivot, k)
    own = write_table(cells.groupBy("grp", "tile").cogroup(blocks.groupBy("grp", "tile")).applyInPandas(_tile(k), _NEAR), "own")
    old = [cells, pivot, home, first, blocks, own]
    if log is not None:
        per = blocks.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
        inside = tile_pairs(blocks, tiles, n_groups, True).groupBy(*pair).applyInPandas(_list_pairs, _PAIRS)
        log.update(blocks=blocks.count(), pairs=per.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")).first()[0],
                   met=(inside.agg(F.sum("met")).first()[0] or 0) // 2)
    near = own
    if most > tile_rows:
        bound, blocks = _bounded(cells, own, pivot, k)
        met_blocks = tile_pairs(blocks, tiles, n_groups, False)
        pairs = write_table(met_blocks.groupBy(*pair).applyInPandas(_list_pairs, _PAIRS), "pairs")
        old += [bound, blocks, pairs]
        if log is not None:
            log["met"] += (pairs.agg(F.sum("met")).first()[0] or 0) // 2
        guests = (bound.drop("tile").join(pairs.drop("grp", "met").withColumnsRenamed({"cell": "_cell", "sub": "_sub"}),
                                          (F.col("cell") == F.col("_cell")) & (F.col("sub") == F.col("_sub")))
                  .where((F.col("ask") - F.col("r") <= F.col("bound")) | (F.col("give") <= F.col("r")))
                  .select("grp", "ti", "tj", "side", "id", "cell", "sub", "bound")
                  .join(cells.select("id", "vec", F.col("cell").alias("_cell")), "id").where("cell = _cell").drop("_cell"))
        met = guests.groupBy(*pair).cogroup(met_blocks.groupBy(*pair)).applyInPandas(_meet(k), _NEAR)
        near = own.unionByName(met)
    w = Window.partitionBy("grp", "qid").orderBy("dist", "cid")
    best = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    out = write_table(best, "nearest")
    for done in old:
        discard(done)
    return out
