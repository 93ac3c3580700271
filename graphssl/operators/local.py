"""Kernels that run a whole group in one task (numpy), for groups of bounded size.

Groups never exchange rows, so a step of a small group needs no plan of joins and windows: its
rows come to one task, in order of ``grp``, and a task holds one group at a time.  The kernels make
the same draws (Spark's ``xxhash64``) and the same comparisons as the plans that big groups run through,
so both give the same rows.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .knn import nearest_by_class, pair_distances, squares

#: Output rows that are handed on together.
_OUT_ROWS = 1 << 14
#: Cells of the row blocks that a kernel looks at.
_BLOCK_CELLS = 1 << 21
#: Pairs that cost as much as one, if their distances are only screened by a matrix product.
_SCREEN_GAIN = 100
#: A round later than every other.
NEVER = 1 << 30

_P = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotl(x, r: int):
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _fmix(h):
    h = (h ^ (h >> np.uint64(33))) * _P[1]
    h = (h ^ (h >> np.uint64(29))) * _P[2]
    return h ^ (h >> np.uint64(32))


def hash_long(x: np.ndarray, h=np.uint64(42)) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint column; ``h``: hash of the columns before it."""
    with np.errstate(over="ignore"):
        k = _rotl(np.asarray(x, np.int64).astype(np.uint64) * _P[1], 31) * _P[0]
        return _fmix(_rotl((h + _P[4] + np.uint64(8)) ^ k, 27) * _P[0] + _P[3])


def hash_int(x: int, h=np.uint64(42)):
    """The same for an int literal."""
    with np.errstate(over="ignore"):
        k = np.uint64(x & 0xFFFFFFFF) * _P[0]
        return _fmix(_rotl((h + _P[4] + np.uint64(4)) ^ k, 23) * _P[1] + _P[2])


def matrix(col: pa.Array) -> np.ndarray:
    """A list column as rows of a matrix (every list has the same length)."""
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def each_group(df: DataFrame, parts: int, solve, schema: str) -> DataFrame:
    """``solve(grp, table)`` for the rows of every ``grp``: a dict of columns, or None."""

    def run(batches):
        grp, held, out, n_out = None, [], [], 0
        names = [f.split()[0] for f in schema.split(", ")]

        def pack():
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([x[c] for x in out]) if len(out) > 1 else out[0][c] for c in names], names=names)

        for batch in chain(batches, [None]):          # None: the last group ends
            if batch is None:
                cuts, g = [], None
            else:
                if not batch.num_rows:
                    continue
                g = batch.column("grp").to_numpy()
                cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist()]
            for i, at in enumerate(cuts or [0]):
                now = None if g is None else int(g[at])
                if held and now != grp:
                    found = solve(grp, pa.Table.from_batches(held).combine_chunks())
                    held = []
                    if found is not None:
                        out.append({c: pa.array(found[c]) if not isinstance(found[c], pa.Array) else found[c] for c in names})
                        n_out += len(out[-1][names[0]])
                        if n_out >= _OUT_ROWS:
                            yield pack()
                            out, n_out = [], 0
                if g is not None:
                    grp = now
                    held.append(batch.slice(at, (cuts[i + 1] if i + 1 < len(cuts) else len(g)) - at))
        if out:
            yield pack()

    return df.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(run, schema)



def _ranked(row: np.ndarray, dist: np.ndarray, nbr: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first ``k`` entries of every row by ``(dist, nbr)``, in order of rows."""
    order = np.lexsort((nbr, dist, row))
    rows = row[order]
    return order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _padded(v: np.ndarray, u: np.ndarray, n: int, fill: int) -> np.ndarray:
    """``(n, widest)``: the ``u`` of every ``v``, then ``fill``.  ``v`` ascends."""
    count = np.bincount(v, minlength=n)
    out = np.full((n, int(count.max(initial=0))), fill, np.int32)
    out[v, np.arange(len(v)) - (np.cumsum(count) - count)[v]] = u
    return out


def _fill(ids: np.ndarray, row: np.ndarray, nbr: np.ndarray, k: int, seed: int, pad_rows: int):
    """``(row, nbr)`` that :func:`graphssl.operators.descent._padding` adds to the lists ``(row, nbr)``."""
    n = len(ids)
    need = min(k, n - 1) - np.bincount(row, minlength=n)
    short = np.flatnonzero(need > 0)
    if not len(short):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slots = -(-n // pad_rows)
    slot = hash_int(seed, hash_long(ids)).astype(np.int64) % slots
    by = np.argsort(slot, kind="stable")
    first = by[np.arange(n) - np.searchsorted(slot[by], slot[by]) < 2 * k + 1]
    first = _padded(slot[first], first, slots, n)
    begin = hash_int(seed + 1, hash_long(ids[short])).astype(np.int64)
    step, got_r, got_u = max(1, _BLOCK_CELLS // (2 * max(n + 1, min(slots, k + 1) * first.shape[1]))), [], []
    by_row = np.argsort(row, kind="stable")
    at, has = np.searchsorted(row[by_row], np.arange(n + 1)), nbr[by_row]
    wide = np.append(ids, 0)
    for s in range(0, len(short), step):
        r = short[s:s + step]
        look = (begin[s:s + step, None] + np.arange(min(slots, k + 1))) % slots
        cand = first[look].reshape(len(r), -1)
        known = np.zeros((len(r), n + 1), bool)
        known[:, n] = True
        known[np.arange(len(r)), r] = True
        size = at[r + 1] - at[r]
        known[np.repeat(np.arange(len(r)), size), has[np.repeat(at[r] - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        free = ~np.take_along_axis(known, cand, axis=1)
        h = hash_int(seed, hash_long(wide[cand], hash_long(ids[r])[:, None])).astype(np.int64)
        h[~free] = np.iinfo(np.int64).max
        most = min(int(need[r].max()), h.shape[1])
        best = np.argpartition(h, most - 1, axis=1)[:, :most]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(h, best, axis=1), axis=1), axis=1)
        keep = (np.arange(most) < need[r][:, None]) & np.take_along_axis(free, best, axis=1)
        got_r.append(np.repeat(r, keep.sum(axis=1)))
        got_u.append(np.take_along_axis(cand, best, axis=1)[keep].astype(np.int64))
    return np.concatenate(got_r), np.concatenate(got_u)


def _meetings(ids, row, nbr, now, old, pool: int, salt: int):
    """``(v, u)`` of all members and of the new ones, without repeats; ``now``: entries sampled in this round."""
    n, members = len(ids), []
    for part in (now, old):
        v, u = nbr[part], row[part]
        h = hash_int(salt, hash_long(ids[u], hash_long(ids[v]))).astype(np.int64)
        order = np.lexsort((u, h, v))
        s = v[order]
        back = order[np.arange(len(s)) - np.searchsorted(s, s) < pool]
        members.append(_distinct(np.concatenate([row[part] * n + nbr[part], v[back] * n + u[back]])))
    return _distinct(np.concatenate(members)), members[0]


def _screen(X: np.ndarray):
    """``(squares of distances of rows s..e to all rows, by one float32 product; a bound of their error per row)``."""
    with np.errstate(all="ignore"):
        Z = X - X.mean(axis=0)
        zz = (Z * Z).sum(axis=1)
        if not np.isfinite(zz).all() or not 1e-20 < zz.max() < 1e30:
            return None, None
        moved = 4 * np.sqrt(X.shape[1]) * np.finfo(np.float64).eps * np.abs(X).max()
    slack = 8 * np.finfo(np.float32).eps * (X.shape[1] + 8) * (zz + zz.max()) + 8 * np.sqrt(zz.max()) * moved + moved * moved
    left, right = (x.astype(np.float32) for x in squares(Z, zz, Z, zz))
    return lambda s, e: left[s:e] @ right, slack


def _screened(mark, S, bound, slack, row, dist, pool: int):
    """``(row, column)`` of the marked pairs that can be among the best ``pool`` of their row and its entries ``(row, dist)``."""
    limit = np.square(bound) * (1 + 1e-12) + slack
    mark &= S <= np.minimum(limit * (1 + 1e-6), np.finfo(np.float32).max).astype(np.float32)[:, None]
    at = np.flatnonzero(mark)
    r, u = np.divmod(at, S.shape[1])
    if not len(r):
        return r, u
    found = S.reshape(-1)[at].astype(np.float64)
    count, have = np.bincount(r, minlength=len(S)), np.bincount(row, minlength=len(S))
    table = np.full((len(S), int((count + have).max())), np.inf)
    table[r, np.arange(len(r)) - (np.cumsum(count) - count)[r]] = found
    table[row, np.arange(len(row)) - (np.cumsum(have) - have)[row] + count[row]] = np.square(dist) * (1 + 1e-12)
    if table.shape[1] > pool:
        limit = np.partition(table, pool - 1, axis=1)[:, pool - 1] + 2 * slack
        keep = ~(found > limit[r])
        r, u = r[keep], u[keep]
    return r, u


def descend(ids: np.ndarray, X: np.ndarray, row: np.ndarray, nbr: np.ndarray, pool: int, max_iter: int,
            sample_rate: float, seed: int, pad_rows: int):
    """NN-Descent (:mod:`graphssl.operators.descent`) of one group: ``(row, nbr, dist, came, gone, used)``, all entries that a
    list ever had, with the rounds in which they came, went and were sampled; -1: before the first.

    ``ids`` ascend; ``(row, nbr)``: the lists to begin with, as positions.  So the lists after round ``r`` are the
    entries with ``came <= r < gone``, of which those with ``used > r`` are new.

    Who meets whom is marked in blocks of rows; a pair that can enter a list gets its distance from the differences.
    Where pairs are many, a matrix product screens them first."""
    n = len(ids)
    dist = pair_distances(X, X, row, nbr)
    best = _ranked(row, dist, nbr, pool)
    row, nbr, dist = row[best], nbr[best], dist[best]
    more_r, more_u = _fill(ids, row, nbr, pool, seed, pad_rows)
    row, nbr = np.concatenate([row, more_r]), np.concatenate([nbr, more_u])
    dist = np.concatenate([dist, pair_distances(X, X, more_r, more_u)])
    order = np.argsort(row, kind="stable")
    row, nbr, dist = row[order], nbr[order], dist[order]
    came = np.full(len(row), -1)
    used = np.full(len(row), NEVER if n > pool + 1 else -1)
    gone: list[tuple] = []
    screen, slack = _screen(X) if n > 64 and max_iter else (None, None)
    for rnd in range(max_iter):
        now = used == NEVER
        if not now.any():
            break
        old = ~now
        if sample_rate < 1.0:
            h = hash_int(rnd, hash_int(seed, hash_long(ids[nbr], hash_long(ids[row])))).astype(np.int64)
            now &= h % 1_000_000 < int(sample_rate * 1_000_000)
        everyone, fresh = _meetings(ids, row, nbr, now, old, pool, seed + rnd)
        used[now] = rnd
        lively = np.zeros(n, bool)
        lively[fresh // n] = True
        everyone = everyone[lively[everyone // n]]
        all_of, new_of = _padded(everyone // n, everyone % n, n, n), _padded(fresh // n, fresh % n, n, n)
        # (member, meeting), in order of members: new ones meet everybody, the others meet the new ones
        meets = []
        for pairs, partners in ((fresh, all_of), (np.setdiff1d(everyone, fresh, assume_unique=True), new_of)):
            order = np.argsort(pairs % n, kind="stable")
            u = (pairs % n)[order]
            meets.append((u, (pairs // n)[order], np.searchsorted(u, np.arange(n + 1)), partners))
        size = np.bincount(row, minlength=n)
        at = np.append(0, np.cumsum(size))
        bound = np.where(size >= pool, np.maximum.reduceat(dist, np.minimum(at[:-1], len(dist) - 1)), np.inf)
        bound[np.isnan(bound)] = np.inf
        listed = np.argsort(nbr, kind="stable")
        listed_at = np.searchsorted(nbr[listed], np.arange(n + 1))
        step = max(min(n, 256), _BLOCK_CELLS // (n + 1))
        new_r, new_u, new_d = [], [], []
        for s in range(0, n, step):
            e = min(n, s + step)
            mark = np.zeros((e - s, n + 1), bool)
            flat = mark.reshape(-1)
            for u, v, starts, partners in meets:
                width = max(1, _BLOCK_CELLS // max(1, partners.shape[1]))
                for i in range(starts[s], starts[e], width):
                    part = slice(i, min(i + width, starts[e]))
                    flat[((u[part] - s) * (n + 1))[:, None] + partners[v[part]]] = True
            mark[:, n] = False
            mark[np.arange(e - s), np.arange(s, e)] = False
            mark[row[at[s]:at[e]] - s, nbr[at[s]:at[e]]] = False
            by = listed[listed_at[s]:listed_at[e]]
            mark[nbr[by] - s, row[by]] = False
            mark = mark[:, :n]
            if screen is not None and np.count_nonzero(mark) * _SCREEN_GAIN > mark.size:
                r, u = _screened(mark, screen(s, e), bound[s:e], slack[s:e], row[at[s]:at[e]] - s, dist[at[s]:at[e]], pool)
            else:
                r, u = np.divmod(np.flatnonzero(mark), n)
            d = pair_distances(X, X, r + s, u)
            keep = ~(d > bound[s:e][r])
            new_r.append(r[keep] + s)
            new_u.append(u[keep])
            new_d.append(d[keep])
        fresh_n = sum(map(len, new_r))
        row, nbr, dist = (np.concatenate([a, *b]) for a, b in ((row, new_r), (nbr, new_u), (dist, new_d)))
        came, used = np.append(came, np.full(fresh_n, rnd)), np.append(used, np.full(fresh_n, NEVER))
        best = _ranked(row, dist, nbr, pool)
        out = np.ones(len(row), bool)
        out[best] = False
        out &= came < rnd
        gone.append((row[out], nbr[out], dist[out], came[out], np.full(out.sum(), rnd), used[out]))
        row, nbr, dist, came, used = row[best], nbr[best], dist[best], came[best], used[best]
    gone.append((row, nbr, dist, came, np.full(len(row), NEVER), used))
    return tuple(np.concatenate(x) for x in zip(*gone))


def start_pairs(ids: np.ndarray, row: np.ndarray, nbr_ids: np.ndarray, both: bool):
    """Positions of the entries whose neighbour is in the group, once each; ``both``: in the lists of both rows."""
    n = len(ids)
    if not n or not len(row):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nbr = np.minimum(np.searchsorted(ids, nbr_ids), n - 1)
    inside = (ids[nbr] == nbr_ids) & (nbr != row)
    key = row[inside] * n + nbr[inside]
    if both:
        key = np.append(key, nbr[inside] * n + row[inside])
    key = _distinct(key)
    return key // n, key % n


def relief(ids: np.ndarray, X: np.ndarray, label: np.ndarray, m: int | None, k: int, seed: int, bias: float):
    """ReliefF (:mod:`graphssl.operators.relief`) over the labelled rows of one group: a weight per feature, or None
    (one class)."""
    classes, cls, count = np.unique(label, return_inverse=True, return_counts=True)
    if len(classes) < 2:
        return None
    n, d = X.shape
    with np.errstate(invalid="ignore"):
        rng = np.fmax.reduce(X, axis=0) - np.fmin.reduce(X, axis=0)
    rng[np.isnan(X).all(axis=0)] = -np.inf
    prior = count / n
    probes = np.arange(n)
    if m is not None:
        p = 2147483647
        h = ((ids % p * 48271 + seed % p + 1) % p * 69621) % p
        probes = np.sort(np.lexsort((ids, h))[:m])
    mean, terms, of_class = np.zeros(d), np.zeros(d), [np.flatnonzero(cls == c) for c in range(len(classes))]
    step = max(1, _BLOCK_CELLS // max(n, d * k * len(classes)))
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        for s in range(0, len(probes), step):
            q = probes[s:s + step]
            r, c, _ = nearest_by_class(X[q], X, rng, ids, of_class, k, ids[q][:, None] == ids[None, :])
            hit = cls[c] == cls[q][r]
            n_hits, n_miss = np.bincount(r[hit], minlength=len(q)), np.bincount(r[~hit], minlength=len(q))
            avg = np.floor(n_miss / (len(classes) - 1))[r]
            coef = np.where(hit, -1.0 / (len(probes) * n_hits[r]),
                            np.where(avg > 0, prior[cls[c]] / (1.0 - prior[cls[q][r]]) / (len(probes) * avg), 0.0))
            some = np.lexsort((cls[c], r))
            some = some[coef[some] != 0]
            step_by = np.abs(X[q[r[some]]] - X[c[some]]) * coef[some][:, None]
            # the sum of Spark's Summarizer, a running mean, in order of probe and class: the same last bits
            for x, nz in zip(step_by, step_by != 0):
                terms += nz
                mean += np.divide(x - mean, terms, out=np.zeros(d), where=nz)
        total = mean * terms
        w = np.where(rng > 0, total / rng, 0.0)
        w = np.where(np.isnan(w), 0.0, w)
        return np.maximum(0.0, (w / w.max() + bias) / (1.0 + bias)) if w.max() > 0 else np.ones(d)
