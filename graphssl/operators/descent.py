"""Approximate nearest-neighbour graphs (G1): NN-Descent (Dong, Charikar & Li, WWW 2011)
on id pairs.

A neighbour list is a set of rows ``(grp, id, nbr, dist, new)``.  One round:

1. *Members.*  Every vertex meets its neighbours and a sample of the vertices that
   list it (at most ``pool`` new and ``pool`` old ones, drawn anew each round), so a vertex that everybody
   lists has no larger meeting than any other.
2. *Pairs.*  Of each meeting, two members are a pair if at least one of the two entries is
   new.  Members bring a sketch (a byte per feature, and how far the vector is from it), which bounds the pair's
   distance from both sides; a pair that reaches neither list's last entry stays behind.
   One aggregate makes the others distinct and takes out those of an earlier round
   or of the lists themselves (an anti-join without a join).  Of these, a row keeps what can be among its best ``pool``.
3. *Distances.*  What is left gets its two vectors, once per pair, and is scored in Arrow batches.
   The sketches only leave out pairs that cannot enter a list, so the lists are those of all pairs.
4. *Lists.*  Pairs go both ways into the lists and the best ``pool`` stay (a
   window with a map-side limit).  An entry is new until a round has sampled it.

Small groups run the same rounds in one task each (:mod:`graphssl.operators.local`) where the caller asks for it.

So a round costs what is new, and later rounds move less.  Lists start from random-projection
buckets, or from the lists of an earlier graph (``start``), and are filled up with random rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bucket_count, discard, write_bucketed, write_table
from . import local
from .knn import DEFAULT_BLOCK_ROWS, blocked_top_k
from .local import matrix
from .sizing import small_hint

#: Rows that one random-projection bucket of :func:`knn_lsh` holds on average.
CODE_ROWS = 512
#: Rows per slot that padding draws from.
PAD_ROWS = 64
#: Rows and feature cells of a group that one task may take.  Its screening grows with the square of the rows; up to here
#: one core is no slower than the plans of all rounds on several.
LOCAL_ROWS, LOCAL_CELLS = 1 << 16, 1 << 22


def _best(edges: DataFrame, k: int) -> DataFrame:
    """Best ``k`` per id by ``(dist, nbr)``; ``row_number <= k`` is planned with
    a map-side group limit, so a popular id is trimmed before the shuffle."""
    w = Window.partitionBy("id").orderBy("dist", "nbr")
    return edges.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def finish(lists: DataFrame, k: int) -> DataFrame:
    """The graph ``(id, nbr, grp, rank, dist, sim)`` of the best ``k`` entries of every list."""
    return _best(lists.select("id", "nbr", "grp", "dist"), k).select(
        "id", "nbr", "grp", "rank", "dist", (F.lit(1.0) / (F.lit(1.0) + F.col("dist"))).alias("sim"))


def _group_means(rows: DataFrame) -> DataFrame:
    """``(grp, centre)``: element-wise mean per group, one JVM vector aggregate."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    m = rows.groupBy("grp").agg(Summarizer.mean(array_to_vector("features")).alias("_m"))
    return m.select("grp", vector_to_array("_m").alias("centre"))


def _lsh_buckets(rows: DataFrame, tables: int, seed: int) -> DataFrame:
    """Random-hyperplane codes around each group's mean, ``tables`` codes per
    row: ``(grp, tbl, bkt, id, features)``; ``nbits`` per row sets the code length."""
    schema = T.StructType([T.StructField("grp", T.LongType()), T.StructField("tbl", T.LongType()),
                           T.StructField("bkt", T.LongType()),
                           T.StructField("id", T.LongType()),
                           T.StructField("features", T.ArrayType(T.DoubleType()))])

    def fn(batches):
        planes = {}
        for batch in batches:
            if batch.num_rows == 0:
                continue
            X = matrix(batch.column("features")) - matrix(batch.column("centre"))
            nbits = batch.column("nbits").to_numpy()
            d, most = X.shape[1], int(nbits.max())
            for t in range(tables):
                code = np.zeros(len(X), np.int64)
                for b in range(most):
                    if (t, b, d) not in planes:
                        planes[(t, b, d)] = np.random.default_rng([seed, t, b, d]).standard_normal(d)
                    code |= (((X @ planes[(t, b, d)]) > 0) & (b < nbits)).astype(np.int64) << b
                yield pa.RecordBatch.from_arrays(
                    [batch.column("grp"), pa.array(np.full(len(X), t, np.int64)), pa.array(code), batch.column("id"),
                     batch.column("features")], names=["grp", "tbl", "bkt", "id", "features"])

    return rows.mapInArrow(fn, schema)


def _bucket_lists(rows: DataFrame, sizes: DataFrame, n_groups: int, k: int, tables: int, seed: int, block_rows: int,
                  code_rows: int) -> DataFrame:
    """``(grp, id, nbr, dist)``: the best ``k`` among the rows that share a bucket."""
    nbits = sizes.select("grp", F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(code_rows))))
                         .cast("bigint").alias("nbits"))
    dim = rows.select(F.size("features")).first()[0]
    means = write_table(_group_means(rows), "means")
    coded = write_table(_lsh_buckets(
        rows.join(small_hint(nbits, n_groups), "grp").join(small_hint(means, n_groups * dim, 2_000_000), "grp"),
        tables, seed), "codes")
    q = coded.select("grp", "tbl", "bkt", F.col("id").alias("qid"), F.col("features").alias("qvec"))
    c = coded.select("grp", "tbl", "bkt", F.col("id").alias("cid"), F.col("features").alias("cvec"))
    top = blocked_top_k(q, c, k, keys=("grp", "tbl", "bkt"), block_rows=block_rows)
    return top.groupBy("grp", F.col("qid").alias("id"), F.col("cid").alias("nbr")).agg(F.min("dist").alias("dist"))


def _padding(rows: DataFrame, sizes: DataFrame, n_groups: int, have: DataFrame, k: int, seed: int) -> DataFrame:
    """``(grp, id, nbr)``: for rows with fewer than ``min(k, group - 1)`` neighbours, as
    many random rows of their group as are missing.

    The rows of a group are dealt to about ``n / PAD_ROWS`` slots by hash; a short row
    looks at the ``k + 1`` first rows of a random slot and of the next ones until it
    has enough, so no group is ever gathered or multiplied out."""
    have = have.groupBy("id").agg(F.count(F.lit(1)).alias("_h"), F.collect_set("nbr").alias("_has"))
    need = F.least(F.lit(k), F.col("_n") - 1)
    base = rows.select("grp", "id").join(small_hint(sizes, n_groups), "grp")
    short = (base.join(have, "id", "left").withColumn("_h", F.coalesce("_h", F.lit(0)))
             .where(F.col("_h") < need).withColumn("_has", F.coalesce("_has", F.array().cast("array<bigint>"))))
    slots = F.ceil(F.col("_n") / F.lit(PAD_ROWS)).cast("bigint")
    slot = base.select("grp", F.col("id").alias("nbr"), F.pmod(F.xxhash64("id", F.lit(seed)), slots).alias("slot"))
    first = (slot.withColumn("_r", F.row_number().over(Window.partitionBy("grp", "slot").orderBy("nbr")))
             .where(F.col("_r") <= 2 * k + 1).drop("_r"))
    looks = short.select("grp", "id", "_has", (need - F.col("_h")).alias("_need"), F.explode(F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.lit(k)), lambda i: F.pmod(F.xxhash64("id", F.lit(seed + 1)) + i, slots)))).alias("slot"))
    met = looks.join(first, ["grp", "slot"]).where((F.col("nbr") != F.col("id")) & ~F.array_contains("_has", F.col("nbr")))
    pick = Window.partitionBy("id").orderBy(F.xxhash64("id", "nbr", F.lit(seed)), "nbr")
    return (met.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= F.col("_need"))
            .select("grp", "id", "nbr"))


def _pair_distance(batches):
    for batch in batches:
        if batch.num_rows:
            diff = matrix(batch.column("va")) - matrix(batch.column("vb"))
            dist = np.sqrt((diff * diff).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("a"), batch.column("b"), pa.array(dist)],
                                             names=["grp", "a", "b", "dist"])


def score_pairs(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``(grp, a, b)`` with their Euclidean ``dist``; ``vectors``: ``(id, vec)``."""
    both = (pairs.join(vectors.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
            .join(vectors.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b")
            .select("grp", "a", "b", "va", "vb"))
    return both.mapInArrow(_pair_distance, "grp long, a long, b long, dist double")


def _both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair as an entry of both lists (the pair is read once)."""
    entry = [F.struct(F.col(x).alias("id"), F.col(y).alias("nbr")) for x, y in (("a", "b"), ("b", "a"))]
    return pairs.select("grp", F.explode(F.array(*entry)).alias("_e"), "dist").select(
        "grp", "_e.id", "_e.nbr", "dist")


def _members(lists: DataFrame, pool: int, salt: int) -> DataFrame:
    """``(grp, v, u, new)``: the meeting of every vertex.

    ``lists`` has ``used`` (sampled in this round).  Of the vertices that list ``v`` at
    most ``pool`` new and ``pool`` old ones come, by a hash that changes with ``salt``."""
    fresh = lists.where("used or not new")
    ahead = fresh.select("grp", F.col("id").alias("v"), F.col("nbr").alias("u"), "new")
    back = fresh.select("grp", F.col("nbr").alias("v"), F.col("id").alias("u"), "new")
    pick = Window.partitionBy("v", "new").orderBy(F.xxhash64("v", "u", F.lit(salt)), "u")
    back = back.withColumn("_r", F.row_number().over(pick)).where(F.col("_r") <= pool).drop("_r")
    return ahead.unionByName(back)


def _sketch(batches):
    for batch in batches:
        if batch.num_rows:
            X = matrix(batch.column("vec"))
            with np.errstate(all="ignore"):
                scale = np.abs(X).max(axis=1, initial=0.0) / 127
                scale[~np.isfinite(scale)] = np.nan
                code = np.nan_to_num(np.rint(X / np.where(scale > 0, scale, 1.0)[:, None])).astype(np.int8)
                off = np.sqrt(((X - code * scale[:, None]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale), pa.array(off)],
                                             names=["id", "code", "scale", "off"])


def sketches(vectors: DataFrame) -> DataFrame:
    """``(id, code, scale, off)``: the vector as bytes times ``scale``, and its distance from that."""
    return vectors.select("id", "vec").mapInArrow(_sketch, "id long, code binary, scale double, off double")


def _meeting(batches):
    """The pairs of meetings that can enter a list, with bounds of their distance."""
    for batch in batches:
        parts = []
        for grp, m in zip(batch.column("grp").to_pylist(), range(batch.num_rows)):
            x = batch.column("m")[m].values
            u, new, bound, scale, off = (x.field(f).to_numpy(zero_copy_only=False) for f in ("u", "new", "bound", "scale", "off"))
            X = np.frombuffer(b"".join(x.field("code").to_pylist()), np.int8).reshape(len(u), -1) * scale[:, None]
            i, j = np.nonzero(new[:, None] & (u[:, None] != u) & (~new | (u[:, None] < u)))
            with np.errstate(all="ignore"):
                xx = (X * X).sum(axis=1)
                square = xx[:, None] + xx - 2.0 * (X @ X.T)
                slack = 1e-12 * (xx[:, None] + xx)
                apart = off[:, None] + off
                low = (np.sqrt(np.maximum(square - slack, 0.0)) - apart) * (1 - 1e-9)
                high = (np.sqrt(np.maximum(square + slack, 0.0)) + apart) * (1 + 1e-9)
                keep = ~(low[i, j] > np.maximum(bound[i], bound[j]))
            i, j = i[keep], j[keep]
            a, b = np.minimum(u[i], u[j]), np.maximum(u[i], u[j])
            parts.append((np.full(len(a), grp, np.int64), a, b, np.nan_to_num(low[i, j], nan=-np.inf), np.nan_to_num(high[i, j], nan=np.inf, posinf=np.inf)))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=["grp", "a", "b", "low", "high"])


def _pairs(members: DataFrame, lists: DataFrame, sketch: DataFrame, pool: int) -> DataFrame:
    """``(grp, a, b, low, high)``, a < b, of meetings (at most ``4 * pool`` members each) with a new entry."""
    last = lists.groupBy("id").agg(F.when(F.count(F.lit(1)) >= pool, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    bring = sketch.join(last, "id", "left").select(F.col("id").alias("u"), F.coalesce("bound", F.lit(float("inf"))).alias("bound"), "code", "scale", "off")
    met = members.join(bring, "u").groupBy("grp", "v").agg(
        F.collect_list(F.struct("u", "new", "bound", "code", "scale", "off")).alias("m"), F.max("new").alias("any"))
    return met.where("any").select("grp", "m").mapInArrow(_meeting, "grp long, a long, b long, low double, high double")


def _wanted(pairs: DataFrame, lists: DataFrame, pool: int) -> DataFrame:
    """``(grp, a, b)`` of the pairs that can be among the best ``pool`` of one of their rows: ``low`` is at most the
    ``pool``-th smallest ``high`` of the row's entries and pairs."""
    way = [F.struct(F.col(x).alias("id"), F.col(y).alias("nbr")) for x, y in (("a", "b"), ("b", "a"))]
    both = pairs.select("grp", F.explode(F.array(*way)).alias("_e"), "low", "high").select("grp", "_e.id", "_e.nbr", "low", "high")
    has = lists.select("grp", "id", F.lit(None).cast("long").alias("nbr"), F.col("dist").alias("low"), F.col("dist").alias("high"))
    w = Window.partitionBy("id")
    ranked = both.unionByName(has).withColumn("_r", F.row_number().over(w.orderBy("high")))
    most = F.max(F.when(F.col("_r") == pool, F.col("high"))).over(w)
    kept = ranked.withColumn("_most", most).where("nbr is not null and (_most is null or low <= _most)")
    return kept.select("grp", F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()


def _local_lists(rows: DataFrame, starts: DataFrame, both: bool, parts: int, pool: int, max_iter: int, sample_rate: float, seed: int) -> DataFrame:
    """All entries that the lists of small groups ever have, ``(grp, id, nbr, dist, came, gone, used)`` (see
    :func:`graphssl.operators.local.descend`): a group is one task's.  ``starts``: ``(id, nbr)``."""

    def solve(grp, table):
        ids, nbrs = table.column("id").to_numpy(), table.column("nbrs").chunk(0)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        row = np.repeat(place, nbrs.value_lengths().fill_null(0).to_numpy())
        ids = ids[order]
        row, nbr = local.start_pairs(ids, row, nbrs.flatten().to_numpy(zero_copy_only=False).astype(np.int64), both)
        row, nbr, *rest = local.descend(ids, matrix(table.column("features").chunk(0))[order], row, nbr, pool, max_iter,
                                        sample_rate, seed, PAD_ROWS)
        return dict(zip(("grp", "id", "nbr", "dist", "came", "gone", "used"),
                        (np.full(len(row), grp, np.int64), ids[row], ids[nbr], *rest)))

    begin = starts.groupBy("id").agg(F.collect_list("nbr").alias("nbrs"))
    return local.each_group(rows.join(begin, "id", "left").select("grp", "id", "features", "nbrs"), parts, solve,
                            "grp long, id long, nbr long, dist double, came long, gone long, used long")


def neighbour_lists(df: DataFrame, pool: int, max_iter: int = 5, early_termination: float = 0.001, sample_rate: float = 1.0,
                    buckets: int = 2, seed: int = 0, block_rows: int = DEFAULT_BLOCK_ROWS, code_rows: int | None = None,
                    start: DataFrame | None = None, stop_k: int | None = None, log: list | None = None,
                    local_rows: int = 0) -> DataFrame:
    """The lists of NN-Descent, ``(grp, id, nbr, dist, new)``, ``pool`` entries per row.

    ``start``: ``(id, nbr)`` entries of an earlier graph; those inside a group are scored anew and
    seed the lists beside the buckets.  Rounds end when fewer than ``early_termination * stop_k * rows`` entries
    are new.  ``log`` gets one dict per round (pairs met, pairs scored, entries new).  Groups of at most ``local_rows`` rows
    (unique ids; with buckets or ``start``, not both) run all rounds in one task each and keep what a list was after which
    round, so that the rounds end for them when they end for all."""
    rows = (df.where(~F.col("finished")) if "finished" in df.columns else df).select("grp", "id", "features")
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("features")).alias("_d"))
    small = F.col("_n") <= (F.lit(0) if buckets and start is not None else F.least(F.lit(local_rows), F.lit(LOCAL_CELLS) / F.col("_d")))
    total = sizes.agg(F.count(F.lit(1)).alias("g"), F.sum("_n").alias("n"), F.sum(F.when(small, 1).otherwise(0)).alias("small_g"),
                      F.sum(F.when(small, F.col("_n")).otherwise(0)).alias("small_n")).first()
    if not total["n"]:
        return rows.select("grp", "id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist"), F.lit(False).alias("new"))
    used, seeds = [], None
    if buckets or total["small_g"] < total["g"]:
        sizes = write_table(sizes, "sizes")
        used.append(sizes)
    sizes, little = sizes.drop("_d"), sizes.where(small).select("grp")
    if buckets:
        seeds = _bucket_lists(rows, sizes, total["g"], pool, buckets, seed, block_rows, code_rows or 2 * pool)
    entries, left = None, [0] * max_iter          # of small groups; entries that are new after each round
    if total["small_g"]:
        if seeds is not None:
            seeds = write_table(seeds, "seeds")
            used.append(seeds)
        mine = rows if total["small_g"] == total["g"] else rows.join(small_hint(little, total["g"]), "grp", "left_semi")
        parts = min(total["small_g"], int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total["small_n"] // 512))
        entries = write_table(_local_lists(mine, (start if seeds is None else seeds).select("id", "nbr") if start is not None or seeds is not None
                                           else rows.select("id", F.col("id").alias("nbr")).where("false"),
                                           start is not None, parts, pool, max_iter, sample_rate, seed), "entries")
        if max_iter:
            left = list(entries.agg(*[F.sum(((F.col("came") <= r) & (F.col("gone") > r) & (F.col("used") > r)).cast("long"))
                                      for r in range(max_iter)]).first())
    enough, last = early_termination * (stop_k or pool) * total["n"], max_iter - 1
    if total["small_g"] == total["g"]:
        last = next((r for r in range(max_iter) if left[r] <= enough), last)
        lists = None
    else:
        if entries is not None:
            rows = rows.join(small_hint(little, total["g"]), "grp", "left_anti")
            sizes = sizes.join(small_hint(little, total["g"]), "grp", "left_anti")
            seeds = seeds if seeds is None else seeds.join(small_hint(little, total["g"]), "grp", "left_anti")
        # written once, bucketed on the join key: the two joins of every round shuffle pairs only
        nbk = bucket_count(df.sparkSession, total["n"] - total["small_n"])
        vectors = rows.select("id", "grp", F.col("features").alias("vec"))
        vectors = (write_bucketed(vectors.repartition(nbk, "id"), "id", nbk, "vectors")
                   if nbk > 1 else write_table(vectors, "vectors"))
        vec = vectors.select("id", "vec")
        sketch = write_table(sketches(vectors), "sketch") if max_iter else None
        if start is not None:
            where = vectors.select("id", "grp")
            known = (start.select(F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b")).distinct()
                     .join(where.withColumnRenamed("id", "a"), "a")
                     .join(where.select(F.col("id").alias("b"), F.col("grp").alias("_g")), "b").where("grp = _g").select("grp", "a", "b"))
            warm = _both_ways(score_pairs(known, vec))
            seeds = warm if seeds is None else (
                seeds.unionByName(warm).groupBy("grp", "id", "nbr").agg(F.min("dist").alias("dist")))
        if seeds is None:
            seeds = rows.select("grp", "id", F.col("id").alias("nbr"), F.lit(0.0).alias("dist")).where("false")
        seeds = write_table(_best(seeds, pool).drop("rank"), "seeds")
        filled = _padding(rows, sizes, total["g"], seeds, pool, seed).withColumnsRenamed({"id": "a", "nbr": "b"})
        filled = score_pairs(filled, vec).withColumnsRenamed({"a": "id", "b": "nbr"})
        # a row that lists its whole group has nobody left to meet
        open_ = small_hint(sizes.select("grp", (F.col("_n") > pool + 1).alias("new")), total["g"])
        lists = write_table(seeds.unionByName(filled).join(open_, "grp").select("grp", "id", "nbr", "dist", "new"), "lists")
        scored: list[DataFrame] = []
        for rnd in range(max_iter):
            chosen = F.col("new")
            if sample_rate < 1.0:
                chosen = chosen & (F.pmod(F.xxhash64("id", "nbr", F.lit(seed), F.lit(rnd)), F.lit(1_000_000))
                                   < F.lit(int(sample_rate * 1_000_000)))
            now = lists.withColumn("used", chosen)
            met = _pairs(_members(now, pool, seed + rnd), lists, sketch, pool)
            # distinct and anti-join in one aggregate with a map-side part: a pair stays if all its rows are of this round
            met = met.withColumn("old", F.lit(0)).unionByName(lists.select(
                "grp", F.least("id", "nbr").alias("a"), F.greatest("id", "nbr").alias("b"), F.lit(1).alias("old")), allowMissingColumns=True)
            for old in scored:
                met = met.unionByName(old.select("grp", "a", "b", F.lit(1).alias("old")), allowMissingColumns=True)
            met = met.groupBy("grp", "a", "b").agg(F.max("old").alias("old"), F.max("low").alias("low"), F.min("high").alias("high"))
            met = _wanted(met.where("old = 0").drop("old"), lists, pool)
            done = write_table(score_pairs(met, vec), "scored")
            scored.append(done)
            had = now.select("grp", "id", "nbr", "dist", (F.col("new") & ~F.col("used")).alias("new"), F.lit(False).alias("came"))
            came = _both_ways(done).withColumns({"new": F.lit(True), "came": F.lit(True)})
            nxt = write_table(_best(had.unionByName(came), pool).drop("rank"), "lists")
            discard(lists)
            lists = nxt.drop("came")
            changed = nxt.agg(F.sum(F.col("came").cast("long")).alias("came"), F.sum(F.col("new").cast("long")).alias("new")).first()
            if log is not None:
                log.append({"round": rnd, "scored": done.count(), "came": changed["came"]})
            if changed["new"] + left[rnd] <= enough:
                last = rnd
                break
        for old in (*scored, seeds, vectors, *([sketch] if sketch is not None else [])):
            discard(old)
    if entries is not None:
        own = entries.where((F.col("came") <= last) & (F.col("gone") > last)).select(
            "grp", "id", "nbr", "dist", (F.col("used") > last).alias("new"))
        lists = write_table(own if lists is None else own.unionByName(lists), "lists")
        used.append(entries)
    for old in used:
        discard(old)
    return lists


def knn_descent(df: DataFrame, k: int, max_iter: int = 5, early_termination: float = 0.001,
                sample_rate: float = 1.0, buckets: int = 2, seed: int = 0,
                block_rows: int = DEFAULT_BLOCK_ROWS, pool: int | None = None,
                code_rows: int | None = None, start: DataFrame | None = None, log: list | None = None) -> DataFrame:
    """G1 (approximate): NN-Descent graph ``(id, nbr, grp, rank, dist, sim)``, the same
    method for groups of every size.

    The rounds keep ``pool`` (default ``5k``) neighbours per row and the best
    ``k`` of them are returned: a longer working list is what lets NN-Descent
    escape poor local graphs in high intrinsic dimension.  ``sample_rate`` is the share of new entries
    that a round uses; the others stay new.  ``code_rows`` (default ``2 * pool``) is the average size of a
    starting bucket; ``block_rows`` only sizes tasks and never changes the result."""
    lists = neighbour_lists(df, max(k, pool or 5 * k), max_iter, early_termination, sample_rate, buckets, seed, block_rows,
                            code_rows, start, k, log)
    return finish(lists, k)


def knn_lsh(df: DataFrame, k: int, buckets: int = 8, seed: int = 0,
            block_rows: int = DEFAULT_BLOCK_ROWS, code_rows: int = CODE_ROWS) -> DataFrame:
    """G1 (random-projection LSH): the best ``k`` per row among the rows that
    share one of its ``buckets`` random-hyperplane buckets of ``code_rows`` rows on
    average (exact inside each bucket, crowded buckets split into blocks), padded
    as in NN-Descent.  This is NN-Descent's seeding stage without rounds; its
    recall grows with ``buckets`` and ``code_rows``, never with ``block_rows``."""
    return finish(neighbour_lists(df, k, 0, buckets=buckets, seed=seed, block_rows=block_rows, code_rows=code_rows), k)
