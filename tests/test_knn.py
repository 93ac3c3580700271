"""kNN graphs: blocked exact search against brute force, NN-Descent recall."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fixture_paths import IRIS, SF
from graphssl.operators.descent import knn_descent, knn_lsh
from graphssl.operators.knn import knn_exact
from graphssl.operators.metrics import neighbour_recall
from graphssl.sources.loaders import load_embeddings, load_iris


def _brute(pdf, k):
    X = np.stack(pdf.features.values)
    ids, grp = pdf.id.values, pdf.grp.values
    out = {}
    for i in range(len(ids)):
        m = (grp == grp[i]) & (ids != ids[i])
        d = np.sqrt(((X[m] - X[i]) ** 2).sum(1))
        out[ids[i]] = list(ids[m][np.lexsort((ids[m], d))[:k]])
    return out


@pytest.mark.parametrize("block_rows", [7, 40, 4096])
def test_exact_matches_brute_force(spark, block_rows):
    df = load_embeddings(spark, SF).withColumn("grp", F.pmod("id", F.lit(3))) \
        .withColumn("finished", F.lit(False))
    g = knn_exact(df, 4, block_rows=block_rows).toPandas()
    exp = _brute(df.toPandas(), 4)
    got = {i: list(s.sort_values("rank").nbr) for i, s in g.groupby("id")}
    assert got == exp


def test_exact_skips_finished_rows(spark):
    df = load_embeddings(spark, SF).withColumn("grp", F.pmod("id", F.lit(2))) \
        .withColumn("finished", F.col("grp") == 1)
    g = knn_exact(df, 3)
    assert g.where("grp = 1").count() == 0
    assert g.select("id").distinct().count() == df.where("grp = 0").count()


@pytest.fixture(scope="module")
def iris_state(spark):
    inp, _ = load_iris(spark, IRIS)
    return inp.withColumn("grp", F.lit(0).cast("bigint")).withColumn("finished", F.lit(False))


def test_descent_recall_iris(iris_state):
    # the reference's NN-Descent test: k=5, 5 rounds, early termination 0.001,
    # sample rate 1, 2 buckets; > 95 % of neighbours shared with the true graph
    approx = knn_descent(iris_state, 5, max_iter=5, early_termination=0.001, sample_rate=1.0,
                         buckets=2, code_rows=16, block_rows=32)
    rec = neighbour_recall(approx, knn_exact(iris_state, 5)).first()
    assert rec.n_rows == 150 and rec.recall > 0.95


def test_descent_every_row_has_k(iris_state):
    approx = knn_descent(iris_state, 5, max_iter=1, code_rows=16, block_rows=16, sample_rate=0.5)
    counts = {r["count"] for r in approx.groupBy("id").count().collect()}
    assert counts == {5}
    assert approx.where("id = nbr").count() == 0


def test_lsh_graph_has_k_per_row(spark):
    df = load_embeddings(spark, SF).withColumn("grp", F.pmod("id", F.lit(2))) \
        .withColumn("finished", F.lit(False))
    g = knn_lsh(df, 4, code_rows=32)
    counts = {r["count"] for r in g.groupBy("id").count().collect()}
    assert counts == {4}
    assert g.where("id = nbr").count() == 0
    # every edge stays inside its group
    j = g.join(df.select(F.col("id").alias("nbr"), F.col("grp").alias("ngrp")), "nbr")
    assert j.where("grp != ngrp").count() == 0


def test_packed_small_groups_match_brute_force(spark):
    # 40 groups of ~12 rows with 16-row blocks: every group fits one block and
    # groups are packed several per task, over many tasks
    df = load_embeddings(spark, SF).withColumn("grp", F.pmod("id", F.lit(40))) \
        .withColumn("finished", F.lit(False))
    g = knn_exact(df, 3, block_rows=16).toPandas()
    exp = _brute(df.toPandas(), 3)
    got = {i: list(s.sort_values("rank").nbr) for i, s in g.groupby("id")}
    assert got == exp


def test_descent_rounds_run_and_move_less(spark):
    """One group of all rows: rounds run, each later one scores fewer pairs, none twice."""
    df = load_embeddings(spark, "/root/testdata/sf0.01").withColumn("grp", F.lit(0).cast("bigint")).withColumn("finished", F.lit(False))
    log = []
    g = knn_descent(df, 5, pool=10, max_iter=8, log=log)
    assert {r["count"] for r in g.groupBy("id").count().collect()} == {5}
    n = df.count()
    scored = [r["scored"] for r in log]
    assert len(log) > 2 and scored[-1] < max(scored) / 4 and sum(scored) <= n * (n - 1) // 2


def test_descent_starts_from_an_earlier_graph(spark):
    df = load_embeddings(spark, SF).withColumn("grp", F.pmod("id", F.lit(2))).withColumn("finished", F.lit(False))
    exact = knn_exact(df.withColumn("grp", F.lit(0).cast("bigint")), 30)
    first, warm = [], []
    knn_descent(df, 4, pool=8, buckets=1, log=first)
    g = knn_descent(df, 4, pool=8, buckets=0, start=exact.select("id", "nbr"), log=warm)
    assert neighbour_recall(g, knn_exact(df, 4)).first().recall > 0.95
    assert sum(r["came"] for r in warm) < sum(r["came"] for r in first)
    j = g.join(df.select(F.col("id").alias("nbr"), F.col("grp").alias("ngrp")), "nbr")
    assert j.where("grp != ngrp").count() == 0


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, 0, [float(i % 2), 0.0], False) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, grp long, features array<double>, finished boolean")
    for g in (knn_exact(df, 3, block_rows=9), knn_exact(df, 3), knn_descent(df, 3, pool=39)):
        got = g.groupBy("id").agg(F.sort_array(F.collect_list("nbr")).alias("n")).collect()
        assert all(r["n"] == [x for x in range(40) if x % 2 == r["id"] % 2 and x != r["id"]][:3] for r in got)


def test_pruned_search_scores_few_block_pairs_on_clusters(spark):
    """Clustered rows: most block pairs are never scored, and the result is that of all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 40
    X = np.concatenate([c + rng.normal(size=(60, 6)) for c in centres] + [np.repeat(centres[:1], 30, 0)])   # repeated points too
    df = spark.createDataFrame([(i, i % 2, X[i].tolist(), False) for i in range(len(X))],
                               "id long, grp long, features array<double>, finished boolean")
    log = {}
    g = knn_exact(df, 4, block_rows=30, log=log).toPandas()
    got = {i: list(s.sort_values("rank").nbr) for i, s in g.groupby("id")}
    assert got == _brute(df.toPandas(), 4)
    assert log["blocks"] > 12 and log["met"] < log["pairs"] / 2


def test_pruned_and_packed_groups_together(spark):
    df = load_embeddings(spark, SF).withColumn("grp", F.when(F.col("id") % 9 == 0, 1).otherwise(0).cast("long")) \
        .withColumn("finished", F.lit(False))
    g = knn_exact(df, 3, block_rows=40).toPandas()
    got = {i: list(s.sort_values("rank").nbr) for i, s in g.groupby("id")}
    assert got == _brute(df.toPandas(), 3)


def test_exact_of_nothing(spark):
    df = load_embeddings(spark, SF).withColumn("grp", F.lit(0).cast("long")).withColumn("finished", F.lit(True))
    assert knn_exact(df, 3).collect() == [] and knn_descent(df, 3).collect() == []


def test_tiles_meet_once_and_lose_nothing(spark):
    """Many tiles of many blocks, with copies, no clusters and small groups: the search is that of all pairs."""
    from graphssl.operators.pivots import pivot_top_k

    rng = np.random.default_rng(11)
    X = np.concatenate([rng.normal(size=(260, 8)), rng.normal(size=(120, 8)) * 0.01 + 30, np.repeat(rng.normal(size=(2, 8)), 25, 0),
                        rng.normal(size=(3, 8)) * 1e6])
    df = spark.createDataFrame([(i, i % 11 // 10, X[i].tolist()) for i in rng.permutation(len(X)).tolist()],
                               "id long, grp long, features array<double>")
    log = {}
    g = pivot_top_k(df, 4, 12, log, tile_rows=50).toPandas()
    got = {i: list(s.sort_values("rank").cid) for i, s in g.groupby("qid")}
    assert got == _brute(df.toPandas(), 4)
    assert log["met"] < log["pairs"]


def test_screened_distances_are_the_plain_ones():
    """Far from the origin, with copies and with numbers that overflow: the same neighbours and distances as all pairs."""
    from graphssl.operators.knn import _block_distances, _top_k_rows, nearest

    rng = np.random.default_rng(4)
    for shift, scale in ((0, 1), (1e7, 1), (0, 1e-9), (0, 1e200)):
        C = np.concatenate([rng.normal(size=(90, 5)) * scale + shift] * 2 + [np.zeros((4, 5))])
        cid, ids = rng.permutation(len(C)), np.arange(40)
        D = _block_distances(C[:40], C, "euclidean", None)
        D[ids[:, None] == cid[None, :]] = np.inf
        r, c = _top_k_rows(D, cid, 6)
        got = nearest(C[:40], C, cid, 6, ids, cid)
        assert np.array_equal(got[0], r) and np.array_equal(cid[got[1]], cid[c]) and np.array_equal(got[2], D[r, c])


def test_sketches_leave_out_only_pairs_beyond_both_lists():
    import pyarrow as pa

    from graphssl.operators.descent import _meeting, _sketch

    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(size=(40, 16)), np.zeros((2, 16)), rng.normal(size=(6, 16)) * 1e-9 + 50, [[np.nan] * 16]])
    n, new, bound = len(X), rng.random(len(X)) < 0.5, rng.random(len(X)) * 6
    sketch = next(_sketch([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(list(X), pa.list_(pa.float64()))], names=["id", "vec"])]))
    cols = {"u": sketch["id"], "new": pa.array(new), "bound": pa.array(bound), **{c: sketch[c] for c in ("code", "scale", "off")}}
    pad = pa.StructArray.from_arrays(list(cols.values()), names=list(cols))
    meeting = pa.RecordBatch.from_arrays([pa.array([0, 7]), pa.ListArray.from_arrays(pa.array([0, 3, n], pa.int32()), pad)], names=["grp", "m"])
    got = next(_meeting([meeting])).to_pandas()
    D = np.sqrt(((X[:, None] - X[None]) ** 2).sum(2))
    by = {(r.grp, r.a, r.b): (r.low, r.high) for r in got.itertuples()}
    left = 0
    for grp, of in ((0, range(3)), (7, range(3, n))):
        for i in of:
            for j in of:
                if i < j and (new[i] or new[j]):
                    if (grp, i, j) not in by:
                        left += 1
                        assert D[i, j] > max(bound[i], bound[j])
                    elif np.isfinite(D[i, j]):
                        assert by[grp, i, j][0] <= D[i, j] <= by[grp, i, j][1]
    assert left > 100 and all(i < j and (new[i] or new[j]) for _, i, j in by)
