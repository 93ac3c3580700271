"""Small groups in one task each: the same rows as the plans for big groups, in few jobs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from fixture_paths import IRIS
from graphssl.operators import knn, local
from graphssl.operators.bisect import bisect_local, build_graph, score_groups
from graphssl.operators.descent import neighbour_lists
from graphssl.operators.knn import knn_exact
from graphssl.operators.relief import relief_weights
from graphssl.plans.classifier import Params, classify
from graphssl.sources.loaders import load_iris


@pytest.fixture(scope="module")
def state(spark):
    """Groups of 160, 70, 20 and 5 rows; every eighth vector is a copy, two thirds are labelled."""
    rng = np.random.default_rng(3)
    grp = np.repeat([0, 1, 2, 3], [160, 70, 20, 5])
    X = rng.standard_normal((len(grp), 6)) * 10
    X[8::8] = X[:-8:8]
    X[:, 4] = 1.5
    ids = rng.permutation(np.arange(-100, 2000))[:len(grp)]
    rows = [(int(i), [float(v) for v in x], None if i % 3 == 0 else int(i % 4), int(g), False) for i, x, g in zip(ids, X, grp)]
    return spark.createDataFrame(rows, "id long, features array<double>, label long, grp long, finished boolean").coalesce(2).cache()


def lists(df):
    return sorted(map(tuple, df.select("grp", "id", "nbr", "dist", "new").collect()))


def test_hashes_are_those_of_spark(spark):
    ids = [0, 1, -1, 7_000_000_000, -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(i, 3 - i // 2) for i in ids], "a long, b long")
    got = [r[0] for r in df.select(F.xxhash64("a", "b", F.lit(7), F.lit(-2))).collect()]
    mine = local.hash_long(np.array([3 - i // 2 for i in ids]), local.hash_long(np.array(ids)))
    assert local.hash_int(-2, local.hash_int(7, mine)).astype(np.int64).tolist() == got


@pytest.mark.parametrize("local_rows", [100, 1000])
@pytest.mark.parametrize("rate", [1.0, 0.5])
def test_lists_of_small_groups(state, local_rows, rate):
    cold = neighbour_lists(state, 8, 3, 0.01, rate, 2, 5)
    assert lists(neighbour_lists(state, 8, 3, 0.01, rate, 2, 5, local_rows=local_rows)) == lists(cold)
    moved = state.withColumn("grp", F.when(F.col("id") % 3 == 0, F.col("grp") + 4).otherwise(F.col("grp")))
    warm = neighbour_lists(moved, 8, 3, 0.01, rate, 0, 6, start=cold, stop_k=4)
    assert lists(neighbour_lists(moved, 8, 3, 0.01, rate, 0, 6, start=cold, stop_k=4, local_rows=local_rows)) == lists(warm)


def test_screened_descent(monkeypatch):
    rng = np.random.default_rng(1)
    X = np.repeat(rng.standard_normal((300, 5)), 2, axis=0) + 1000.0
    X[1::2] += rng.standard_normal((300, 5)) * np.array([[0.0]] * 100 + [[1e-3]] * 200)
    ids, start = np.arange(600) * 3, np.repeat(np.arange(600), 2)
    begin = local.start_pairs(ids, start, ids[rng.integers(0, 600, len(start))], True)
    a = local.descend(ids, X, *begin, 10, 4, 1.0, 2, 64)
    monkeypatch.setattr(local, "_screen", lambda X: (None, None))
    b = local.descend(ids, X, *begin, 10, 4, 1.0, 2, 64)
    assert sorted(zip(*map(np.ndarray.tolist, a))) == sorted(zip(*map(np.ndarray.tolist, b)))


@pytest.mark.parametrize("m", [None, 9])
def test_weights_of_small_groups(state, m):
    def weights(**more):
        return {(r.grp, r.pos): r.weight for r in relief_weights(state, m, 3, 4, **more).collect()}

    whole = weights()
    assert len(whole) >= 18
    for rows in (60, 1000):
        assert weights(local_rows=rows) == pytest.approx(whole, abs=1e-9)


def test_screened_classes(monkeypatch):
    rng = np.random.default_rng(5)
    X = np.round(rng.standard_normal((400, 4)) * 2) + 1e6          # many ties
    X[:, 2] = 3.0
    ids, cls = rng.permutation(1000)[:400], rng.integers(0, 3, 400)
    args = (X, X, np.ptp(X, axis=0), ids, [np.flatnonzero(cls == c) for c in range(3)], 3, ids[:, None] == ids)
    a = knn.nearest_by_class(*args)
    monkeypatch.setattr(knn, "_rough_relief", lambda *x: None)
    for x, y in zip(a, knn.nearest_by_class(*args)):
        assert np.array_equal(x, y)


def test_scores_of_small_groups(state):
    graph = knn_exact(state, 4)
    whole = {r.id: (r.grp, r.steps, r.m) for r in bisect_local(*build_graph(state, graph), max_steps=50, max_stable=3).collect()}
    got = {r.id: (r.grp, r.steps, r.m) for r in score_groups(state, graph, max_steps=50, max_stable=3).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in whole.items()}
    assert {k: v[2] for k, v in got.items()} == pytest.approx({k: v[2] for k, v in whole.items()}, abs=1e-9)


def test_jobs_of_an_iteration(spark):
    """An iteration over small groups is a few jobs (about 180 before)."""
    inp, _ = load_iris(spark, IRIS, 0, 8)

    def jobs():
        n = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
        return int(n.get() if hasattr(n, "get") else n)

    def run(max_iter):
        at = jobs()
        out, n = classify(inp, Params(k=5, gini_impurity=0.0, max_iter=max_iter))
        out.write.format("noop").mode("overwrite").save()
        assert n == max_iter
        return jobs() - at

    run(1)
    assert run(3) - run(1) < 2 * 80
