"""Bisection: distributed lock-step loop == per-group loop; split invariants."""
import pytest
from pyspark.sql import functions as F

from fixture_paths import SF
from graphssl.operators.bisect import (bisect_distributed, bisect_local, build_graph,
                                       divide_groups, score_groups)
from graphssl.operators.knn import knn_exact
from graphssl.sources.loaders import load_embeddings, mask_labels


@pytest.fixture(scope="module")
def state(spark):
    df = mask_labels(load_embeddings(spark, SF), 0, 20, by="id")
    return df.withColumn("grp", F.pmod("id", F.lit(3)).cast("bigint")) \
        .withColumn("finished", F.col("grp") == 2)


@pytest.fixture(scope="module")
def graph(state):
    knn = knn_exact(state, 5).cache()
    return knn, build_graph(state, knn)


def test_distributed_equals_local(graph):
    _, (v, e) = graph
    a = {r.id: r.m for r in bisect_distributed(v, e, 2, max_steps=6).collect()}
    b = {r.id: r.m for r in bisect_local(v, e, max_steps=6).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)


@pytest.mark.parametrize("max_stable,buckets", [(2, None), (4, None), (2, 3)])
def test_converged_local_equals_distributed(graph, max_stable, buckets):
    """Equal scores and equal step counts; the groups freeze at their own steps."""
    _, (v, e) = graph
    a = {r.id: (r.m, r.steps) for r in
         bisect_distributed(v, e, 2, max_steps=60, max_stable=max_stable, buckets=buckets).collect()}
    b = {r.id: (r.m, r.steps) for r in bisect_local(v, e, max_steps=60, max_stable=max_stable).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[i][0] - b[i][0]) < 1e-8 and a[i][1] == b[i][1] for i in a)


def test_a_group_without_mass_does_not_move(spark):
    v = spark.createDataFrame([(i, 0, False, 0.0, 0.0, False) for i in range(4)],
                              "id bigint, grp bigint, lab boolean, m double, l double, frozen boolean")
    e = spark.createDataFrame([(i, (i + 1) % 4, 0, 0.5) for i in range(4)], "src bigint, dst bigint, grp bigint, a double")
    for s in (bisect_distributed(v, e, 1, max_steps=5, max_stable=2), bisect_local(v, e, max_steps=5, max_stable=2)):
        assert [(r.m, r.steps) for r in s.collect()] == [(0.0, 2)] * 4


def test_hub_sources_give_the_same_scores(graph, monkeypatch):
    from graphssl.operators import bisect
    _, (v, e) = graph
    a = {r.id: r.m for r in bisect_distributed(v, e, 2, max_steps=3).collect()}
    monkeypatch.setattr(bisect, "HUB_EDGES", 9)
    b = {r.id: r.m for r in bisect_distributed(v, e, 2, max_steps=3).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_both_sides_get_labelled_rows(state, graph):
    knn, _ = graph
    scores = score_groups(state, knn, max_steps=40)
    lab = scores.join(state.select("id", "label"), "id").where("label is not null")
    sides = {(r.grp, r.neg) for r in lab.select("grp", (F.col("m") < 0).alias("neg")).distinct().collect()}
    assert sides == {(0, True), (0, False), (1, True), (1, False)}


def test_divide_groups_invariants(state, graph):
    knn, _ = graph
    out = divide_groups(state, knn, max_steps=5, local_group_rows=0)
    assert out.count() == state.count()
    assert out.select("id").distinct().count() == state.count()
    groups = {r.grp for r in out.select("grp").distinct().collect()}
    assert groups <= {0, 1, 2, 3, 4}          # new ids = old + max(2) + 1
    assert out.where("grp = 2").count() == state.where("grp = 2").count()   # finished kept


def test_bucketed_tables_give_the_same_scores(graph):
    _, (v, e) = graph
    a = {r.id: r.m for r in bisect_distributed(v, e, 2, max_steps=4, buckets=3).collect()}
    b = {r.id: r.m for r in bisect_local(v, e, max_steps=4).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a)
