"""ReliefF goldens (survey tables) and edge cases."""
import pytest
from pyspark.sql import functions as F

from fixture_paths import IRIS, SF
from graphssl.operators.relief import (apply_weights, labelled_rows, relief_weights, sample_key,
                                       sample_probes, weight_vectors)
from graphssl.sources.loaders import from_rows, load_iris


def _state(df):
    return df.withColumn("grp", F.lit(0).cast("bigint")).withColumn("finished", F.lit(False))


@pytest.fixture(scope="module")
def iris_all_labelled(spark):
    inp, truth = load_iris(spark, IRIS)
    return _state(inp.drop("label").join(truth, "id").withColumnRenamed("correct_label", "label"))


def _weights(df, **kw):
    return [r.weight for r in relief_weights(df, **kw).orderBy("pos").collect()]


def test_toy_nine_points(spark):
    pts = [(x, y) for x in (-1, 0, 1) for y in (0, 1, 2)]
    df = _state(from_rows(spark, [(i, [float(x), float(y)], y) for i, (x, y) in enumerate(pts)]))
    assert _weights(df, m=9, k=1) == pytest.approx([0.0, 1.0], abs=1e-5)


def test_iris_k1(iris_all_labelled):
    assert _weights(iris_all_labelled, m=150, k=1) == pytest.approx(
        [0.4280122, 0.4870958, 0.9579036, 1.0], abs=1e-2)


def test_iris_k10(iris_all_labelled):
    assert _weights(iris_all_labelled, m=150, k=10) == pytest.approx(
        [0.4294832, 0.3873913, 0.960238, 1.0], abs=1e-2)


def test_blocking_does_not_change_weights(iris_all_labelled):
    a = _weights(iris_all_labelled, m=None, k=3, block_rows=16)
    b = _weights(iris_all_labelled, m=None, k=3, block_rows=4096)
    assert a == pytest.approx(b, abs=1e-12)


def test_sample_is_deterministic_and_sized(spark, iris_all_labelled):
    lab = labelled_rows(iris_all_labelled)
    a = sorted(r.id for r in sample_probes(lab, 20, seed=3).collect())
    b = sorted(r.id for r in sample_probes(lab, 20, seed=3).collect())
    assert a == b and len(a) == 20 and len(set(a)) == 20
    assert sample_probes(lab, 1000, seed=3).count() == 150


def test_single_class_group_gets_ones(spark):
    df = _state(from_rows(spark, [(i, [float(i), 1.0], 0) for i in range(6)] + [(9, [0.5, 0.5], None)]))
    out = apply_weights(df, relief_weights(df, k=1))
    assert relief_weights(df, k=1).count() == 0
    assert sorted(tuple(r.features) for r in out.collect()) == sorted(
        tuple(r.features) for r in df.collect())


def test_constant_feature_gets_bias_weight(spark):
    rows = [(i, [float(i % 3), 5.0, float(i % 2)], i % 2) for i in range(12)]
    w = _weights(_state(from_rows(spark, rows)), k=1)
    assert w[2] == pytest.approx(1.0)
    assert w[1] == pytest.approx(0.1 / 1.1)


def test_weight_vectors_in_feature_order(iris_all_labelled):
    v = weight_vectors(relief_weights(iris_all_labelled, k=1)).first()["weights"]
    assert v == pytest.approx([0.4284405, 0.4893602, 0.9571119, 1.0], abs=1e-6)


def test_salted_sampling_equals_plain_top_m(spark, iris_all_labelled, monkeypatch):
    from pyspark.sql import Window

    import graphssl.operators.relief as R
    monkeypatch.setattr(R, "_SAMPLE_SALT_ROWS", 8)        # ~19 salts for 150 rows
    lab = labelled_rows(iris_all_labelled).withColumn("grp", F.col("label"))
    got = sorted((r.grp, r.id) for r in sample_probes(lab, 7, seed=11).collect())
    h = sample_key(F.col("id"), 11)
    w = Window.partitionBy("grp").orderBy(h, "id")
    exp = sorted((r.grp, r.id) for r in
                 lab.withColumn("_r", F.row_number().over(w)).where("_r <= 7").collect())
    assert got == exp and len(got) == 21


def test_windows_hold_no_vectors(spark):
    """Ranking and counting run over ids and distances; vectors come back for the winners only."""
    from graphssl.plans.catalog import base
    from graphssl.operators import relief as R
    lab = R.labelled_rows(base(spark, SF))
    rng = R.range_vectors(R.feature_ranges(lab))
    n = R.relief_neighbours(lab, lab, rng, 3)
    assert not [f.name for f in n.schema if f.dataType.typeName() == "array"]
    plan = R.raw_weights(n, lab, lab, R.class_priors(lab), rng)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window " in line:
            assert "features" not in line and "vec" not in line
