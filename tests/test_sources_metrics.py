"""Loaders (EMNIST-style CSV with constant pixels, saved graphs), metrics and
schema checks on small hand-made inputs."""
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphssl.operators import diagnostics as D
from graphssl.operators.metrics import confusion, g_mean, success_rate
from graphssl.operators.relief import relief_weights
from graphssl.sources.loaders import EMNIST_PIXELS, load_emnist, mask_labels, read_graph


@pytest.fixture(scope="module")
def emnist_csv(tmp_path_factory):
    path = tmp_path_factory.mktemp("emnist") / "emnist.csv"
    lines = []
    for i in range(40):
        label = i % 2
        pixels = [0.0] * EMNIST_PIXELS            # mostly constant-zero pixels
        for j in range(10):
            pixels[100 + j + 20 * label] = float((i * 7 + j) % 5 + 1)
        lines.append(",".join([str(label)] + [f"{p:g}" for p in pixels]))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_emnist_loader(spark, emnist_csv):
    rows, truth = load_emnist(spark, emnist_csv, partitions=3, lo=0, hi=100)
    assert rows.count() == 40 and truth.count() == 40
    r = rows.first()
    assert len(r.features) == EMNIST_PIXELS
    assert rows.where("label is null").count() == 0          # [0, 100) keeps every label
    assert rows.schema["label"].dataType == T.LongType()


def test_constant_pixels_get_bias_weight(spark, emnist_csv):
    rows, _ = load_emnist(spark, emnist_csv, lo=0, hi=100)
    st = rows.withColumn("grp", F.lit(0).cast("bigint")).withColumn("finished", F.lit(False))
    w = {r.pos: r.weight for r in relief_weights(st, k=2).collect()}
    assert len(w) == EMNIST_PIXELS
    assert w[0] == pytest.approx(0.1 / 1.1)                  # constant feature
    assert max(w.values()) == pytest.approx(1.0)


def test_mask_by_features_is_deterministic(spark):
    df = spark.createDataFrame([(i, [float(i % 3)], i % 2) for i in range(30)],
                               "id bigint, features array<double>, correct_label bigint")
    m = mask_labels(df, 0, 50)
    kept = {tuple(r.features): r.label is not None for r in m.collect()}
    again = {tuple(r.features): r.label is not None for r in mask_labels(df, 0, 50).collect()}
    assert kept == again
    # identical vectors share one fate
    per_vec = m.groupBy("features").agg(F.count_distinct(F.col("label").isNull()).alias("n"))
    assert per_vec.where("n > 1").count() == 0


def test_read_graph(spark, tmp_path):
    out = str(tmp_path / "graph")
    schema = "id bigint, neighbors array<struct<id: bigint, similarity: double>>"
    spark.createDataFrame([(1, [(2, 0.5), (3, 0.25)]), (2, [(1, 0.5)])], schema).write.parquet(out)
    got = sorted((r.id, r.nbr, r.sim) for r in read_graph(spark, out).collect())
    assert got == [(1, 2, 0.5), (1, 3, 0.25), (2, 1, 0.5)]


def _pred(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label bigint, prediction bigint, correct_label bigint")


def test_success_rate_counts_only_unlabelled(spark):
    df = _pred(spark, [(0, 1, 0, 0), (1, None, 1, 1), (2, None, 0, 1), (3, None, 1, 1)])
    r = success_rate(df).first()
    assert (r.n_unlabelled, r.n_correct) == (3, 2)
    assert r.success_rate == pytest.approx(2 / 3)
    assert success_rate(df.where("label is not null")).first().success_rate is None


def test_confusion_and_g_mean(spark):
    df = _pred(spark, [(0, None, 1, 1), (1, None, 1, 1), (2, None, 0, 1), (3, None, 0, 0),
                       (4, None, 1, 0), (5, 1, 0, 0)])
    c = confusion(df).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (2, 1, 2, 1)
    assert g_mean(df).first().g_mean == pytest.approx((2 / 3 * 2 / 3) ** 0.5)


def test_confusion_rejects_more_classes(spark):
    with pytest.raises(Exception):
        confusion(_pred(spark, [(0, None, 2, 1)])).collect()


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "id bigint, x double")
    D.has_column(df, "id", T.LongType())
    D.has_columns(df, ["id", "x"])
    with pytest.raises(AssertionError):
        D.has_column(df, "id", T.DoubleType())
    with pytest.raises(AssertionError):
        D.has_columns(df, ["id", "y"])
    with pytest.raises(AssertionError):
        D.column_is_unique(df, "id")
    D.column_is_unique(df, "x")


def test_partition_reports(spark):
    df = spark.range(100).repartition(4)
    rows = D.partition_rows(df).collect()
    assert sum(r.n for r in rows) == 100
    s = D.partition_skew(df).first()
    assert s.skew == pytest.approx(s.max_rows / s.min_rows)


def test_row_numbers_follow_from_the_rows(spark):
    from graphssl.sources.loaders import number_rows
    rows = [(i % 7, [float(i % 5), float(i % 3)]) for i in range(200)] + [(None, [0.0, 1.0]), (None, None)]
    df = spark.createDataFrame(rows, "label long, features array<double>")
    one = sorted((r["id"], r["label"], r["features"]) for r in number_rows(df.repartition(1)).select("id", "label", "features").collect()
                 if r["features"] and r["label"] is not None)
    many = number_rows(df.repartition(13))
    two = sorted((r["id"], r["label"], r["features"]) for r in many.collect() if r["features"] and r["label"] is not None)
    assert one == two and sorted(r["id"] for r in many.collect()) == list(range(202))
    assert number_rows(df.where("false")).collect() == []


def test_wide_and_odd_csv_lines(spark, tmp_path):
    from graphssl.sources.loaders import load_emnist
    wide = [[k] + [(k * 31 + i) % 256 / 255 for i in range(784)] for k in range(12)]
    (tmp_path / "wide.csv").write_text("\n".join(",".join(map(str, r)) for r in wide) + "\n\n")
    rows, truth = load_emnist(spark, str(tmp_path / "wide.csv"))
    got = {r["correct_label"]: r["features"] for r in rows.join(truth, "id").collect()}
    assert got == {r[0]: r[1:] for r in wide}
    assert rows.schema["features"].dataType.simpleString() == "array<double>"
    (tmp_path / "odd.csv").write_text("3, 1.5,2e-3\n4,x,\n5,1\n6,1,2,3\n")
    rows, truth = load_emnist(spark, str(tmp_path / "odd.csv"), n_features=2)
    got = {r["correct_label"]: r["features"] for r in rows.join(truth, "id").collect()}
    assert got == {3: [1.5, 0.002], 4: [None, None], 5: [1.0, None], 6: [1.0, 2.0]}


def test_empty_partitions_are_reported(spark):
    from graphssl.operators.diagnostics import partition_rows, partition_skew
    df = spark.range(3).repartitionById(6, (F.col("id") * 2).cast("int"))
    assert sorted((r["partition"], r["n"]) for r in partition_rows(df).collect()) == [(0, 1), (1, 0), (2, 1), (3, 0), (4, 1), (5, 0)]
    r = partition_skew(df).first()
    assert (r["max_rows"], r["min_rows"], r["n_empty"], r["skew"], r["over_mean"]) == (1, 0, 3, None, 2.0)
