"""Vector expressions (cases F9)."""
import pytest
from pyspark.sql import functions as F

from graphssl.functions.vectors import multiply, ones, sign, subtract


def _one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_multiply(spark):
    assert _one(spark, multiply(F.array(F.lit(2.0), F.lit(3.0)),
                                F.array(F.lit(-1.0), F.lit(1.5)))) == [-2.0, 4.5]


def test_subtract(spark):
    assert _one(spark, subtract(F.array(F.lit(2.0), F.lit(3.0)),
                                F.array(F.lit(-1.0), F.lit(1.5)))) == [3.0, 1.5]


def test_ones(spark):
    assert _one(spark, ones(3)) == [1.0, 1.0, 1.0]


@pytest.mark.parametrize("fn", [multiply, subtract])
def test_size_mismatch_raises(spark, fn):
    with pytest.raises(Exception):
        _one(spark, fn(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(1.0))))


def test_sign_nan_is_zero(spark):
    row = spark.range(1).select(sign(F.lit(float("nan"))).alias("a"), sign(F.lit(-0.0)).alias("b"),
                                sign(F.lit(-2.0)).alias("c"), sign(F.lit(3.0)).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == (0, 0, -1, 1)
