"""Column expressions over ``array<double>`` feature vectors.

Everything here is a JVM-side expression (no Python per row).  Divisions use
``try_divide``/``nullif`` so ANSI mode never raises on a zero range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def multiply(a, b) -> Column:
    """Element-wise product; unequal sizes raise (like the reference)."""
    a, b = _c(a), _c(b)
    checked = F.when(F.size(a) == F.size(b), a).otherwise(
        F.raise_error(F.lit("multiply: the two arrays differ in length")))
    return F.zip_with(checked, b, lambda x, y: x * y)


def subtract(a, b) -> Column:
    """Element-wise difference; unequal sizes raise."""
    a, b = _c(a), _c(b)
    checked = F.when(F.size(a) == F.size(b), a).otherwise(
        F.raise_error(F.lit("subtract: the two arrays differ in length")))
    return F.zip_with(checked, b, lambda x, y: x - y)


def ones(size) -> Column:
    """Vector of ``size`` ones (``size`` is an int or an integer column)."""
    size = F.lit(size) if isinstance(size, int) else _c(size)
    return F.array_repeat(F.lit(1.0), size)


def to_double_array(col) -> Column:
    """Cast a numeric array (e.g. ``array<float>``) to ``array<double>``."""
    return F.transform(_c(col), lambda x: x.cast("double"))


def sign(x) -> Column:
    """-1/0/+1 with NaN -> 0 (integer signum semantics of the reference)."""
    x = _c(x)
    return (F.when(F.isnan(x), F.lit(0))
            .when(x < 0, F.lit(-1))
            .when(x > 0, F.lit(1))
            .otherwise(F.lit(0)))
