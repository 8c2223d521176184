"""Expressions on ``ARRAY<DOUBLE>`` columns. All run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NORM_EPS = 1e-12
ZERO_ATOL = 1e-10

def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def as_float(v: Column | str) -> Column:
    return _col(v).cast("array<float>")


def truncate(v: Column | str, k: int | None) -> Column:
    """First ``k`` components; ``None`` keeps all."""
    return _col(v) if k is None else F.slice(_col(v), 1, k)


def difference(a: Column | str, b: Column | str) -> Column:
    """Component-wise a − b in double precision."""
    return F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)


def total(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x)


def squared_norm(v: Column | str) -> Column:
    return F.aggregate(_col(v), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(v: Column | str) -> Column:
    return F.sqrt(squared_norm(v))


def l2_normalise(v: Column | str) -> Column:
    """v / (‖v‖ + 1e-12)."""
    v = _col(v)
    # An inner one-element array binds the norm once instead of once per component.
    scaled = F.transform(
        F.array(l2_norm(v) + F.lit(NORM_EPS)), lambda norm: F.transform(v, lambda x: x / norm)
    )
    return scaled.getItem(0)


def dot(a: Column | str, b: Column | str) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def weighted_sum(v: Column | str, weights: Sequence[float]) -> Column:
    """Σ w_j · v_j for weights known when the plan is built; the weights fold into one literal array."""
    return dot(as_double(v), F.array(*[F.lit(float(w)) for w in weights]))


def is_zero(v: Column | str) -> Column:
    return F.forall(_col(v), lambda x: x == F.lit(0.0))


def is_constant(v: Column | str) -> Column:
    """True when all components are equal, so the centred sum of squares is exactly zero."""
    v = _col(v)
    return F.array_max(v) == F.array_min(v)


def non_zero_positions(v: Column | str) -> Column:
    """0-based positions of the non-zero components."""
    v = _col(v)
    marked = F.transform(v, lambda x, i: F.when(x != F.lit(0.0), i))
    return F.filter(marked, lambda i: i.isNotNull())


def non_zero_values(v: Column | str) -> Column:
    return F.filter(_col(v), lambda x: x != F.lit(0.0))


def non_zero_sum(v: Column | str) -> Column:
    return total(non_zero_values(v))


def mean(v: Column | str) -> Column:
    v = _col(v)
    return total(v) / F.size(v)


def centred_sum_squares(v: Column | str) -> Column:
    """Σ (v_j − mean(v))². Exactly 0 for a constant vector, whatever the rounding of the mean."""
    v = _col(v)
    about_mean = F.transform(
        F.array(mean(v)), lambda m: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m))
    ).getItem(0)
    return F.when(is_constant(v), F.lit(0.0)).otherwise(about_mean)


def residual_sum_squares(y: Column | str, fitted: Column | str) -> Column:
    return squared_norm(difference(y, fitted))


def fit_quality(y: Column | str, fitted: Column | str) -> Column:
    """STRUCT<mse, r2_score, residual> of a stored reconstruction.

    R² centres y over its own components although the fit has no intercept. Where the centred sum of
    squares is zero, R² is 1 for an all-zero y and 0 for any other constant.
    """
    y = _col(y)
    ss_res = residual_sum_squares(y, fitted)
    ss_tot = centred_sum_squares(y)
    near_zero = F.forall(y, lambda x: F.abs(x) <= F.lit(ZERO_ATOL))
    r2 = (
        F.when(ss_tot != 0, F.lit(1.0) - ss_res / ss_tot)
        .when(near_zero, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return F.struct(
        (ss_res / F.size(y)).alias("mse"), r2.alias("r2_score"), F.sqrt(ss_res).alias("residual")
    )
