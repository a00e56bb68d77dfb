"""Scalar column expressions for scores and losses (all JVM-side, codegen'd)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x: float | Column) -> Column:
    """A threshold as float32: numpy compares float32 scores against a Python
    float in float32, so 0.29f >= 0.29 holds there; keep that semantics."""
    c = x if isinstance(x, Column) else F.lit(float(x))
    return c.cast("float")


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def bce_with_logits(x: Column, y: Column) -> Column:
    """Numerically stable binary cross-entropy on a logit, per cell."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def focal(x: Column, y: Column, gamma: float = 2.0, alpha: Column | float | None = None) -> Column:
    """(1 - pt)^gamma * bce with pt = exp(-bce); optional alpha factor."""
    b = bce_with_logits(x, y)
    f = F.pow(F.lit(1.0) - F.exp(-b), F.lit(float(gamma))) * b
    if alpha is None:
        return f
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return a * f


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, 0 when den is 0 (precision/recall convention)."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def half_precision(x: Column) -> Column:
    """The half-precision number nearest to ``x`` (11 significant bits, ties to
    even; steps of 2^-24 below 2^-14; infinite from 65520)."""
    x = x.cast("double")
    split = x * F.lit(float(2 ** 42 + 1))
    normal = split - (split - x)
    small = F.rint(x * F.lit(float(2 ** 24))) / F.lit(float(2 ** 24))
    return (F.when(F.abs(x) >= 65520.0, F.signum(x) * F.lit(float("inf")))
            .when(F.abs(x) < 2.0 ** -14, small).otherwise(normal))
