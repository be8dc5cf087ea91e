"""Scalar scoring functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wardline import fixed_values as V
from wardline.functions.lookup import look_up


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def risk_level(score: Column) -> Column:
    """Level of a governed interaction; both bounds are inclusive."""
    return (
        F.when(score <= V.RISK_LOW_MAX, "LOW").when(score <= V.RISK_MEDIUM_MAX, "MEDIUM").otherwise("HIGH")
    )


def intercept_risk_level(score: Column) -> Column:
    """Level scale of the text-only intercept flow."""
    return (
        F.when(score > V.INTERCEPT_HIGH_ABOVE, "HIGH")
        .when(score > V.INTERCEPT_MEDIUM_ABOVE, "MEDIUM").otherwise("LOW")
    )


def pii_type_risk(kind: Column) -> Column:
    return look_up(V.PII_TYPE_RISK, kind, V.PII_DEFAULT_RISK)


def dot(left: Column, right: Column) -> Column:
    """Dot product of two float arrays of equal length, summed in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def cosine(left: Column, right: Column) -> Column:
    return F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def period_hours(name: str) -> int:
    return V.PERIOD_HOURS.get(name, V.DEFAULT_PERIOD_HOURS)
