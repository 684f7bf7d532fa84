"""Scalar feature columns."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, functions as F

from foldmark.constants import CLIP_PAD, NULL_TOKEN


def is_missing(x: Column) -> Column:
    return x.isNull().cast("int")


def impute(x: Column, value: Column | float | None) -> Column:
    fill = value if isinstance(value, Column) else F.lit(value).cast("double")
    return F.coalesce(x.cast("double"), fill)


def log1p_floor(x: Column) -> Column:
    """log(1 + x) with negatives raised to 0; null stays null."""
    return F.when(x.isNotNull(), F.log1p(F.greatest(x.cast("double"), F.lit(0.0))))


def null_token(x: Column, token: str = NULL_TOKEN) -> Column:
    return F.coalesce(x.cast("string"), F.lit(token))


def compact_text(x: Column) -> Column:
    """A text up to 64 characters, or its length and sha-256 beyond.

    Equal for equal texts only, so grouping by it moves no long texts.
    """
    digest = F.concat(F.length(x).cast("string"), F.lit("#"), F.sha2(x.cast("binary"), 256))
    return F.when(F.length(x) > 64, digest).otherwise(x)


def zero_flag(x: Column) -> Column:
    return F.coalesce((x == 0).cast("int"), F.lit(0))


def product(a: Column, b: Column) -> Column:
    return a.cast("double") * b.cast("double")


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def _present(cols: list[Column]) -> Column:
    return F.filter(F.array(*[c.cast("double") for c in cols]),
                    lambda v: v.isNotNull())


def row_mean(cols: list[Column]) -> Column:
    values = _present(cols)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    return F.try_divide(total, F.size(values))


def row_std(cols: list[Column]) -> Column:
    """Sample standard deviation across columns, nulls skipped."""
    values = _present(cols)
    mean = row_mean(cols)
    squares = F.aggregate(values, F.lit(0.0),
                          lambda acc, v: acc + (v - mean) * (v - mean))
    n = F.size(values)
    return F.when(n > 1, F.sqrt(F.try_divide(squares, n - 1)))


def inf_to_null(x: Column) -> Column:
    return F.when((F.abs(x) == float("inf")) | F.isnan(x),
                  F.lit(None)).otherwise(x)


def cyclic(x: Column) -> tuple[Column, Column]:
    angle = x.cast("double") * (2 * pi)
    return F.sin(angle), F.cos(angle)


def clip_to_range(pred: Column, low: float | Column, high: float | Column,
                  pad: float = CLIP_PAD) -> Column:
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    margin = (hi - lo) * pad
    return F.when(pred.isNotNull(), F.least(F.greatest(pred, lo - margin), hi + margin))


def smoothed(total: Column, n: Column, prior: Column, weight: float) -> Column:
    """(total + weight * prior) / (n + weight): mean pulled to the prior."""
    return (total + prior * weight) / (n + F.lit(weight))
