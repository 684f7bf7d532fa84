"""Sample-adjusted moments (Spark's own are population moments)."""

from __future__ import annotations

from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, functions as F


def adjusted_skew(x: Column) -> Column:
    """Bias-adjusted skewness; 0 for constants and for fewer than 3 values."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    value = F.try_divide(g1 * F.sqrt(n * (n - 1)), n - 2)
    usable = (n > 2) & (F.min(x) < F.max(x))
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(
        F.when(usable, value).otherwise(F.lit(0.0)))


def adjusted_kurtosis(x: Column) -> Column:
    """Bias-adjusted excess kurtosis; null for constants and under 4 values."""
    n = F.count(x).cast("double")
    g2 = F.kurtosis(x)
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when((n > 3) & (F.min(x) < F.max(x)), value)


@dataclass(frozen=True)
class Moments:
    """Count, mean, central sums and range of one column in one slice.

    A handful of these per column come back from a grouped aggregate, and are
    merged to the moments of "all slices but one".
    """

    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    m3: float = 0.0
    low: float | None = None

    @staticmethod
    def columns(name: str, x: Column) -> list[Column]:
        return [F.count(x).alias(f"{name}#n"), F.avg(x).alias(f"{name}#mean"),
                F.var_pop(x).alias(f"{name}#var"),
                F.skewness(x).alias(f"{name}#skew"),
                F.min(x).alias(f"{name}#low")]

    @classmethod
    def from_row(cls, row, name: str) -> Moments:
        n = row[f"{name}#n"]
        if not n:
            return cls()
        var = row[f"{name}#var"] or 0.0
        skew = row[f"{name}#skew"]
        m3 = n * skew * var ** 1.5 if skew is not None and var > 0 else 0.0
        return cls(n, row[f"{name}#mean"], n * var, m3, row[f"{name}#low"])

    def merge(self, other: Moments) -> Moments:
        if not other.n:
            return self
        if not self.n:
            return other
        n = self.n + other.n
        d = other.mean - self.mean
        mean = self.mean + d * other.n / n
        m2 = self.m2 + other.m2 + d * d * self.n * other.n / n
        m3 = (self.m3 + other.m3
              + d ** 3 * self.n * other.n * (self.n - other.n) / n ** 2
              + 3 * d * (self.n * other.m2 - other.n * self.m2) / n)
        return Moments(n, mean, m2, m3, min(self.low, other.low))

    @property
    def variance(self) -> float | None:
        return self.m2 / (self.n - 1) if self.n > 1 else None

    @property
    def skew(self) -> float:
        if self.n < 3 or self.m2 <= 0:
            return 0.0
        g1 = (self.m3 / self.n) / (self.m2 / self.n) ** 1.5
        return g1 * sqrt(self.n * (self.n - 1)) / (self.n - 2)
