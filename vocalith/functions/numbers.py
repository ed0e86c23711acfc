"""Scalar expressions shared by the operators, and Student's t quantile."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b where b > 0, else the default (null for None)."""
    return F.when(b > 0, a / F.nullif(b, b * 0)).otherwise(F.lit(default).cast("double"))


def soft_ratio(a: Column, b: Column) -> Column:
    return a / (b + F.lit(1e-10))


def kernel(difference: Column, slope: float) -> Column:
    """1 - min(1, slope * |difference|)."""
    return F.lit(1.0) - F.least(F.lit(1.0), F.lit(float(slope)) * F.abs(difference))


def semitones(p: Column, reference: Column) -> Column:
    """12 log2(p / reference); null unless both are above zero."""
    return F.when((p > 0) & (reference > 0), F.lit(12.0) * F.log2(p / F.nullif(reference, reference * 0)))


def gaussian(x: Column, mean: float, sd: float) -> Column:
    z = (x - F.lit(float(mean))) / F.lit(float(sd))
    return F.exp(F.lit(-0.5) * z * z)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by the modified Lentz scheme."""
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1e-300, abs(1.0 - (a + b) * x / (a + 1.0))) * math.copysign(1, 1.0 - (a + b) * x / (a + 1.0))
    h = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_cdf(t: float, df: float) -> float:
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0
    tail = front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b
    return 1.0 - tail / 2.0 if t >= 0 else tail / 2.0


def t_quantile(df: float, p: float = 0.975) -> float:
    """Quantile of Student's t for any df > 0, by bisection; NaN where df is not positive."""
    if not df > 0:
        return math.nan
    if p < 0.5:
        return -t_quantile(df, 1 - p)
    low, high = 0.0, 2.0
    while t_cdf(high, df) < p:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def t_quantile_udf(level: float = 0.95):
    """For fractional degrees of freedom: vectorised, one evaluation for each different df of a batch; null for df <= 0."""
    if not 0 < level < 1:
        raise ValueError("the confidence level must lie between 0 and 1")

    @F.pandas_udf(DoubleType())
    def quantile(df: pd.Series) -> pd.Series:
        known = {d: t_quantile(d, 0.5 + level / 2) for d in df.dropna().unique() if d > 0}
        return df.map(known).astype(float)

    return quantile


def t_values(rows: int, level: float = 0.95) -> str:
    """Quantiles of whole degrees of freedom up to ``rows`` as SQL VALUES, for the other side of an oracle check."""
    return ", ".join(f"({d}, {t_quantile(d, 0.5 + level / 2)!r}::DOUBLE)" for d in range(1, rows + 1))


def even_indices(n: int, k: int) -> list[int]:
    return np.linspace(0, n - 1, k, dtype=int).tolist()
