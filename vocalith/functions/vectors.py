"""Vector expressions over ARRAY columns. All arithmetic is in double precision; sizes must agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 if either vector has no length. Pass precomputed norms where vectors meet many times."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(na * nb, F.lit(0.0)))


def cosine_or_null(a: Column, b: Column) -> Column:
    """Unguarded cosine: null where it is not defined."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def euclid_similarity(a: Column, b: Column, scale: float = 1.0) -> Column:
    """1 / (1 + d / scale); scale 10 for sound-event vectors."""
    return F.lit(1.0) / (F.lit(1.0) + euclidean(a, b) / F.lit(float(scale)))


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two vectors, 0 where one has no spread."""
    ma, mb = total(a) / F.size(a), total(b) / F.size(b)
    return cosine(F.transform(a, lambda x: x - ma), F.transform(b, lambda x: x - mb))


def l2_normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / F.nullif(n, F.lit(0.0)))).otherwise(v)


def logistic(c: Column, steepness: float, middle: float = 0.5) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-float(steepness)) * (c - F.lit(float(middle)))))


#: Steepness of the calibration curve around 0.5, by embedding family.
CALIBRATION = {"ecapa": 12.0, "res": 10.0, "xvec": 10.0}
#: Decision thresholds.
SAME_SPEAKER_PROBABILITY = 0.5
SAME_SPEAKER_COSINE = 0.75
RELIABLE_CONFIDENCE = 0.85


def calibrated(c: Column, family: str = "ecapa") -> Column:
    return logistic(c, CALIBRATION[family])


def confidence(p: Column) -> Column:
    return F.lit(2.0) * F.abs(p - F.lit(0.5))
