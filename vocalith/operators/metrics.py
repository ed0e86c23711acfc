"""Pairwise comparison metrics: expressions over two feature rows (columns with suffixes _a and _b)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import kernel

#: Spans that make the eight perturbation differences comparable.
PERTURBATION_SPANS = (2.0, 5.0, 2.0, 3.0, 5.0, 3.0, 5.0, 5.0)
#: Weights of the voice-feature groups.
GROUP_WEIGHTS = {"biometric": 1.5, "pitch": 1.0, "jitter_shimmer": 1.2, "fricative": 0.8, "nasal": 1.0, "quality": 0.7}
#: Weights of formants and ratios in the statistical profile.
PROFILE_WEIGHTS = {"F1": 1.0, "F2": 1.0, "F3": 1.2, "F4": 0.8, "F2/F1": 1.5, "F3/F2": 1.3, "F3/F1": 1.2}
#: Upper ends of normal local jitter and shimmer, in per cent.
JITTER_NORMAL, SHIMMER_NORMAL = 1.04, 3.81


def tract_similarity(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.least(F.abs(a - b) / 5.0, F.lit(1.0))


def perturbation_similarity(a: Column, b: Column) -> Column:
    """1 - mean of the clipped, scaled differences of two vectors of eight."""
    spans = F.array(*[F.lit(x) for x in PERTURBATION_SPANS])
    scaled = F.zip_with(F.zip_with(a, b, lambda x, y: F.abs(x - y)), spans, lambda d, s: F.least(d / s, F.lit(1.0)))
    return F.lit(1.0) - F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x) / len(PERTURBATION_SPANS)


def relative_difference(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.when(top > 0, F.abs(a - b) / F.nullif(top, F.lit(0.0))).otherwise(0.0)


def contour_similarity(d_deriv: Column, d_acc: Column, d_reset: Column) -> Column:
    floor = lambda c: F.greatest(F.lit(0.0), c)
    return (floor(F.lit(1.0) - F.abs(d_deriv) / 5.0) + floor(F.lit(1.0) - F.abs(d_acc) / 10.0) + floor(F.lit(1.0) - F.lit(2.0) * F.abs(d_reset))) / 3.0


def pitch_similarity(mean_a: Column, mean_b: Column, cv_a: Column, cv_b: Column, contour: Column | None = None) -> Column:
    """Half by relative mean, 0.3 by variation, 0.2 by contour (0 where there is none)."""
    c = F.lit(0.0) if contour is None else F.coalesce(contour, F.lit(0.0))
    return F.lit(0.5) * kernel(relative_difference(mean_a, mean_b), 2.0) + F.lit(0.3) * kernel(cv_a - cv_b, 5.0) + F.lit(0.2) * c


def jitter_shimmer_similarity(d_jitter: Column, d_shimmer: Column, d_ppq: Column, d_apq: Column) -> Column:
    return F.lit(0.3) * kernel(d_jitter, 1 / JITTER_NORMAL) + F.lit(0.3) * kernel(d_shimmer, 1 / SHIMMER_NORMAL) + F.lit(0.2) * kernel(d_ppq, 0.5) + F.lit(0.2) * kernel(d_apq, 0.25)


def fricative_similarity(d_sh: Column, d_s: Column, d_centroid: Column) -> Column:
    """Differences of sh_zh_ratio, s_z_ratio and centroid_mean of ``features.fricative_features``."""
    return F.lit(0.35) * kernel(d_sh, 5.0) + F.lit(0.35) * kernel(d_s, 5.0) + F.lit(0.3) * kernel(d_centroid, 1 / 1000.0)


def nasal_similarity(d_first: Column, d_ratio: Column, d_quality: Column) -> Column:
    """Differences of mean_r1, resonance_ratio and quality of ``features.nasal_features``."""
    return F.lit(0.3) * kernel(d_first, 5.0) + F.lit(0.5) * kernel(d_ratio, 2.0) + F.lit(0.2) * kernel(d_quality, 2.0)


def quality_similarity(differences: list[Column]) -> Column:
    return sum((kernel(d, 2.0) for d in differences[1:]), kernel(differences[0], 2.0)) / len(differences)


def voice_feature_similarity(groups: dict[str, Column]) -> Column:
    """Weighted mean over the groups that are not null."""
    some = {k: F.when(v.isNotNull(), F.lit(GROUP_WEIGHTS[k])).otherwise(0.0) for k, v in groups.items()}
    top = sum((F.lit(GROUP_WEIGHTS[k]) * F.coalesce(v, F.lit(0.0)) for k, v in groups.items()), F.lit(0.0))
    bottom = sum(some.values(), F.lit(0.0))
    return F.when(bottom > 0, top / F.nullif(bottom, F.lit(0.0))).otherwise(0.0)


def tracked_profile(a: DataFrame, b: DataFrame, on: list[str], key: str = "formant") -> DataFrame:
    """Mean over formants with both means above zero of 1 - min(1, relative difference); 0 where there is none."""
    left = a.where("mean > 0").select(*on, key, F.col("mean").alias("ma"))
    right = b.where("mean > 0").select(*on, key, F.col("mean").alias("mb"))
    s = F.lit(1.0) - F.least(F.lit(1.0), relative_difference(F.col("ma"), F.col("mb")))
    return left.join(right, [*on, key]).groupBy(*on).agg(F.coalesce(F.avg(s), F.lit(0.0)).alias("similarity"), F.count("*").alias("formants"))


def statistical_profile(a: DataFrame, b: DataFrame, on: list[str], key: str = "key", least: int = 5) -> DataFrame:
    """Weighted likeness of two profiles of (mean, std, ci_lo, ci_hi, count): 0.6 by mean, 0.3 by overlap of the
    intervals, 0.1 by spread; a key with fewer than ``least`` values on a side counts 0."""
    cols = ("mean", "std", "ci_lo", "ci_hi", "count")
    j = a.select(*on, key, *[F.col(c).alias(f"{c}_a") for c in cols]).join(b.select(*on, key, *[F.col(c).alias(f"{c}_b") for c in cols]), [*on, key])
    is_ratio = F.col(key).contains("/")
    d = F.abs(F.col("mean_a") - F.col("mean_b"))
    average = (F.col("mean_a") + F.col("mean_b")) / 2
    by_mean = F.when(is_ratio, F.lit(1.0) - F.least(F.lit(1.0), d)).when(average > 0, F.lit(1.0) - F.least(F.lit(1.0), F.lit(2.0) * d / F.nullif(average, F.lit(0.0)))).otherwise(0.0)
    overlap = F.greatest(F.lit(0.0), F.least("ci_hi_a", "ci_hi_b") - F.greatest("ci_lo_a", "ci_lo_b"))
    union = F.greatest("ci_hi_a", "ci_hi_b") - F.least("ci_lo_a", "ci_lo_b")
    by_ci = F.when(union > 0, overlap / F.nullif(union, F.lit(0.0))).otherwise(0.0)
    top = F.greatest("std_a", "std_b")
    by_std = F.when(top > 0, F.least("std_a", "std_b") / F.nullif(top, F.lit(0.0))).otherwise(1.0)
    one = F.when((F.col("count_a") < least) | (F.col("count_b") < least), 0.0).otherwise(F.lit(0.6) * by_mean + F.lit(0.3) * by_ci + F.lit(0.1) * by_std)
    w = F.element_at(F.create_map(*[F.lit(x) for k, v in PROFILE_WEIGHTS.items() for x in (k, v)]), F.col(key))
    rows = j.withColumns({"similarity": one, "weight": F.coalesce(w, F.lit(1.0))})
    return rows.groupBy(*on).agg((F.sum(F.col("similarity") * F.col("weight")) / F.sum("weight")).alias("similarity"), F.count("*").alias("keys"))


def compare_metadata(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Equality flags in which null equals null, same device, and warning codes."""
    cols = ("sample_rate", "channels", "codec", "creation_tool", "duration_s")
    j = a.select(*on, *[F.col(c).alias(f"{c}_a") for c in cols]).join(b.select(*on, *[F.col(c).alias(f"{c}_b") for c in cols]), on)
    same = {f"same_{c}": F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in cols[:4]}
    out = j.withColumns(same)
    warn = F.array_compact(F.array(F.when(~F.col("same_sample_rate"), "sample_rate_differs"), F.when(F.abs(F.col("duration_s_a") - F.col("duration_s_b")) > 300, "duration_differs")))
    return out.withColumns({"same_device": F.col("same_codec") & F.col("same_creation_tool"), "warnings": warn})
