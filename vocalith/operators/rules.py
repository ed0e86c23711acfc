"""Ordered rule cascades: constraints, tamper detection, verdicts. All but the constraints are row expressions over aggregates.

Codes, not prose, come out. Comparisons are strict or inclusive as written; the first arm that holds counts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import clip01, ratio, semitones
from . import aggregates as A
from .ranges import FORMANT_INTERVALS, FORMANT_RANGES

FORMANTS = ("F1", "F2", "F3", "F4")


def by_gender(gender: Column, values: dict[str, float]) -> Column:
    """A literal by gender; an unknown one counts as male."""
    return F.when(gender == "female", F.lit(float(values["female"]))).when(gender == "child", F.lit(float(values["child"]))).otherwise(F.lit(float(values["male"])))


#: The distance to a neighbour that is put in order and its factor; how far beyond a range, below and
#: above, halves a reliability; limits of F2/F1 and the factors of what lies beyond; the least reliability of what was changed.
_ORDER_STEP, _ORDER_FACTOR, _BELOW, _ABOVE = 100.0, 0.7, 100.0, 200.0
_RATIO_LIMITS, _RATIO_FACTORS, _LEAST = (1.3, 4.5), (0.6, 0.7), 0.1
_GENDERS = ("male", "female", "child")


def _constrained(on: np.ndarray, gender: np.ndarray, f: list[np.ndarray], r: list[np.ndarray]) -> np.ndarray:
    """Changes frequencies and reliabilities in place (NaN: unknown, which no comparison holds for); where it did."""
    changed = np.zeros(len(on), dtype=bool)
    for a, b in zip(range(3), range(1, 4), strict=True):
        bad = on & (f[a] > 0) & (f[b] > 0) & (f[b] <= f[a])
        lower, upper = bad & (r[a] < r[b]), bad & (r[a] >= r[b])  # the less reliable one moves
        f[a][lower], f[b][upper] = f[b][lower] - _ORDER_STEP, f[a][upper] + _ORDER_STEP
        r[a][lower] *= _ORDER_FACTOR
        r[b][upper] *= _ORDER_FACTOR
        changed |= bad
    for k, name in enumerate(FORMANTS):
        lo, hi = (np.array([float(FORMANT_RANGES[g][name][i]) for g in _GENDERS])[gender] for i in (0, 1))
        some = on & (f[k] > 0)
        for out, end, span in ((some & (f[k] < lo), lo, _BELOW), (some & (f[k] > hi), hi, _ABOVE)):
            r[k][out] *= 1 - 0.5 * np.minimum(1.0, np.abs(end[out] - f[k][out]) / span)
            f[k][out] = end[out]
            changed |= out
    both = on & (f[0] > 0) & (f[1] > 0)
    x = np.divide(f[1], f[0], out=np.full(len(on), np.nan), where=both)
    factor = np.where(x < _RATIO_LIMITS[0], _RATIO_FACTORS[0], np.where(x > _RATIO_LIMITS[1], _RATIO_FACTORS[1], 1.0))
    r[0] *= factor
    r[1] *= factor
    for x in r:
        x[changed] = np.fmax(_LEAST, x[changed])
    return changed


def enforce_constraints(frames: DataFrame) -> DataFrame:
    """Physiological constraints on voiced frames with energy: order, ranges, F2/F1, floor, then intervals.

    Each step reads what the one before it left. As column expressions the steps make one generated method that is too
    long to be compiled, so they run over the arrays of an Arrow batch. Columns: gender, is_voiced, energy, formant_count, F1..F4
    and F1_reliability..F4_reliability; ``modified`` and ``odd_intervals`` are added.
    """
    values = [*FORMANTS, *[f"{f}_reliability" for f in FORMANTS]]

    @F.pandas_udf(", ".join(f"`{c}` double" for c in values) + ", modified boolean")
    def run(on: pd.Series, gender: pd.Series, x: pd.DataFrame) -> pd.DataFrame:
        v = [x[c].to_numpy(dtype=float, copy=True) for c in values]
        changed = _constrained(on.to_numpy(dtype=bool), gender.to_numpy(), v[:4], v[4:])
        return pd.DataFrame(dict(zip(values, v, strict=True)) | {"modified": changed})

    on = F.coalesce(F.col("is_voiced"), F.lit(True)) & (F.coalesce(F.col("energy"), F.lit(1.0)) > 0)
    code = F.when(F.col("gender") == "female", 1).when(F.col("gender") == "child", 2).otherwise(0)
    out = frames.withColumn("_c", run(on, code, F.struct(*[F.col(c).cast("double").alias(c) for c in values])))
    return check_intervals(out.withColumns({c: F.col(f"_c.{c}") for c in [*values, "modified"]}).drop("_c"))


def check_intervals(frames: DataFrame) -> DataFrame:
    """All reliabilities times 0.8 where three formants or more stand at unusual distances."""

    def outside(name: str, distance: Column) -> Column:
        lo, hi = (by_gender(F.col("gender"), {g: v[name][i] for g, v in FORMANT_INTERVALS.items()}) for i in (0, 1))
        return (distance < lo) | (distance > hi)

    odd = outside("F2-F1", F.col("F2") - F.col("F1")) | outside("F3-F2", F.col("F3") - F.col("F2")) | ((F.col("F4") > 0) & outside("F4-F3", F.col("F4") - F.col("F3")))
    odd = F.coalesce((F.col("formant_count") >= 3) & (F.col("F1") > 0) & (F.col("F2") > 0) & (F.col("F3") > 0) & odd, F.lit(False))
    return frames.withColumn("_odd", odd).withColumns({f"{f}_reliability": F.when(F.col("_odd"), F.col(f"{f}_reliability") * 0.8).otherwise(F.col(f"{f}_reliability")) for f in FORMANTS}).withColumnRenamed("_odd", "odd_intervals")


def vowel_consistency(matched: DataFrame) -> DataFrame:
    """Order flag over the formants present, score halved where it fails, consistent iff ordered and match over 0.5."""
    ordered = F.lit(True)
    for a, b in zip(FORMANTS, FORMANTS[1:], strict=False):
        ordered = ordered & F.when((F.col(a) > 0) & (F.col(b) > 0), F.col(a) < F.col(b)).otherwise(True)
    out = matched.withColumn("ordered", ordered)
    return out.withColumns({"consistency_score": F.col("match_score") * F.when(F.col("ordered"), 1.0).otherwise(0.5), "is_consistent": F.col("ordered") & (F.col("match_score") > 0.5)})


def live_modification(p95: Column, jump_std: Column, f1_std: Column, f2_std: Column, voiced_share: Column) -> Column:
    """Pitch shift, robot voice, formant modification, else null. Deviations of no formants count as 0; a deviation
    of no jumps is unknown and triggers nothing."""
    much = voiced_share > 0.5
    return F.when(p95 > 5, "pitch_shift").when((jump_std < 0.1) & much, "robot_voice").when(((F.coalesce(f1_std, F.lit(0.0)) < 10) | (F.coalesce(f2_std, F.lit(0.0)) < 20)) & much, "formant_modification")


def pitch_shift(mean: Column, entropy: Column, n: Column, least: int = 10) -> tuple[Column, Column]:
    """(shifted, semitones): a mean outside 80..300 Hz against 150 Hz; low normalised entropy is a shift by 0."""
    outside = (mean < 80) | (mean > 300)
    enough = n >= least
    return F.coalesce(enough & (outside | (entropy < 0.4)), F.lit(False)), F.when(enough & outside, semitones(mean, F.lit(150.0))).otherwise(0.0)


def formant_shift(f1: Column, f2: Column, n: Column, least: int = 10) -> tuple[Column, Column]:
    """(shifted, ratio): both ratios to 500 and 1500 Hz alike (within 0.2) and the first outside 0.7..1.3; the first is
    the ratio, 0 where nothing is shifted."""
    r1, r2 = f1 / 500.0, f2 / 1500.0
    alike = F.abs(r1 - r2) < 0.2
    hit = F.coalesce((n >= least) & alike & ((r1 < 0.7) | (r1 > 1.3)), F.lit(False))
    return hit, F.when(hit, r1).otherwise(0.0)


def robot_voice(flatness: Column, cv: Column, regular: Column, n: Column, least: int = 10) -> Column:
    """A flat spectrum; with ``least`` voiced frames or more also a steady pitch or regular harmonics."""
    return F.coalesce(flatness > 0.4, F.lit(False)) | ((n >= least) & (F.coalesce(cv < 0.05, F.lit(False)) | F.coalesce(regular, F.lit(False))))


def combined_modification(pitch: Column, steps: Column, formant: Column, r: Column, robot: Column) -> tuple[Column, Column, Column]:
    """(is_modified, type, confidence): pitch of over 3 semitones, formants, robot, in that order."""
    by_pitch = pitch & (F.abs(steps) > 3)
    kind = F.when(by_pitch, "pitch_shift").when(formant, "formant_shift").when(robot, "robot_voice")
    sure = F.when(by_pitch, F.least(F.abs(steps) / 6.0, F.lit(1.0))).when(formant, F.least(F.abs(r - 1.0) / 0.5, F.lit(1.0))).when(robot, 0.8).otherwise(0.0)
    return kind.isNotNull(), kind, sure


def file_modification(cv: Column, mean: Column, f2_f1: Column, flatness: Column, regular: Column) -> tuple[Column, Column]:
    """(type, confidence) of a whole recording."""
    base = F.when(mean < 160, 120.0).otherwise(220.0)
    shift = F.abs(semitones(mean, base))
    kind = F.when(cv < 0.05, "robot_voice").when((mean < 80) | (mean > 300), "pitch_shift").when((f2_f1 < 1.5) | (f2_f1 > 5), "formant_shift").when(flatness > 0.4, "vocoder").when(regular, "robot_voice")
    sure = F.when(cv < 0.05, 0.8).when((mean < 80) | (mean > 300), F.least(F.lit(0.7) + shift / 10.0, F.lit(0.95))).when((f2_f1 < 1.5) | (f2_f1 > 5), 0.75).when(flatness > 0.4, 0.7).when(regular, 0.8).otherwise(0.0)
    return kind, sure


def formant_manipulation(frames: DataFrame, by: list[str], least: int = 10) -> DataFrame:
    """Abnormally stable formants or abnormal ratios over voiced frames with F1..F3."""
    rows = frames.where(F.col("is_voiced") & (F.col("F1") > 0) & (F.col("F2") > 0) & (F.col("F3") > 0))
    cv = lambda c: ratio(F.stddev_pop(c), F.avg(c), None)
    s = rows.groupBy(*by).agg(F.count("*").alias("n"), cv("F1").alias("f1_cv"), cv("F2").alias("f2_cv"), cv("F3").alias("f3_cv"), F.avg(ratio(F.col("F2"), F.col("F1"), None)).alias("mean_f2_f1"), F.avg(ratio(F.col("F3"), F.col("F2"), None)).alias("mean_f3_f2"))
    one = lambda c: c.cast("double")
    odd1, odd2 = (F.col("mean_f2_f1") < 1.2) | (F.col("mean_f2_f1") > 5.0), (F.col("mean_f3_f2") < 1.1) | (F.col("mean_f3_f2") > 3.0)
    s = s.withColumns({"stability_score": (one(F.col("f1_cv") < 0.10) + one(F.col("f2_cv") < 0.08) + one(F.col("f3_cv") < 0.04)) / 3.0, "abnormality_score": (one(odd1) + one(odd2)) / 2.0})
    still, enough = F.col("stability_score") > 0.7, F.col("n") >= least
    kind = F.when(~enough, "insufficient_data").when(still, "synthetic_voice").when(odd1 & ~odd2, "formant_shift_f1f2").when(odd2 & ~odd1, "formant_shift_f2f3").when(odd1 & odd2, "complete_formant_shift").otherwise("unknown")
    return s.withColumns({"is_manipulated": enough & (still | (F.col("abnormality_score") > 0.5)), "type": kind, "confidence": F.when(enough, F.greatest("stability_score", "abnormality_score")).otherwise(0.0)})


def spoof_summary(probs: DataFrame, by: list[str], p: str = "p", order: list[str] | None = None) -> DataFrame:
    """Mean, deviation, maximum, confidence and type of windowed spoof probabilities; type is null up to 0.4. With
    ``order`` the mean is summed in it."""
    if order:
        probs = probs.withColumn("_run", A.running_sum(p, by, order))
    mean = A.mean_in_order("_run", p, order) if order else F.avg(p)
    out = probs.groupBy(*by).agg(mean.alias("mean"), F.stddev_pop(p).alias("std"), F.max(p).alias("max"), F.count(p).alias("windows"))
    return out.withColumns({"confidence": F.lit(1.0) - F.col("std"), "type": F.when(F.col("mean") > 0.8, "tts").when(F.col("mean") > 0.6, "voice_conversion").when(F.col("mean") > 0.4, "editing")})


def recording_environment(rate: Column, bit_rate: Column, channels: Column) -> Column:
    """Studio, phone, call, VoIP; unknown numbers count 0. The order matters: 8 kHz mono is a phone, not a call."""
    r, b, c = (F.coalesce(x, F.lit(0)) for x in (rate, bit_rate, channels))
    return F.when((r >= 44100) & (b >= 320000), "professional").when((r >= 8000) & (r <= 16000) & (c == 1), "phone").when(r <= 8000, "call").when((r >= 16000) & (r <= 24000), "voip").otherwise("unknown")


def verdict(score: Column, consistency: Column) -> Column:
    """A high score with poor consistency falls through to the next arms."""
    return F.when((score >= 0.95) & (consistency < 0.10), "very_high").when((score >= 0.88) & (consistency < 0.12), "high").when((score >= 0.80) & (consistency < 0.15), "probable").when(score >= 0.70, "similar").otherwise("different")


def gated_verdict(score: Column, consistency: Column, spoof_a: Column, spoof_b: Column) -> Column:
    """Synthetic speech on either side makes the verdict unreliable, with a note of its own at 0.85 and more."""
    synthetic = F.greatest(F.coalesce(spoof_a, F.lit(0.0)), F.coalesce(spoof_b, F.lit(0.0))) > 0.7
    return F.when(synthetic & (score >= 0.85), "unreliable_similar").when(synthetic, "unreliable").otherwise(verdict(score, consistency))


def warnings(modified: Column, consistency: Column) -> Column:
    return F.array_compact(F.array(F.when(modified, "modified"), F.when(consistency > 0.15, "inconsistent")))


def lights(ci_width: Column, median: Column, consistency: Column) -> dict[str, Column]:
    return {
        "ci_light": F.when(ci_width < 0.1, "green").when(ci_width < 0.2, "yellow").otherwise("red"),
        "median_light": F.when(median > 0.85, "green").when(median > 0.7, "yellow").otherwise("red"),
        "consistency_light": F.when(consistency < 0.05, "green").when(consistency < 0.15, "yellow").otherwise("red"),
    }


def tract_length_closeness(a: Column, b: Column) -> Column:
    """Needs both lengths above zero."""
    d = F.abs(a - b)
    return F.when((a > 0) & (b > 0), F.when(d < 0.5, "very_close").when(d < 1.0, "close").otherwise("differs")).otherwise("unknown")


def quality_score(snr_db: Column, voiced: Column, energy: Column, is_speech: Column) -> Column:
    """0.5 by signal-to-noise from 5 to 30 dB, 0.3 if voiced, 0.2 by energy; 0 for what is no speech."""
    return F.when(is_speech, F.lit(0.5) * clip01((snr_db - 5.0) / 25.0) + F.lit(0.3) * voiced.cast("double") + F.lit(0.2) * F.least(F.lit(1.0), energy)).otherwise(0.0)


#: Gender by mean pitch; the male range is tested first.
PITCH_RANGES = (("male", 50.0, 180.0), ("female", 150.0, 300.0))


def gender_shares_by_pitch(mean: Column) -> dict[str, Column]:
    """Male and female by mean pitch: certain inside a range, 0.9 beyond the ends, 0.5 each where there is none."""
    low, high = mean < PITCH_RANGES[0][1], mean > PITCH_RANGES[1][2]
    male = F.when(mean.isNull() | (mean <= 0), 0.5).when(low, 0.9).when(high, 0.1).when(mean <= PITCH_RANGES[0][2], 1.0).otherwise(0.0)
    return {"male": male, "female": F.lit(1.0) - male}


def gender_by_pitch(mean: Column) -> Column:
    return F.when(mean.between(50.0, 180.0), "male").when(mean.between(150.0, 300.0), "female").otherwise("unknown")
