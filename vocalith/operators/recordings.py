"""Whole recordings: cleaning, windows and their energy, formant tracks, all features, comparison of two recordings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import vectors as V
from . import aggregates as A
from . import features as X
from . import ranges as G
from . import rules as R
from . import series as S
from . import signal as K


def cleaned(samples: DataFrame, how: str = "preprocess", amp: str = "amp", sr: int = K.SAMPLE_RATE) -> DataFrame:
    """``amp`` normalised, gated and filtered (``preprocess``), or enhanced for speech (``enhance``)."""
    kernel = {"preprocess": K.preprocess, "enhance": K.enhance_speech}[how]

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda a: kernel(np.asarray(a, dtype=float), sr))

    return samples.withColumn(amp, run(amp))


def spectrum_quality(mags: np.ndarray, freqs: np.ndarray) -> float:
    """0..1 by the number and the prominence of the peaks from 200 to 5000 Hz of the normalised spectrum."""
    top = float(np.max(mags)) if len(mags) else 0.0
    speech = (mags / top if top > 0 else mags)[(freqs >= 200) & (freqs <= 5000)]
    if not len(speech):
        return 0.0
    peaks = K.find_peaks(speech, height=0.1, distance=5, prominence=0.05)
    high = K.prominences(speech)[peaks]
    if not len(peaks):
        return 0.1
    prominent = float(np.mean(high))
    share = prominent / (float(speech.mean()) + 1e-10)
    return min(1.0, 0.2 + 0.4 * share + 0.2 * min(1.0, len(peaks) / 8) + 0.2 * prominent / 0.3)


def window_energy(frames: DataFrame, by: list[str], window_s: float, hop_s: float, literal: bool = False) -> DataFrame:
    """Rows (by, ts, energy) in order -> (by, start_s, energy) of windows of ``window_s`` every ``hop_s``.

    ``literal`` keeps an old habit: window k has the mean of frames k and k + 1 alone, whatever their times.
    """
    w = Window.partitionBy(*by)
    rows = frames.select(*by, "ts", "energy").withColumns({"_end": F.max("ts").over(w), "_k": F.row_number().over(w.orderBy("ts")) - 1})
    if literal:
        n = F.floor((F.col("_end") - window_s) / hop_s) + 1
        pair = rows.withColumn("energy", F.avg("energy").over(w.orderBy("_k").rowsBetween(0, 1)))
        return pair.where(F.col("_k") < n).select(*by, (F.col("_k") * F.lit(float(hop_s))).alias("start_s"), "energy")
    last = F.floor(F.col("ts") / hop_s).cast("int")
    first = F.greatest(F.lit(0), (F.floor((F.col("ts") - window_s) / hop_s) + 1).cast("int"))
    spread = rows.select(*by, "energy", "_end", F.explode(F.sequence(first, F.greatest(first, last))).alias("k"))
    inside = spread.where(F.col("k") * F.lit(float(hop_s)) + window_s <= F.col("_end"))
    return inside.groupBy(*by, (F.col("k") * F.lit(float(hop_s))).alias("start_s")).agg(F.avg("energy").alias("energy"))


def remove_silence(samples: DataFrame, by: list[str], sr: int, window: int = 400, hop: int = 160, share: float = 0.01, least_s: float = 0.1, gap_s: float = 0.3, amp: str = "amp") -> DataFrame:
    """``samples`` (by, amp) without their silence: (by, kept, removed_percent).

    Frames louder than ``share`` of the loudest are speech; their runs of ``least_s`` and more are joined over gaps up to
    ``gap_s``. A recording without such a run stays whole; so does one shorter than a window.
    """
    frames = S.framed(samples.select(*by, F.col(amp).alias("amp")), window, hop).select(*by, (F.col("start") / F.lit(float(sr))).alias("ts"), S.rms(F.col("frame")).alias("energy"))
    loud = frames.withColumn("speech", F.col("energy") > F.lit(float(share)) * F.max("energy").over(Window.partitionBy(*by)))
    runs = S.merge_runs(S.speech_runs(loud, by, "ts", "speech", least_s), by, gap_s)
    return X.silence_removed(samples.select(*by, F.col(amp).alias("amp")), runs, by, sr, "amp", keep_whole=True)


def voice_segment(recordings: DataFrame, segments: DataFrame, by: list[str], longest_s: float = 58.0, least_s: float = 5.0) -> DataFrame:
    """One segment a recording: short ones and those within ``longest_s`` whole (status short, whole), else the
    segment of the best quality, the earliest of equals (status cut); none where no segment is known (status none)."""
    from .selection import best_segment

    best = best_segment(segments.select(*by, "quality", "start_s", "end_s"), by, "quality", "start_s")
    j = recordings.join(best, by, "left")
    d = F.col("duration_s")
    status = F.when(d <= least_s, "short").when(d <= longest_s, "whole").when(F.col("start_s").isNull(), "none").otherwise("cut")
    whole = d <= longest_s
    return j.select(*by, status.alias("status"), F.when(whole, 0.0).otherwise(F.col("start_s")).alias("start_s"), F.when(whole, d).otherwise(F.col("end_s")).alias("end_s"), "quality")


def track_formants(frames: DataFrame, keys: list[str], spark_ranges: DataFrame, gender: str = "gender", order: int = 16, quality: str | None = None) -> DataFrame:
    """Frame rows (keys, frame, gender) -> one row a frame with F1..F4, their bandwidths and reliabilities.

    An unknown gender counts as male. ``quality``: a column with the model's quality, which scales the reliabilities.
    Formants out of order (F2 at or under F1, and so on) halve all reliabilities of the frame.
    """
    known = F.when(F.col(gender).isin(*G.FORMANT_RANGES), F.col(gender)).otherwise("male")
    of_frame = frames.select(*keys, known.alias("gender"), (F.lit(1.0) if quality is None else F.col(quality)).alias("_q"))
    roots = K.lpc_formants(frames, keys, order).join(of_frame, keys).withColumn("reliability", F.col("reliability") * F.col("_q"))
    best = G.range_candidates(roots, keys, "freq_hz", spark_ranges, "reliability")
    at = lambda f, c: F.max(F.when(F.col("key") == f, F.col(c)))
    out = best.groupBy(*keys).agg(*[e for f in R.FORMANTS for e in (at(f, "freq_hz").alias(f), at(f, "bandwidth_hz").alias(f"{f}_bandwidth"), F.coalesce(at(f, "reliability"), F.lit(0.0)).alias(f"{f}_reliability"))], F.count("*").cast("int").alias("formant_count"))
    disorder = [F.coalesce(F.col(b) <= F.col(a), F.lit(False)) for a, b in zip(R.FORMANTS, R.FORMANTS[1:], strict=False)]
    half = F.when(disorder[0] | disorder[1] | disorder[2], 0.5).otherwise(1.0)
    return out.withColumns({f"{f}_reliability": F.col(f"{f}_reliability") * half for f in R.FORMANTS})


def aligned_times(tracks: DataFrame, by: list[str], order: str, duration: str = "duration_s") -> DataFrame:
    """Evenly spaced times over the duration for values that come without their own."""
    w = Window.partitionBy(*by)
    n = F.count("*").over(w)
    return tracks.withColumn("ts", F.when(n > 1, F.col(duration) * (F.row_number().over(w.orderBy(order)) - 1) / F.greatest(n - 1, F.lit(1))).otherwise(0.0))


def all_features(frames: DataFrame, spectrum: DataFrame, by: list[str], t: str = "t", step_s: float = 0.01, mel: DataFrame | None = None) -> DataFrame:
    """Pitch, perturbation, fricative, nasal, quality and temporal groups of each recording, side by side, and the
    perceptual one where ``mel`` (by, bin, db) is given.

    ``frames``: by, t, ts, energy, pitch_hz, pitch_mag, voiced, voiced_prob; ``spectrum``: by, t, bin, freq_hz, mag.
    The spectrum is read once for the bands and once for its shape.
    """
    energies = X.band_energies(spectrum, [*by, t])
    shape = X.spectral_shape(spectrum, [*by, t])
    pitch = X.pitch_features(frames, by, [t], step_s)
    perturbation = X.jitter_shimmer(frames, by, [t])
    loud = F.col("energy") > 0.05 * F.max("energy").over(Window.partitionBy(*by))
    groups = {
        "pitch": pitch,
        "perturbation": perturbation,
        "fricative": X.fricative_features(energies, by),
        "nasal": X.nasal_features(energies, by),
        "quality": X.voice_quality(shape, pitch, perturbation, energies, by),
        "temporal": S.temporal_features(frames.select(*by, "ts", loud.alias("speech")), by, "ts", "speech"),
    }
    if mel is not None:
        groups["perceptual"] = X.perceptual_features(mel, shape, by)
    out = frames.select(*by).distinct()
    for name, g in groups.items():
        out = out.join(g.select(*by, F.struct(*[c for c in g.columns if c not in by]).alias(name)), by, "left")
    return out


#: The 22 numbers of a voice, in their order.
BIOMETRIC = (
    "pitch.mean", "pitch.median", "pitch.std", "pitch.mean_derivative", "pitch.mean_acceleration",
    "perturbation.jitter_local", "perturbation.jitter_absolute", "perturbation.jitter_ppq5",
    "perturbation.shimmer_local", "perturbation.shimmer_db", "perturbation.shimmer_apq5",
    "fricative.s_z_ratio", "fricative.sh_zh_ratio", "fricative.centroid_mean",
    "nasal.mean_r1", "nasal.mean_r2", "nasal.resonance_ratio",
    "quality.breathiness", "quality.creakiness", "quality.tenseness", "quality.nasality", "quality.stability",
)


def biometric_vector(features: DataFrame, by: list[str]) -> DataFrame:
    return features.select(*by, X.feature_vector(list(BIOMETRIC)).alias("v"))


def compare(sims: DataFrame, weights: DataFrame, pairs: DataFrame, on: str = "pair_id", spoof_a: Column | None = None, spoof_b: Column | None = None, modified: Column | None = None) -> DataFrame:
    """The whole decision for each pair: fused score, consistency, verdict and warning codes.

    ``sims``: pair_id, metric, score over segments and files. A pair of ``pairs`` without any score comes out with the
    verdict ``no_segments``.
    """
    zero = F.lit(0.0)
    summary = A.with_weights(A.metric_summary(sims, [on, "metric"]), weights)
    # what the order of a sum leaves is rounded away, so a score that meets a threshold counts as reaching it
    fused = A.fuse(summary, [on]).withColumns({c: F.round(c, 9) for c in ("final_score", "consistency")})
    out = pairs.join(fused, on, "left")
    code = R.gated_verdict(F.col("final_score"), F.col("consistency"), zero if spoof_a is None else spoof_a, zero if spoof_b is None else spoof_b)
    out = out.withColumn("verdict_code", F.when(F.col("metrics").isNull(), "no_segments").otherwise(code))
    return out.withColumn("warning_codes", R.warnings(F.lit(False) if modified is None else modified, F.col("consistency")))


def segment_similarities(segments_a: DataFrame, segments_b: DataFrame, on: str = "pair_id", models: tuple[str, ...] = ("ecapa", "xvec", "res", "yamnet")) -> DataFrame:
    """Zip join of ranked segments (pair_id, rn, one vector column a model) -> long rows (pair_id, metric, score)."""
    a = segments_a.select(on, "rn", *[F.col(m).alias(f"{m}_a") for m in models])
    b = segments_b.select(on, "rn", *[F.col(m).alias(f"{m}_b") for m in models])
    scores = F.array(*[F.struct(F.lit(m).alias("metric"), V.cosine(V.as_double(F.col(f"{m}_a")), V.as_double(F.col(f"{m}_b"))).alias("score")) for m in models])
    return a.join(b, [on, "rn"]).select(on, F.col("rn").alias("seg_no"), F.explode(scores).alias("s")).select(on, "seg_no", "s.*").where("score is not null")
