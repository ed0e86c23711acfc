"""Composite features of a recording, put together from frame, spectrum and formant tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clip01, gaussian, ratio, soft_ratio
from . import aggregates as A
from . import ranges as R
from . import series as S


def pitch_features(frames: DataFrame, by: list[str], order: list[str], step_s: float) -> DataFrame:
    """Statistics, contour (mean absolute derivative and acceleration, deviations of both), resets, gender and its
    probabilities, of reliable pitch. A key without reliable pitch has zeros, gender unknown, and probabilities of 0.5."""
    kept = S.reliable_pitch(frames).where("pitch_hz > 0")
    d1 = kept.withColumn("_d", S.gradient("pitch_hz", by, order))
    d2 = d1.withColumn("_a", S.gradient("_d", by, order))
    parts = [F.avg(F.abs("_d")).alias("mean_derivative"), F.stddev_pop("_d").alias("derivative_std"), F.avg(F.abs("_a")).alias("mean_acceleration"), F.stddev_pop("_a").alias("acceleration_std")]
    stats = A.plain_stats(kept, by, "pitch_hz", order).join(d2.groupBy(*by).agg(*parts), by).join(S.pitch_resets(kept, by, order, "pitch_hz", step_s), by)
    from .rules import gender_by_pitch, gender_shares_by_pitch

    out = frames.select(*by).distinct().join(stats, by, "left")
    out = out.withColumn("gender", gender_by_pitch(F.coalesce("mean", F.lit(0.0)))).withColumns(gender_shares_by_pitch(F.col("mean")))
    return out.fillna(0, [c for c in stats.columns if c not in by])


def jitter_shimmer(frames: DataFrame, by: list[str], order: list[str], least: int = 5) -> DataFrame:
    """The eight perturbation values of voiced frames; zeros where fewer than ``least`` are voiced."""
    kept = S.voiced(frames).withColumns({"_p": F.lit(1.0) / F.nullif(F.col("pitch_hz"), F.lit(0.0)), "_a": F.col("pitch_mag").cast("double")})
    # one order and one exchange for all windows, then one aggregation
    w = Window.partitionBy(*by).orderBy(*order)
    five = w.rowsBetween(-2, 2)
    rows = kept.withColumns({"_dp": F.abs(F.col("_p") - F.lag("_p").over(w)), "_da": F.abs(F.col("_a") - F.lag("_a").over(w))})
    rows = rows.withColumns({"_db": F.abs(F.lit(20.0) * (F.log10("_a") - F.log10(F.lag("_a").over(w)))), "_mp": F.avg("_p").over(five), "_ma": F.avg("_a").over(five), "_k": F.count("*").over(five)})
    inner = lambda x, m: F.when(F.col("_k") == 5, F.abs(F.col(x) - F.col(m)))
    part = lambda top, of: F.coalesce(ratio(F.lit(100.0) * top, F.avg(of)), F.lit(0.0))
    values = {
        "jitter_local": part(F.avg("_dp"), "_p"),
        "jitter_absolute": F.coalesce(F.lit(1000.0) * F.avg("_dp"), F.lit(0.0)),
        "jitter_ppq5": part(F.avg(inner("_p", "_mp")), "_p"),
        "jitter_variability": part(F.stddev_pop("_dp"), "_p"),
        "shimmer_local": part(F.avg("_da"), "_a"),
        "shimmer_db": F.coalesce(F.avg("_db"), F.lit(0.0)),
        "shimmer_apq5": part(F.avg(inner("_a", "_ma")), "_a"),
        "shimmer_variability": part(F.stddev_pop("_da"), "_a"),
    }
    enough = F.count("*") >= least
    got = rows.groupBy(*by).agg(*[F.when(enough, v).otherwise(0.0).alias(k) for k, v in values.items()])
    return frames.select(*by).distinct().join(got, by, "left").fillna(0.0, list(values))


def band_energies(spectrum: DataFrame, frame: list[str], bands=R.ENERGY_BANDS) -> DataFrame:
    """Mean magnitude of each band in each frame, the frame's mean and its centroid (0 without energy), one row a frame:
    conditional means, no join."""
    f = F.col("freq_hz")
    centroid = F.coalesce(F.sum(f * F.col("mag")) / F.nullif(F.sum("mag"), F.lit(0.0)), F.lit(0.0)).alias("centroid")
    return spectrum.groupBy(*frame).agg(F.avg("mag").alias("all"), centroid, *[F.coalesce(F.avg(F.when(f.between(lo, hi), F.col("mag"))), F.lit(0.0)).alias(k) for k, lo, hi in bands])


FRICATIVE_BANDS = ("f_v", "s_z", "sh_zh")


def fricative_features(energies: DataFrame, by: list[str]) -> DataFrame:
    """Of each band, over the frames in which it is above a fifth of its own largest energy: mean energy, mean and
    deviation of its part of the frame, number of frames. Over the frames that any band takes (``overall_ratio`` of
    all): mean and deviation of the centroid. What has no frame is 0.

    ``energies``: rows of ``band_energies``.
    """
    keys = Window.partitionBy(*by)
    tops = {f"_{k}": F.max(k).over(keys) for k in FRICATIVE_BANDS}
    rows = energies.withColumns(tops).withColumns({f"_{k}": F.col(k) > F.lit(0.2) * F.col(f"_{k}") for k in FRICATIVE_BANDS})
    rows = rows.withColumn("_any", F.col("_f_v") | F.col("_s_z") | F.col("_sh_zh"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    aggs = []
    for k in FRICATIVE_BANDS:
        own = lambda c, k=k: F.when(F.col(f"_{k}"), c)
        part = own(ratio(F.col(k), F.col("all")))
        aggs += [zero(F.avg(own(F.col(k)))).alias(f"{k}_energy"), zero(F.avg(part)).alias(f"{k}_ratio"), zero(F.stddev_pop(part)).alias(f"{k}_ratio_std"), F.count(own(F.lit(1))).alias(f"{k}_frames")]
    middle = F.when(F.col("_any"), F.col("centroid"))
    aggs += [zero(F.avg(middle)).alias("centroid_mean"), zero(F.stddev_pop(middle)).alias("centroid_std")]
    return rows.groupBy(*by).agg(*aggs, F.avg(F.col("_any").cast("double")).alias("overall_ratio"))


def fricative_vector(energies: DataFrame, shape: DataFrame, by: list[str], t: str) -> DataFrame:
    """Eight numbers over all frames: mean and deviation of centroid and flatness, mean energies of s_z and sh_zh, mean
    and deviation of the latter over the former (0 where that is 0)."""
    rows = energies.join(shape.select(*by, t, "flatness"), [*by, t])
    part = ratio(F.col("sh_zh"), F.col("s_z"))
    both = lambda c: [F.avg(c), F.stddev_pop(c)]
    return rows.groupBy(*by).agg(F.array(*both(F.col("centroid")), *both(F.coalesce("flatness", F.lit(0.0))), F.avg("s_z"), F.avg("sh_zh"), *both(part)).alias("v"))


def nasal_vector(energies: DataFrame, by: list[str]) -> DataFrame:
    """Eight numbers over all frames: mean and deviation of both nasal energies and of their parts of the frame."""
    both = lambda c: [F.avg(c), F.stddev_pop(c)]
    parts = [ratio(F.col(k), F.col("all")) for k in ("nasal1", "nasal2")]
    return energies.groupBy(*by).agg(F.array(*both("nasal1"), *both("nasal2"), *both(parts[0]), *both(parts[1])).alias("v"))


def nasal_features(energies: DataFrame, by: list[str]) -> DataFrame:
    """Ratios over nasal frames (first ratio over 1.5 of its mean, antiresonance under 0.7 of its mean), their part of
    all frames, the first ratio over the antiresonance (``quality``) and over the second (``resonance_ratio``). Without
    nasal frames: ratios over all frames, the rest 0."""
    keys = Window.partitionBy(*by)
    rows = energies.withColumns({"r1": ratio(F.col("nasal1"), F.col("all")), "r2": ratio(F.col("nasal2"), F.col("all")), "anti": ratio(F.col("antires"), F.col("all"))})
    rows = rows.withColumn("nasal", (F.col("r1") > 1.5 * F.avg("r1").over(keys)) & (F.col("anti") < 0.7 * F.avg("anti").over(keys)))
    only = lambda c: F.avg(F.when(F.col("nasal"), c))
    mean = lambda c: F.coalesce(only(F.col(c)), F.avg(c))
    against = lambda c: F.coalesce(only(soft_ratio(F.col("r1"), F.col(c))), F.lit(0.0))
    return rows.groupBy(*by).agg(
        F.avg(F.col("nasal").cast("double")).alias("presence"),
        *[mean(c).alias(f"mean_{c}") for c in ("r1", "r2", "anti")],
        against("anti").alias("quality"),
        against("r2").alias("resonance_ratio"),
        F.stddev_pop("r1").alias("std_r1"),
        F.count("*").alias("frames"),
    )


def spectral_shape(spectrum: DataFrame, frame: list[str]) -> DataFrame:
    """Centroid, flatness (of the power), 85 % roll-off and the slope of magnitude on frequency of each frame."""
    w = Window.partitionBy(*frame).orderBy("bin")
    power = F.greatest(F.col("mag") * F.col("mag"), F.lit(1e-10))
    rows = spectrum.withColumns({"_run": F.sum("mag").over(w), "_all": F.sum("mag").over(Window.partitionBy(*frame))})
    return rows.groupBy(*frame).agg(
        (F.sum(F.col("freq_hz") * F.col("mag")) / F.nullif(F.sum("mag"), F.lit(0.0))).alias("centroid"),
        (F.exp(F.avg(F.ln(power))) / F.avg(power)).alias("flatness"),
        F.min(F.when(F.col("_run") >= 0.85 * F.col("_all"), F.col("freq_hz"))).alias("rolloff"),
        F.regr_slope("mag", "freq_hz").alias("slope"),
    )


def perceptual_features(mel: DataFrame, shape: DataFrame, by: list[str], contrast: DataFrame | None = None) -> DataFrame:
    """Balance of the mean mel spectrum in dB (bins 0-42, 43-85, 86-127), brightness (the high bins' part of its sum),
    warmth (low over the rest), mean and deviation of roll-off and centroid. With ``contrast`` (by, band, contrast):
    contrast_mean, the mean of each band in order, and richness, the mean of these; null without one."""
    bins = mel.groupBy(*by, "bin").agg(F.avg("db").alias("_m"))
    part = lambda lo, hi: F.avg(F.when(F.col("bin").between(lo, hi), F.col("_m")))
    high = F.sum(F.when(F.col("bin") >= 86, F.col("_m")))
    m = bins.groupBy(*by).agg(part(0, 42).alias("low_energy"), part(43, 85).alias("mid_energy"), part(86, 127).alias("high_energy"), (high / F.nullif(F.sum("_m"), F.lit(0.0))).alias("brightness"))
    low, mid, top = F.col("low_energy"), F.col("mid_energy"), F.col("high_energy")
    m = m.withColumns({"low_to_high": soft_ratio(low, top), "mid_to_high": soft_ratio(mid, top), "warmth": soft_ratio(low, mid + top)})
    s = shape.groupBy(*by).agg(*[f(c).alias(f"{c}_{n}") for c in ("rolloff", "centroid") for n, f in (("mean", F.avg), ("std", F.stddev_pop))])
    out = m.join(s, by)
    if contrast is None:
        return out.withColumns({"contrast_mean": F.lit(None).cast("array<double>"), "richness": F.lit(None).cast("double")})
    bands = contrast.groupBy(*by, "band").agg(F.avg("contrast").alias("_c"))
    means = F.transform(F.array_sort(F.collect_list(F.struct("band", "_c"))), lambda x: x["_c"])
    return out.join(bands.groupBy(*by).agg(means.alias("contrast_mean"), F.avg("_c").alias("richness")), by, "left")


#: Upper ends of normal local jitter and shimmer, in per cent.
JITTER_NORMAL, SHIMMER_NORMAL = 1.04, 3.81


def voice_quality(shape: DataFrame, pitch: DataFrame, perturbation: DataFrame, energies: DataFrame, by: list[str]) -> DataFrame:
    """Breathiness, creakiness, tenseness, nasality, voicing degree and stability, each in 0..1.

    ``shape``: slope of each frame; ``pitch``: mean, std, n, gender; ``perturbation``: jitter_local, shimmer_local;
    ``energies``: nasal1 and all of each frame. Without pitch, creakiness and stability are 0 and tenseness comes from
    the slope alone.
    """
    s = shape.groupBy(*by).agg(F.avg("slope").alias("_s"))
    e = energies.groupBy(*by).agg(F.avg("nasal1").alias("_nasal"), F.avg("all").alias("_all"), F.count("*").alias("_k"))
    p = pitch.select(*by, F.col("mean").alias("_m"), F.col("std").alias("_d"), F.col("n").alias("_n"), F.col("gender").alias("_g"))
    j = perturbation.select(*by, F.least(F.lit(1.0), F.col("jitter_local") / JITTER_NORMAL).alias("_j"), F.least(F.lit(1.0), F.col("shimmer_local") / SHIMMER_NORMAL).alias("_h"))
    out = s.join(e, by).join(p, by, "left").join(j, by, "left")
    m, d = F.col("_m"), F.col("_d")
    low = F.when(m < 100, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (m - 100.0) / 50.0))
    high = F.when(F.col("_g") == "male", clip01((m - 100.0) / 80.0)).otherwise(clip01((m - 180.0) / 120.0))
    steep = F.least(F.lit(1.0), F.abs(F.coalesce("_s", F.lit(0.0))) * 10.0)
    calm = F.lit(1.0) - F.least(F.lit(1.0), d / F.nullif(m * 0.2, F.lit(0.0)))
    some = F.coalesce(m > 0, F.lit(False))
    j1, h1 = F.coalesce("_j", F.lit(0.0)), F.coalesce("_h", F.lit(0.0))
    return out.select(
        *by,
        (j1 * 0.5 + h1 * 0.5).alias("breathiness"),
        F.when(some, low * 0.6 + F.least(F.lit(1.0), d / 20.0) * 0.4).otherwise(0.0).alias("creakiness"),
        (F.when(some, high).otherwise(0.0) * 0.5 + steep * 0.5).alias("tenseness"),
        F.least(F.lit(1.0), ratio(F.col("_nasal"), F.col("_all")) * 3.0).alias("nasality"),
        clip01(ratio(F.coalesce("_n", F.lit(0)).cast("double"), F.col("_k").cast("double"))).alias("voicing_degree"),
        F.when(some, (F.lit(1.0) - j1) * 0.3 + (F.lit(1.0) - h1) * 0.3 + calm * 0.4).otherwise(0.0).alias("stability"),
    )


def feature_vector(columns: list[str]) -> Column:
    """Unscaled vector of features; what is missing counts 0."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns])


def formant_dynamics(tracks: DataFrame, by: list[str], key: str = "formant", x: str = "hz") -> DataFrame:
    """Vector of mean, deviation and range of F1 to F4, zeros for one with at most two values."""
    v = F.col(x)
    some = lambda f: F.when((F.col(key) == f) & (v > 0), v)
    parts = []
    for f in ("F1", "F2", "F3", "F4"):
        enough = F.count(some(f)) > 2
        parts += [F.when(enough, e).otherwise(0.0) for e in (F.avg(some(f)), F.stddev_pop(some(f)), F.max(some(f)) - F.min(some(f)))]
    return tracks.groupBy(*by).agg(F.array(*parts).alias("v"))


def tract_length(f3: Column, f4: Column) -> Column:
    """Mean of 34400 / 2F over F3 and F4 in cm; 0 unless both are there."""
    return F.when((f3 > 0) & (f4 > 0), (F.lit(17200.0) / F.nullif(f3, F.lit(0.0)) + F.lit(17200.0) / F.nullif(f4, F.lit(0.0))) / 2).otherwise(0.0)


def tracked_tract_length(means: DataFrame, by: list[str], key: str = "formant") -> DataFrame:
    """From either formant: mean, deviation and confidence max(0, 1 - std / mean), 0.5 with one alone."""
    rows = means.where(F.col(key).isin("F3", "F4") & (F.col("mean") > 0)).withColumn("_l", F.lit(17200.0) / F.col("mean"))
    out = rows.groupBy(*by).agg(F.avg("_l").alias("length_cm"), F.stddev_pop("_l").alias("std_cm"), F.count("*").alias("formants"))
    return out.withColumn("confidence", F.when(F.col("formants") > 1, F.greatest(F.lit(0.0), F.lit(1.0) - F.col("std_cm") / F.col("length_cm"))).otherwise(0.5))


def gender_estimate(pitches: DataFrame, by: list[str], x: str = "pitch_hz", least: int = 10) -> DataFrame:
    """Probabilities of male, female and child: 0.6 by median and 0.4 by mode, child 0.5, 0.3 and 0.2 for high
    pitch; 0.6, 0.3, 0.1 where there are fewer than ``least`` values. They sum to 1."""
    kept = pitches.where(F.col(x) > 0)
    s = kept.groupBy(*by).agg(F.median(x).alias("_m"), F.count("*").alias("n")).join(A.histogram_mode(kept, by, x, 50.0, 500.0, 20).select(*by, F.col("mode").alias("_o")), by, "left")
    mode = F.coalesce("_o", "_m")
    #: Centre and spread of each group's pitch in Hz.
    shape = {"male": (120.0, 25.0), "female": (210.0, 30.0), "child": (300.0, 50.0)}
    p = {k: F.lit(0.6) * gaussian(F.col("_m"), *v) + F.lit(0.4) * gaussian(mode, *v) for k, v in shape.items()}
    p["child"] = F.lit(0.5) * gaussian(F.col("_m"), *shape["child"]) + F.lit(0.3) * gaussian(mode, *shape["child"]) + F.lit(0.2) * F.when(F.col("_m") > 250, 1.0).otherwise(0.0)
    fallback = {"male": 0.6, "female": 0.3, "child": 0.1}
    out = s.select(*by, "n", *[F.when(F.col("n") >= least, v).otherwise(fallback[k]).alias(k) for k, v in p.items()])
    return A.normalized_shares(out, list(shape))


def frame_snr(energy: Column, whole: Column, denoised: Column) -> Column:
    """10 log10(Ed^2 / (E^2 - Ed^2 + 1e-10)); null where the logarithm has none."""
    return F.when(energy > 0, F.log10(denoised * denoised / F.nullif(whole * whole - denoised * denoised + 1e-10, F.lit(0.0))) * 10.0)


def segment_means(frames: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Mean energy and signal-to-noise over the frames inside each segment (range join within a recording)."""
    s = segments.select(*by, "seg_no", "start_s", "end_s")
    inside = frames.join(s, by).where((F.col("ts") >= F.col("start_s")) & (F.col("ts") < F.col("end_s")))
    return inside.groupBy(*by, "seg_no").agg(F.avg("energy").alias("energy"), F.avg("snr_db").alias("snr_db"), F.count("*").alias("frames"))


def silence_removed(samples: DataFrame, runs: DataFrame, by: list[str], sr: int, amp: str = "amp", keep_whole: bool = False) -> DataFrame:
    """Concatenation of the speech runs of each recording, in order, and the part that went, in per cent.

    The runs of a recording are gathered first, so its samples are joined once, however many runs it has. A
    recording without any run keeps nothing, or with ``keep_whole`` everything.
    """
    at = lambda c: F.floor(F.col(c) * sr).cast("int")
    gathered = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(at("start_s").alias("a"), at("end_s").alias("b")))).alias("_runs"))
    cut = samples.select(*by, F.col(amp).alias("_amp")).join(gathered, by, "left")
    pieces = F.transform("_runs", lambda r: F.slice("_amp", r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))))
    kept = F.coalesce(F.flatten(pieces), F.col("_amp") if keep_whole else F.slice("_amp", 1, 0))
    out = cut.select(*by, kept.alias("kept"), F.size("_amp").alias("_n"))
    return out.select(*by, "kept", F.when(F.col("_n") > 0, F.lit(100.0) * (F.lit(1.0) - F.size("kept") / F.nullif(F.col("_n"), F.lit(0)))).otherwise(0.0).alias("removed_percent"))
