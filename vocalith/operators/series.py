"""Ordered series of frames: rows (by..., t, ...). Each operator keeps one partitioning (by) and one order (t)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import ratio, semitones


def _over(by: list[str], order: list[str]):
    return Window.partitionBy(*by).orderBy(*order)


def argmax_bin(spectrum: DataFrame, frame: list[str], value: str = "mag", bin_: str = "bin", score: Column | None = None) -> DataFrame:
    """The strongest bin of each frame, the lowest of equals. With ``score``, the bin with the highest score, beside the
    frame's largest value."""
    if score is not None:
        best = F.max_by(bin_, F.struct(score, -F.col(bin_)))
        return spectrum.groupBy(*frame).agg(best.alias(bin_), F.max(value).alias(value))
    return spectrum.groupBy(*frame).agg(F.max_by(F.struct(*[c for c in spectrum.columns if c not in frame]), F.struct(F.col(value), -F.col(bin_))).alias("_b")).select(*frame, "_b.*")


def voiced(frames: DataFrame, pitch: str = "pitch_hz", mag: str = "pitch_mag") -> DataFrame:
    return frames.where((F.col(pitch) > 0) & (F.col(mag) > 0))


def above_share_of_max(frames: DataFrame, by: list[str], x: str, share: float) -> DataFrame:
    """Rows strictly above ``share`` of the largest value of their key: strong voiced frames, speech frames."""
    return frames.withColumn("_max", F.max(x).over(Window.partitionBy(*by))).where(F.col(x) > F.lit(float(share)) * F.col("_max")).drop("_max")


def reliable_pitch(frames: DataFrame) -> DataFrame:
    return frames.where(F.col("voiced") & (F.col("voiced_prob") > 0.7))


def is_voiced(frames: DataFrame, by: list[str], flag: str = "is_speech", share: float = 0.15) -> DataFrame:
    return frames.groupBy(*by).agg((F.avg(F.col(flag).cast("double")) > share).alias("is_voiced"))


def frame_starts(length: Column, window: int, hop: int, include_last: bool = True) -> Column:
    """Start positions of windows; ``include_last`` keeps the window that ends exactly at the end."""
    last = length - window - (0 if include_last else 1)
    return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(hop).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def framed(samples: DataFrame, window: int, hop: int, include_last: bool = True, amp: str = "amp") -> DataFrame:
    """Array column of samples -> one row for each window: t, start, frame."""
    starts = frame_starts(F.size(amp).cast("long"), window, hop, include_last)
    out = samples.select("*", F.posexplode(starts).alias("t", "start"))
    return out.withColumn("frame", F.slice(amp, (F.col("start") + 1).cast("int"), window)).drop(amp)


def rms(frame: Column) -> Column:
    return F.sqrt(F.aggregate(frame, F.lit(0.0), lambda a, x: a + x * x) / F.size(frame))


def gradient(x: str, by: list[str], order: list[str]) -> Column:
    """Central differences inside, one-sided at the ends."""
    w = _over(by, order)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.when(before.isNull(), after - F.col(x)).when(after.isNull(), F.col(x) - before).otherwise((after - before) / 2)


def jitter(frames: DataFrame, by: list[str], order: list[str], f: str = "f") -> DataFrame:
    """Period jitter of the voiced frames (``f`` above zero), gaps closed up: local and variability in per cent,
    absolute in ms. A key without a voiced frame has no row."""
    rows = frames.where(F.col(f) > 0).withColumn("_t", F.lit(1.0) / F.nullif(F.col(f), F.lit(0.0)))
    rows = rows.withColumn("_d", F.abs(F.col("_t") - F.lag("_t").over(_over(by, order))))
    return rows.groupBy(*by).agg(
        ratio(F.lit(100.0) * F.avg("_d"), F.avg("_t"), None).alias("local"),
        (F.lit(1000.0) * F.avg("_d")).alias("absolute"),
        ratio(F.lit(100.0) * F.stddev_pop("_d"), F.avg("_t"), None).alias("variability"),
        F.count("*").alias("n"),
    )


def shimmer(frames: DataFrame, by: list[str], order: list[str], a: str = "a") -> DataFrame:
    """Amplitude shimmer of the voiced frames (``a`` above zero): local in per cent, and the mean step in dB."""
    w = _over(by, order)
    rows = frames.where(F.col(a) > 0).withColumn("_d", F.abs(F.col(a) - F.lag(a).over(w))).withColumn("_db", F.abs(F.lit(20.0) * (F.log10(F.col(a)) - F.log10(F.lag(a).over(w)))))
    return rows.groupBy(*by).agg(ratio(F.lit(100.0) * F.avg("_d"), F.avg(a), None).alias("local"), F.avg("_db").alias("db"), F.count("*").alias("n"))


def perturbation_quotient(frames: DataFrame, by: list[str], order: list[str], x: str, points: int = 5) -> DataFrame:
    """Mean distance from the centred mean of ``points`` values over inner points, in per cent of the mean."""
    half = points // 2
    w = _over(by, order).rowsBetween(-half, half)
    rows = frames.withColumn("_m", F.avg(x).over(w)).withColumn("_n", F.count(x).over(w))
    inner = F.when(F.col("_n") == points, F.abs(F.col(x) - F.col("_m")))
    return rows.groupBy(*by).agg(F.when(F.count(inner) > 0, ratio(F.lit(100.0) * F.avg(inner), F.avg(x))).otherwise(0.0).alias("pq"), F.count(inner).alias("n"))


def pitch_resets(frames: DataFrame, by: list[str], order: list[str], x: str, step_s: float, share: float = 0.1, least: int = 10) -> DataFrame:
    """Falls of over a tenth of the range: mean fall, its rate over two steps, and how frequent they are."""
    keys = Window.partitionBy(*by)
    drop = F.lag(x).over(_over(by, order)) - F.col(x)
    rows = frames.withColumn("_d", drop).withColumn("_r", F.max(x).over(keys) - F.min(x).over(keys))
    fell = F.when(F.col("_d") > F.lit(share) * F.col("_r"), F.col("_d"))
    few = F.count("*") < least
    return rows.groupBy(*by).agg(
        F.when(few, 0.0).otherwise(F.coalesce(F.avg(fell), F.lit(0.0))).alias("mean_drop"),
        F.when(few, 0.0).otherwise(F.coalesce(F.avg(fell) / F.lit(2 * step_s), F.lit(0.0))).alias("drop_rate"),
        F.when(few, 0.0).otherwise(F.count(fell) / F.count("*")).alias("frequency"),
    )


def semitone_jumps(frames: DataFrame, by: list[str], order: list[str], x: str) -> DataFrame:
    """95th percentile and deviation of the jumps between neighbouring voiced frames (``x`` above zero), in semitones."""
    rows = frames.where(F.col(x) > 0).withColumn("_j", F.abs(semitones(F.col(x), F.lag(x).over(_over(by, order)))))
    return rows.groupBy(*by).agg(F.expr("percentile(_j, 0.95)").alias("p95"), F.stddev_pop("_j").alias("std"), F.count("*").alias("n"))


def islands(frames: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Column ``island``: the number of changes of ``value`` so far; neighbours of equal value share it."""
    w = _over(by, order)
    changed = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    first = F.row_number().over(w) == 1
    return frames.withColumn("_c", F.when(first, 1).otherwise(changed)).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def speech_runs(frames: DataFrame, by: list[str], t: str, speech: str, least_s: float = 0.1) -> DataFrame:
    """Runs of speech frames at least ``least_s`` long; a run ends at the first frame after it, or the last frame."""
    marked = islands(frames.withColumn("_next", F.lead(t).over(_over(by, [t]))), by, [t], speech)
    runs = marked.where(F.col(speech)).groupBy(*by, "island").agg(F.min(t).alias("start_s"), F.coalesce(F.max_by("_next", t), F.max(t)).alias("end_s"))
    return runs.where(F.col("end_s") - F.col("start_s") >= least_s).drop("island")


def merge_runs(runs: DataFrame, by: list[str], gap_s: float = 0.3) -> DataFrame:
    """Runs whose gap is at most ``gap_s`` become one."""
    w = _over(by, ["start_s"])
    new = F.coalesce((F.col("start_s") - F.lag("end_s").over(w) > gap_s).cast("int"), F.lit(0))
    marked = runs.withColumn("_n", new).withColumn("_g", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_g").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count("*").alias("runs")).drop("_g")


def phrases(frames: DataFrame, by: list[str], t: str, speech: str) -> DataFrame:
    """Runs of speech and of pause by edges: both ends lie inside, so a run of one frame lasts 0 s."""
    return islands(frames, by, [t], speech).groupBy(*by, "island", speech).agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.count("*").alias("frames")).withColumn("duration_s", F.col("end_s") - F.col("start_s"))


def temporal_features(frames: DataFrame, by: list[str], t: str, speech: str) -> DataFrame:
    """Speech frames' part of all and the pauses', phrase counts and means, rate and tempo. Where nothing is speech: a
    pause ratio of 1, all else 0."""
    p = phrases(frames, by, t, speech)
    yes = lambda c: F.when(F.col(speech), c)
    no = lambda c: F.when(~F.col(speech), c)
    out = p.groupBy(*by).agg(
        F.count(yes(F.lit(1))).alias("phrase_count"),
        F.when(F.count(yes(F.lit(1))) > 0, F.count(no(F.lit(1)))).otherwise(0).alias("pause_count"),
        (F.coalesce(F.sum(yes(F.col("frames"))), F.lit(0)) / F.sum("frames")).alias("speech_ratio"),
        F.coalesce(F.avg(yes(F.col("duration_s"))), F.lit(0.0)).alias("mean_phrase"),
        F.coalesce(F.when(F.count(yes(F.lit(1))) > 0, F.avg(no(F.col("duration_s")))), F.lit(0.0)).alias("mean_pause"),
        (F.max("end_s") - F.min("start_s")).alias("total_s"),
    )
    return out.withColumns({"pause_ratio": F.when(F.col("phrase_count") > 0, F.lit(1.0) - F.col("speech_ratio")).otherwise(1.0), "speech_rate": ratio(F.col("phrase_count").cast("double"), F.col("total_s")), "tempo": ratio(F.col("speech_ratio"), F.col("mean_phrase"))})


def opened_closed(frames: DataFrame, by: list[str], order: list[str], mask: str, opening: int = 5, closing: int = 10) -> DataFrame:
    """Binary opening, then closing, of a 0/1 mask; an even kernel reaches one further back than ahead."""
    out = frames
    for name, size, first, second in (("_o", opening, F.min, F.max), ("_k", closing, F.max, F.min)):
        back, ahead = size // 2, (size - 1) // 2
        src = mask if name == "_o" else "_o"
        w1 = _over(by, order).rowsBetween(-back, ahead)
        w2 = _over(by, order).rowsBetween(-ahead, back)
        out = out.withColumn("_e", first(src).over(w1)).withColumn(name, second("_e").over(w2)).drop("_e")
    return out.withColumn(mask, F.col("_k")).drop("_o", "_k")


def half_power_bandwidth(spectrum: DataFrame, frame: list[str], peaks: DataFrame) -> DataFrame:
    """Per peak (frame, peak_bin, peak_mag): from the nearest bin on each side at or below peak / sqrt 2, in Hz."""
    low = F.col("mag") <= F.col("peak_mag") / F.sqrt(F.lit(2.0))
    rows = spectrum.join(peaks, frame)
    sides = rows.groupBy(*frame, "peak_bin").agg(
        F.max(F.when(low & (F.col("bin") < F.col("peak_bin")), F.struct("bin", "freq_hz"))).alias("l"),
        F.min(F.when(low & (F.col("bin") > F.col("peak_bin")), F.struct("bin", "freq_hz"))).alias("r"),
        F.min("freq_hz").alias("f0"),
        F.max("freq_hz").alias("f1"),
    )
    return sides.select(*frame, "peak_bin", (F.coalesce(F.col("r.freq_hz"), F.col("f1")) - F.coalesce(F.col("l.freq_hz"), F.col("f0"))).alias("bandwidth_hz"))


def local_maxima(series: DataFrame, by: list[str], order: list[str], x: str, height: float | Column = 0.0) -> DataFrame:
    w = _over(by, order)
    at_least = F.lit(height) if isinstance(height, float) else height
    return series.withColumn("_a", F.lag(x).over(w)).withColumn("_b", F.lead(x).over(w)).where((F.col(x) > F.col("_a")) & (F.col(x) > F.col("_b")) & (F.col(x) >= at_least)).drop("_a", "_b")


def _deviation(values: Column) -> Column:
    """Population deviation of an array by Welford's updates in its order, so the last digits do not hang on partitions."""
    none = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "mean", "m2")])

    def add(a: Column, x: Column) -> Column:
        n = a["n"] + 1.0
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["m2"] + (x - mean) * (x - a["mean"])).alias("m2"))

    return F.aggregate(values, none, add, lambda a: F.sqrt(a["m2"] / F.nullif(a["n"], F.lit(0.0))))


def peak_regularity(peaks: DataFrame, by: list[str], position: str, least: int = 3, cv: float = 0.1) -> DataFrame:
    """Whether the distances between more than ``least`` peaks vary by less than ``cv`` of their mean. They are added in
    order of position: a variation of just ``cv`` is judged alike however the rows are split."""
    rows = peaks.withColumn("_g", F.col(position) - F.lag(position).over(_over(by, [position])))
    gaps = F.array_sort(F.collect_list(F.when(F.col("_g").isNotNull(), F.struct(F.col(position), F.col("_g").cast("double").alias("g")))))
    out = rows.groupBy(*by).agg(F.count("*").alias("peaks"), F.avg("_g").alias("_m"), gaps.alias("_gaps"))
    spread = ratio(_deviation(F.transform("_gaps", lambda x: x["g"])), F.col("_m"), None)
    return out.select(*by, "peaks", F.coalesce(spread, F.lit(1.0)).alias("cv")).withColumn("regular", (F.col("peaks") > least) & (F.col("cv") < cv))


def fade_factor(position: Column, length: Column, fade: Column) -> Column:
    """Linear ramp in and out over ``fade`` samples at both ends."""
    step = F.greatest(fade - 1, F.lit(1))
    return F.least(F.lit(1.0), position / step, (length - 1 - position) / step)


def even_subsample(df: DataFrame, by: list[str], order: list[str], k: int = 10) -> DataFrame:
    """At most ``k`` rows a key, evenly spaced from first to last: position trunc(i (n - 1) / (k - 1))."""
    w = Window.partitionBy(*by)
    rows = df.withColumn("_p", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    # the i whose position could be this row's: the nearest from above
    i = F.ceil(F.col("_p") * F.lit(float(k - 1)) / F.greatest(F.col("_n") - 1, F.lit(1)))
    hit = F.floor(i * (F.col("_n") - 1) / F.lit(float(k - 1))) == F.col("_p")
    return rows.where((F.col("_n") <= k) | hit).drop("_p", "_n")
