"""Statistics of long tables: metric summaries, intervals, fusion, weighted moments, histograms, outliers.

Standard deviations are of the population unless said otherwise; percentiles interpolate linearly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clip01, ratio, t_quantile_udf

#: Fixed value: a score above this counts as a strong match.
STRONG = 0.9


def metric_summary(sims: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Median, mean, deviation, extremes, count and strong matches of each metric."""
    return sims.groupBy(*by).agg(
        F.coalesce(F.median(score), F.lit(0.0)).alias("median"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(score), F.lit(0.0)).alias("std"),
        F.coalesce(F.min(score), F.lit(0.0)).alias("min"),
        F.coalesce(F.max(score), F.lit(0.0)).alias("max"),
        F.count(score).alias("n"),
        F.count_if(F.col(score) > STRONG).alias("n_high"),
    )


def confidence_interval(sims: DataFrame, by: list[str], score: str = "score", level: float = 0.95, clamp: bool = True) -> DataFrame:
    """mean -+ t(n - 1) s / sqrt(n) with the sample deviation, clamped to 0..1; (0, 1) for fewer than two scores.

    The quantile is Student's at any number of scores: computed once for each different one of a batch of keys.
    """
    stats = sims.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("s"))
    few = F.col("n") < 2
    freedom = F.when(~few, (F.col("n") - 1).cast("double"))
    stats = stats.withColumn("_t", t_quantile_udf(level)(freedom))
    half = F.col("_t") * F.col("s") / F.sqrt(F.greatest(F.col("n"), F.lit(1)).cast("double"))
    bound = clip01 if clamp else (lambda c: c)
    return stats.select(*by, "n", F.when(few, 0.0).otherwise(bound(F.col("mean") - half)).alias("ci_lo"), F.when(few, 1.0).otherwise(bound(F.col("mean") + half)).alias("ci_hi"))


def with_weights(summary: DataFrame, weights: DataFrame, metric: str = "metric") -> DataFrame:
    """Weight of each metric; one that the table does not name counts 1."""
    return summary.join(weights.select(F.col("metric").alias(metric), F.col("weight").alias("_w")), metric, "left").withColumn("weight", F.coalesce("_w", F.lit(1.0))).drop("_w")


def fuse(summary: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean of the metrics' medians, and their consistency: the deviation of the medians. Empty metrics do not count."""
    real = summary.where("n > 0")
    return real.groupBy(*by).agg(
        ratio(F.sum(F.col("weight") * F.col("median")), F.sum("weight")).alias("final_score"),
        F.stddev_pop("median").alias("consistency"),
        F.count("*").alias("metrics"),
    )


def with_file_scores(segments: DataFrame, files: DataFrame) -> DataFrame:
    """Whole-file scores stand beside the segment scores of the same metric, told apart by ``scope``."""
    return segments.withColumn("scope", F.lit("segment")).unionByName(files.withColumn("scope", F.lit("file")), allowMissingColumns=True)


def percentile(x: str, share: float, accuracy: int | None = None) -> Column:
    """Exact, or with ``accuracy`` from a sketch of bounded size."""
    return F.percentile(x, F.lit(share)) if accuracy is None else F.percentile_approx(x, F.lit(share), F.lit(accuracy)).cast("double")


def _beside(rows: DataFrame, stats: DataFrame, by: list[str]) -> DataFrame:
    """Each row with its key's statistics: a join whose large partitions can be split, where a window would keep a
    whole key on one task. Null is a key like any other."""
    renamed = stats.withColumnsRenamed({k: f"_by_{k}" for k in by})
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by]).drop(*[f"_by_{k}" for k in by])


def weighted_stats(df: DataFrame, by: list[str], x: str = "x", w: str = "w", accuracy: int | None = None) -> DataFrame:
    """Reliability-weighted statistics over values above zero.

    Mean, variance and deviation by weight, effective size (sum w)^2 / sum w^2, its standard error, extremes,
    quartiles, IQR, MAD, population skewness and excess kurtosis, mean reliability. Where all weights are 0 each
    counts alike. ``accuracy``: take percentiles from sketches. Two aggregations with map-side combining; between
    them the rows are joined with the first one's result.
    """
    rows = df.where((F.col(x) > 0) & (F.col(w) >= 0)).select(*by, F.col(x).cast("double").alias("x"), F.col(w).cast("double").alias("w"))
    weighed = F.sum("w") > 0
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("count"),
        weighed.alias("_weighed"),
        F.when(weighed, ratio(F.sum(F.col("w") * F.col("x")), F.sum("w"), None)).otherwise(F.avg("x")).alias("mean"),
        F.when(weighed, ratio(F.sum("w") * F.sum("w"), F.sum(F.col("w") * F.col("w")), None)).otherwise(F.count("*").cast("double")).alias("n_eff"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
        F.avg("x").alias("_mu"),
        percentile("x", 0.5, accuracy).alias("median"),
        percentile("x", 0.25, accuracy).alias("q1"),
        percentile("x", 0.75, accuracy).alias("q3"),
        F.avg("w").alias("mean_reliability"),
    )
    near = _beside(rows, stats.select(*by, "_weighed", F.col("mean").alias("_m"), "_mu", F.col("median").alias("_med")), by)
    near = near.withColumns({"_u": F.when(F.col("_weighed"), F.col("w")).otherwise(1.0), "_far": F.abs(F.col("x") - F.col("_med"))})
    d = F.col("x") - F.col("_mu")
    spread = near.groupBy(*by).agg(
        ratio(F.sum(F.col("_u") * (F.col("x") - F.col("_m")) ** 2), F.sum("_u"), None).alias("variance"),
        percentile("_far", 0.5, accuracy).alias("mad"),
        F.avg(d * d).alias("_m2"),
        F.avg(d * d * d).alias("_m3"),
        F.avg(d * d * d * d).alias("_m4"),
    )
    out = _beside(stats, spread, by).withColumns(
        {
            "std": F.sqrt("variance"),
            "sem": F.sqrt(ratio(F.col("variance"), F.col("n_eff"), None)),
            "iqr": F.col("q3") - F.col("q1"),
            "skewness": F.when(F.col("_m2") > 0, F.col("_m3") / F.nullif(F.pow("_m2", F.lit(1.5)), F.lit(0.0))),
            "kurtosis": F.when(F.col("_m2") > 0, F.col("_m4") / F.nullif(F.col("_m2") * F.col("_m2"), F.lit(0.0)) - 3.0),
        }
    )
    return out.drop("_weighed", "_mu", "_m2", "_m3", "_m4")


def with_t_interval(stats: DataFrame, quantile) -> DataFrame:
    """Unclamped interval of the weighted mean with n_eff - 1 degrees of freedom, whole or not; null without any."""
    t = quantile(F.when(F.col("n_eff") - 1 > 0, F.col("n_eff") - 1))
    return stats.withColumns({"ci_lo": F.col("mean") - t * F.col("sem"), "ci_hi": F.col("mean") + t * F.col("sem")})


#: The ratios of formants that are kept, numerator and denominator.
RATIOS = (("F2/F1", "F2", "F1"), ("F3/F2", "F3", "F2"), ("F4/F3", "F4", "F3"), ("F3/F1", "F3", "F1"))


def formant_ratios(tracks: DataFrame, by: list[str]) -> DataFrame:
    """Rows (by, key, x, w): each ratio with both sides present; its reliability is the mean of the two."""
    parts = [F.struct(F.lit(k).alias("key"), ratio(F.col(a), F.col(b), None).alias("x"), ((F.col(f"{a}_reliability") + F.col(f"{b}_reliability")) / 2).alias("w")) for k, a, b in RATIOS]
    rows = tracks.select(*by, F.explode(F.array(*parts)).alias("r")).select(*by, "r.*")
    return rows.where("x > 0 and w > 0")


def filled(stats: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Zero records for the members of ``dim`` without statistics."""
    numbers = [c for c, t in stats.dtypes if c not in on and t in ("double", "bigint", "int")]
    return dim.join(stats, on, "left").fillna(0, numbers)


def running_sum(x: Column | str, by: list[str], order: list[str]) -> Column:
    """Sum of ``x`` up to each row: added in order, so its last digits do not hang on how Spark splits the rows."""
    return F.sum(x).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def mean_in_order(running: str, x: Column | str, order: list[str]) -> Column:
    """Aggregate: mean of ``x`` from its ``running_sum`` in the same order, for means that are held against thresholds."""
    return F.max_by(running, F.struct(*order)) / F.nullif(F.count(x), F.lit(0))


def plain_stats(df: DataFrame, by: list[str], x: str = "x", order: list[str] | None = None) -> DataFrame:
    """Mean, median, deviation, extremes and range of the values above zero (pitch and tracked formants). With ``order``
    the mean is summed in it."""
    v = F.when(F.col(x) > 0, F.col(x))
    if order:
        df = df.withColumn("_run", running_sum(v, by, order))
    mean = mean_in_order("_run", v, order) if order else F.avg(v)
    return df.groupBy(*by).agg(mean.alias("mean"), F.median(v).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"), F.count(v).alias("n"))


def coefficient_of_variation(x: Column | str) -> Column:
    """Deviation over mean; 0 where the mean is not positive."""
    return F.coalesce(ratio(F.stddev_pop(x), F.avg(x)), F.lit(0.0))


def histogram_mode(df: DataFrame, by: list[str], x: str, lo: float, hi: float, bins: int) -> DataFrame:
    """The fullest of ``bins`` equal bins on [lo, hi] (the last is closed), the first of several: bin and its middle."""
    width = (hi - lo) / bins
    b = F.least(F.lit(bins - 1), F.floor((F.col(x) - F.lit(float(lo))) / F.lit(width)).cast("int"))
    counts = df.where(F.col(x).between(lo, hi)).groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"), F.max("n").alias("n"))
    return best.withColumn("mode", F.lit(float(lo)) + (F.col("bin") + F.lit(0.5)) * F.lit(width))


def histogram_entropy(df: DataFrame, by: list[str], x: str, bins: int = 100) -> DataFrame:
    """Entropy in bits of the histogram between the extremes, over the log2 of the number of bins in use."""
    keys = Window.partitionBy(*by)
    lo, hi = F.min(x).over(keys), F.max(x).over(keys)
    b = F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col(x) - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins).cast("int"))).otherwise(0)
    counts = df.select(*by, x).withColumn("bin", b).groupBy(*by, "bin").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(keys)
    out = counts.withColumn("h", -p * F.log2(p)).groupBy(*by).agg(F.sum("h").alias("entropy"), F.count("*").alias("bins"))
    return out.withColumn("normalized", F.when(F.col("bins") > 1, F.col("entropy") / F.nullif(F.log2(F.col("bins").cast("double")), F.lit(0.0))).otherwise(0.0))


#: Fixed value: makes the MAD comparable with a standard deviation.
MAD_SCALE = 1.4826


def mad_outliers(df: DataFrame, by: list[str], x: str = "x", threshold: float = 3.0, least: int = 5) -> DataFrame:
    """Flags values strictly outside median -+ threshold * 1.4826 * MAD; none where there are fewer than ``least``."""
    middle = df.groupBy(*by).agg(F.median(x).alias("median"), F.count(x).alias("_n"))
    out = _beside(df, middle, by).withColumn("_far", F.abs(F.col(x) - F.col("median")))
    out = _beside(out, out.groupBy(*by).agg(F.median("_far").alias("mad")), by)
    return out.withColumn("is_outlier", (F.col("_far") > F.lit(threshold * MAD_SCALE) * F.col("mad")) & (F.col("_n") >= least)).drop("_far", "_n")


def stability(df: DataFrame, by: list[str], order: list[Column], x: str = "x") -> DataFrame:
    """CV, relative mean deviation, relative IQR, lag-1 autocorrelation (over 10 values needed), 1 - min(1, 3 CV)."""
    keys = Window.partitionBy(*by)
    rows = df.where(F.col(x) > 0).select(*by, F.col(x).alias("x"), F.lag(x).over(keys.orderBy(*order)).alias("prev"), F.avg(x).over(keys).alias("mu"))
    out = rows.groupBy(*by).agg(
        F.count("x").alias("n"),
        coefficient_of_variation("x").alias("cv"),
        ratio(F.avg(F.abs(F.col("x") - F.col("mu"))), F.first("mu"), None).alias("rmad"),
        ratio(F.expr("percentile(x, 0.75) - percentile(x, 0.25)"), F.median("x")).alias("riqr"),
        F.when(F.count("x") > 10, F.coalesce(F.nanvl(F.corr("prev", "x"), F.lit(0.0)), F.lit(0.0))).otherwise(0.0).alias("autocorr"),
    )
    return out.withColumn("stability", F.when(F.col("n") >= 2, F.lit(1.0) - F.least(F.lit(1.0), F.lit(3.0) * F.col("cv"))).otherwise(0.0))


def class_shares(scores: DataFrame, by: list[str], classes: dict[str, list[str]], label: str = "class") -> DataFrame:
    """For each kind: 3 * share of rows whose label contains one of its words, at most 1; overall is their mean."""
    low = F.lower(F.col(label))
    hits = {k: sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int")) > 0 for k, words in classes.items()}
    out = scores.groupBy(*by).agg(*[F.least(F.lit(1.0), F.lit(3.0) * F.count_if(h) / F.greatest(F.count("*"), F.lit(1))).alias(k) for k, h in hits.items()])
    return out.withColumn("overall", sum((F.col(k) for k in list(classes)[1:]), F.col(next(iter(classes)))) / len(classes))


def normalized_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row-wise: each column over their sum, where that is positive."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return df.withColumns({c: F.when(total > 0, F.col(c) / F.nullif(total, F.lit(0.0))).otherwise(F.col(c)) for c in columns})


def overall_stability(each: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the ``stability`` of the formants of a key, those with too few values among them, and their number."""
    return each.groupBy(*by).agg(F.avg("stability").alias("overall_stability"), F.count("*").alias("formants"))
