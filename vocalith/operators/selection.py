"""Selection of segments: top-k by a score, greedy non-overlapping choice, classes and cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_segments(windows: DataFrame, by: list[str], score: str, start: str, k: int = 5) -> DataFrame:
    """The ``k`` best, the earliest of equals. Exact for windows half a window apart, as neighbours may overlap by half."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.col(start))
    return windows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def greedy_segments(windows: DataFrame, by: list[str], score: str, start: str, length: float, k: int = 5, overlap: float = 0.5, fill: bool = True) -> DataFrame:
    """Best first, skipping windows that overlap a chosen one by more than ``overlap`` of the length; then, to reach
    ``k``, the best of the rest. One recording at a time; a recording's windows are bounded by its duration.

    Adds ``rank`` (order of choice) and ``filled``.
    """

    def choose(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values([score, start], ascending=[False, True], kind="stable").reset_index(drop=True)
        chosen: list[int] = []
        for i, s in enumerate(x[start]):
            if len(chosen) == k:
                break
            if all(max(0.0, length - abs(s - x[start][j])) <= overlap * length for j in chosen):
                chosen.append(i)
        plain = len(chosen)
        if fill:
            chosen += [i for i in range(len(x)) if i not in chosen][: k - plain]
        out = x.loc[chosen].copy()
        out["rank"] = range(1, len(chosen) + 1)
        out["filled"] = [i >= plain for i in range(len(chosen))]
        return out

    schema = ", ".join(f"`{c}` {t}" for c, t in windows.dtypes) + ", rank int, filled boolean"
    return windows.groupBy(*by).applyInPandas(choose, schema)


def prepared_segments(windows: DataFrame, by: list[str], start: str, length: float, speech: str = "speech_ratio", voiced: str = "voiced_ratio", k: int = 5) -> DataFrame:
    """The ``k`` windows best by 0.6 of their speech and 0.4 of their voiced share, in time order: at most a quarter of
    their length in common, the best of the rest where there are too few. Adds ``score``, ``filled`` and ``seg_no``."""
    scored = windows.withColumn("score", F.lit(0.6) * F.col(speech) + F.lit(0.4) * F.col(voiced))
    chosen = greedy_segments(scored, by, "score", start, length, k, 0.25).drop("rank")
    return chosen.withColumn("seg_no", F.row_number().over(Window.partitionBy(*by).orderBy(start)))


def best_segment(segments: DataFrame, by: list[str], score: str, start: str) -> DataFrame:
    """The best, the earliest of equals."""
    rest = [c for c in segments.columns if c not in by]
    return segments.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(start))).alias("_b")).select(*by, "_b.*")


def cut_points(recordings: DataFrame, segments: DataFrame, by: list[str], k: int = 5, parts: int = 5) -> DataFrame:
    """The ``k`` longest speech runs in time order; equal parts of recordings without any."""
    longest = Window.partitionBy(*by).orderBy(F.desc("duration_s"), "start_s")
    in_time = Window.partitionBy(*by).orderBy("start_s")
    found = segments.withColumn("_r", F.row_number().over(longest)).where(F.col("_r") <= k).select(*by, F.row_number().over(in_time).cast("int").alias("part"), "start_s", "end_s")
    none = recordings.join(segments.select(*by).distinct(), by, "left_anti")
    step = F.col("duration_s") / parts
    equal = none.select(*by, "duration_s", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("i")).select(*by, (F.col("i") + 1).alias("part"), (step * F.col("i")).alias("start_s"), (step * (F.col("i") + 1)).alias("end_s"))
    return found.unionByName(equal)


def preparation_score(speech_share: Column, voiced_share: Column) -> Column:
    return F.lit(0.6) * speech_share + F.lit(0.4) * voiced_share


def top_classes(scores: DataFrame, by: list[str], k: int = 3, step_s: float = 0.48) -> DataFrame:
    """The ``k`` best classes of each frame and the frame's time; ties by class name."""
    w = Window.partitionBy(*by, "frame").orderBy(F.desc("score"), "class")
    out = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.withColumn("ts", F.col("frame") * F.lit(step_s))


def fill_from_rest(chosen: DataFrame, pool: DataFrame, by: list[str], key: str, score: str, k: int) -> DataFrame:
    """Selected rows, made up to ``k`` a key from the best of the rest (anti join, then union)."""
    rest = pool.join(chosen.select(*by, key), [*by, key], "left_anti")
    have = chosen.groupBy(*by).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy(F.desc(score), key)
    more = rest.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).join(have, by, "left").where(F.col("_r") <= k - F.coalesce("_n", F.lit(0))).drop("_r", "_n")
    return chosen.withColumn("filled", F.lit(False)).unionByName(more.withColumn("filled", F.lit(True)))
