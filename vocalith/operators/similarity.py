"""Joins and set comparisons of embedding tables: rows (keys..., seq, v), v an ARRAY of numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def ranked(df: DataFrame, by: list[str], order: list[Column], limit: int | None = None) -> DataFrame:
    """Position ``rn`` of each row within ``by``; Spark prunes groups early where a limit is given."""
    out = df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return out if limit is None else out.where(F.col("rn") <= limit)


def zip_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Row i of one side with row i of the other; the shorter side decides. Both have ``rn`` and ``v``."""
    left = a.select(*on, "rn", F.col("v").alias("va"))
    return left.join(b.select(*on, "rn", F.col("v").alias("vb")), [*on, "rn"])


def with_norm(df: DataFrame) -> DataFrame:
    return df.withColumn("v", V.as_double(F.col("v"))).withColumn("norm", V.norm(F.col("v")))


def all_pairs(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Every vector of one side with every vector of the other of the same key. Norms are computed once a vector."""
    left = with_norm(a).select(*on, F.col("seq").alias("i"), F.col("v").alias("va"), F.col("norm").alias("na"))
    right = with_norm(b).select(*on, F.col("seq").alias("j"), F.col("v").alias("vb"), F.col("norm").alias("nb"))
    return left.join(right, on).select(*on, "i", "j", V.cosine(F.col("va"), F.col("vb"), F.col("na"), F.col("nb")).alias("sim"))


def pair_stats(sims: DataFrame, on: list[str], pairs: DataFrame | None = None, keep_all: bool = False) -> DataFrame:
    """Mean, median, extremes and population deviation of ``sim``; zeros for pairs without any, if ``pairs`` lists them."""
    aggs = [F.avg("sim").alias("mean"), F.median("sim").alias("median"), F.max("sim").alias("max"), F.min("sim").alias("min"), F.stddev_pop("sim").alias("std"), F.count("sim").alias("n")]
    if keep_all:
        aggs.append(F.transform(F.array_sort(F.collect_list(F.struct("i", "j", "sim"))), lambda x: x["sim"]).alias("all_similarities"))
    out = sims.groupBy(*on).agg(*aggs)
    if pairs is not None:
        out = pairs.join(out, on, "left").fillna(0.0, ["mean", "median", "max", "min", "std"]).fillna(0, ["n"])
    return out


def mean_vector(df: DataFrame, by: list[str]) -> DataFrame:
    """Element-wise mean of ``v``: one running sum a key with map-side combining, no row for each element."""
    whole = df.where(F.col("v").isNotNull()).select(*by, array_to_vector(V.as_double(F.col("v"))).alias("v"))
    return whole.groupBy(*by).agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("v"))


def compare_pair(va: Column, vb: Column, family: str = "ecapa") -> list[Column]:
    """The single-pair bundle: cosine, Euclidean similarity, correlation, probability, confidence, decision."""
    cosine = V.cosine_or_null(va, vb)
    p = V.calibrated(cosine, family)
    same = cosine >= V.SAME_SPEAKER_COSINE if family == "res" else p >= V.SAME_SPEAKER_PROBABILITY
    return [
        cosine.alias("cosine"),
        V.euclid_similarity(va, vb).alias("euclid"),
        V.pearson(va, vb).alias("correlation"),
        p.alias("probability"),
        V.confidence(p).alias("confidence"),
        same.alias("same_speaker"),
        (V.confidence(p) >= V.RELIABLE_CONFIDENCE).alias("reliable"),
    ]


def temporal_stability(partials: DataFrame, whole: DataFrame, by: list[str]) -> DataFrame:
    """Mean cosine of each part with the whole and 1 - min(1, 5 std); 1 and 1 for fewer than two parts."""
    joined = partials.select(*by, V.as_double(F.col("v")).alias("p")).join(whole.select(*by, V.as_double(F.col("v")).alias("w")), by)
    sims = joined.select(*by, V.cosine_or_null(F.col("p"), F.col("w")).alias("sim"))
    few = F.count("sim") < 2
    return sims.groupBy(*by).agg(
        F.when(few, 1.0).otherwise(F.avg("sim")).alias("stability"),
        F.when(few, 1.0).otherwise(F.lit(1.0) - F.least(F.lit(1.0), F.lit(5.0) * F.stddev_pop("sim"))).alias("consistency"),
        F.count("sim").alias("parts"),
    )


def sound_event_comparison(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Sets of sound-event vectors: cosine of the mean vectors, best pairwise cosine, mean pairwise correlation."""
    means = mean_vector(a, on).withColumnRenamed("v", "ma").join(mean_vector(b, on).withColumnRenamed("v", "mb"), on)
    means = means.select(*on, V.cosine(F.col("ma"), F.col("mb")).alias("mean_cosine"))

    @F.pandas_udf("max_cosine double, correlations double, n long")
    def compared(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_compared(*r) for r in x.itertuples(index=False)], columns=["max_cosine", "correlations", "n"])

    left, right = (_blocks(df, on).withColumnsRenamed({"flat": f"flat_{s}", "rows": f"rows_{s}"}) for df, s in ((a, "a"), (b, "b")))
    parts = left.join(right, on).select(*on, compared(F.struct("flat_a", "rows_a", "flat_b", "rows_b")).alias("c")).select(*on, "c.*")
    pairs = parts.groupBy(*on).agg(F.max("max_cosine").alias("max_cosine"), (F.sum("correlations") / F.sum("n")).alias("mean_correlation"))
    return means.join(pairs, on)


def _blocks(df: DataFrame, on: list[str], size: int = 64) -> DataFrame:
    """Up to ``size`` vectors of a key end to end in one row, so large sets meet block by block."""
    whole = df.where(F.col("v").isNotNull()).select(*on, "seq", V.as_double(F.col("v")).alias("v"))
    block = F.floor((F.row_number().over(Window.partitionBy(*on).orderBy("seq")) - 1) / F.lit(size))
    return whole.withColumn("_block", block).groupBy(*on, "_block").agg(F.flatten(F.collect_list("v")).alias("flat"), F.count("*").alias("rows")).drop("_block")


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; a row without length stays zero."""
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n != 0)


def _compared(flat_a, rows_a: int, flat_b, rows_b: int) -> tuple[float, float, int]:
    """Highest cosine, sum of the correlations and number of the pairs of two blocks of vectors."""
    a, b = np.asarray(flat_a, dtype=float).reshape(rows_a, -1), np.asarray(flat_b, dtype=float).reshape(rows_b, -1)
    cosines = _unit(a) @ _unit(b).T
    centred = [_unit(x - x.mean(1, keepdims=True)) for x in (a, b)]
    return float(cosines.max()), float(centred[0].sum(0) @ centred[1].sum(0)), rows_a * rows_b


def plda_score(cosine: Column) -> tuple[Column, Column]:
    """The placeholder score of the contract: the cosine itself and ten times it as log-likelihood ratio."""
    return cosine, F.lit(10.0) * cosine


def bayesian_score(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Mean of the scores (0.5 without any), and their population deviation where there are several."""
    return scores.groupBy(*by).agg(F.coalesce(F.avg(score), F.lit(0.5)).alias("posterior"), F.when(F.count(score) > 1, F.stddev_pop(score)).otherwise(0.0).alias("spread"))
