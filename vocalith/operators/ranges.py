"""Range joins to small reference tables: formant bands, physiological ranges, vowel ratios.

The reference tables are literals of fixed size (a few dozen rows), so they may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Peak bands by formant, in Hz; they overlap, the first match counts.
PEAK_BANDS = (("F1", 100.0, 1000.0), ("F2", 800.0, 2500.0), ("F3", 1500.0, 3500.0), ("F4", 3000.0, 5000.0))
#: Bands of nasal and fricative energy, in Hz, both ends inside.
ENERGY_BANDS = (("nasal1", 250.0, 450.0), ("nasal2", 1000.0, 1200.0), ("antires", 700.0, 900.0), ("f_v", 1000.0, 2000.0), ("s_z", 2000.0, 4000.0), ("sh_zh", 4000.0, 8000.0))


def band_table(spark: SparkSession, bands) -> DataFrame:
    return spark.createDataFrame([(k, lo, hi, i) for i, (k, lo, hi) in enumerate(bands)], "key string, lo double, hi double, ord int")


def in_bands(df: DataFrame, x: str, bands: DataFrame) -> DataFrame:
    """A row for each band that holds ``x``: overlapping bands give several."""
    return df.join(F.broadcast(bands), F.col(x).between(F.col("lo"), F.col("hi")))


def first_band(df: DataFrame, row: list[str], x: str, bands: DataFrame) -> DataFrame:
    """The first band, in their order, that holds ``x``; rows outside all bands go."""
    w = Window.partitionBy(*row).orderBy("ord")
    return in_bands(df, x, bands).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "lo", "hi", "ord")


def first_band_key(x: Column, bands) -> Column:
    """The same as a row expression, for literal bands: no join, no shuffle."""
    out = None
    for k, lo, hi in bands:
        hit = x.between(lo, hi)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def best_in_band(candidates: DataFrame, frame: list[str], band: str, score: str) -> DataFrame:
    """The best candidate of each frame and band."""
    rest = [c for c in candidates.columns if c not in (*frame, band)]
    return candidates.groupBy(*frame, band).agg(F.max_by(F.struct(*rest), F.col(score)).alias("_b")).select(*frame, band, "_b.*")


def range_candidates(roots: DataFrame, frame: list[str], freq: str, ranges: DataFrame, quality: str) -> DataFrame:
    """Candidate frequencies to formants by gender: each goes to its first range, then the best of each formant stays."""
    w = Window.partitionBy(*frame, freq).orderBy("ord")
    hit = roots.join(F.broadcast(ranges), (roots["gender"] == ranges["gender"]) & roots[freq].between(ranges["lo"], ranges["hi"])).drop(ranges["gender"])
    hit = hit.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    middle, half = (F.col("lo") + F.col("hi")) / 2, (F.col("hi") - F.col("lo")) / 2
    hit = hit.withColumn("match_score", F.col(quality) * (F.lit(1.0) - F.abs(F.col(freq) - middle) / half))
    best = Window.partitionBy(*frame, "key").orderBy(F.desc("match_score"), F.col(freq))
    return hit.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


#: Ranges of F2/F1 by vowel, in the order that settles ties; they overlap.
VOWELS = (("a", 1.4, 2.1), ("e", 2.3, 3.2), ("i", 3.3, 4.7), ("o", 0.9, 1.6), ("u", 0.7, 1.3))
#: Physiological formant ranges in Hz by gender.
FORMANT_RANGES = {
    "male": {"F1": (250, 900), "F2": (800, 2300), "F3": (1800, 3000), "F4": (3000, 4500)},
    "female": {"F1": (300, 1100), "F2": (900, 2800), "F3": (2300, 3500), "F4": (3400, 5000)},
    "child": {"F1": (350, 1200), "F2": (1000, 3000), "F3": (2500, 4000), "F4": (3700, 5500)},
}
#: Usual distances between neighbouring formants in Hz by gender.
FORMANT_INTERVALS = {
    "male": {"F2-F1": (500, 1200), "F3-F2": (700, 1500), "F4-F3": (700, 1800)},
    "female": {"F2-F1": (600, 1400), "F3-F2": (800, 1700), "F4-F3": (800, 2000)},
    "child": {"F2-F1": (700, 1600), "F3-F2": (900, 1800), "F4-F3": (900, 2200)},
}


def range_table(spark: SparkSession, ranges=None) -> DataFrame:
    rows = [(g, k, float(lo), float(hi), i) for g, by in (ranges or FORMANT_RANGES).items() for i, (k, (lo, hi)) in enumerate(by.items())]
    return spark.createDataFrame(rows, "gender string, key string, lo double, hi double, ord int")


def vowel_match(frames: DataFrame, f1: str, f2: str, vowels=VOWELS) -> DataFrame:
    """The vowel whose range of F2/F1 holds the ratio nearest to its middle, the first of equals; ``unknown`` where
    none does, or only at an end. A row expression over the literal ranges: no join, no shuffle."""
    r = frames.withColumn("formant_ratio", F.coalesce(F.when((F.col(f1) > 0) & (F.col(f2) > 0), F.col(f2) / F.nullif(F.col(f1), F.lit(0.0))), F.lit(0.0)))
    x, best = F.col("formant_ratio"), []
    for i, (vowel, lo, hi) in enumerate(vowels):
        score = F.lit(1.0) - F.least(F.lit(1.0), F.abs(x - (lo + hi) / 2) / ((hi - lo) / 2))
        best.append(F.when(x.between(lo, hi), F.struct(score.alias("s"), F.lit(-i).alias("o"), F.lit(vowel).alias("vowel"))))
    out = r.withColumn("_b", F.greatest(*best))
    found = F.col("_b.s") > 0
    return out.withColumns({"vowel": F.when(found, F.col("_b.vowel")).otherwise("unknown"), "match_score": F.coalesce("_b.s", F.lit(0.0))}).drop("_b")
