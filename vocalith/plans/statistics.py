"""Queries over scores and weighted values. lineitem stands for the fact tables: supplier is the pair, line number or
return flag the metric, 1 - discount or quantity / 50 the score or reliability."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import t_quantile_udf, t_values
from ..operators import aggregates as A
from ..operators import metrics as M
from ..operators import rules as R
from ..operators import similarity as S
from ..sources import sinks
from .registry import query

SIMS = "sims AS (SELECT l_suppkey AS pair_id, CAST(l_linenumber AS VARCHAR) AS metric, 1.0 - l_discount AS score FROM lineitem)"
SUMMARY = "SELECT pair_id, metric, median(score) AS median, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, count(score) AS n, count(*) FILTER (score > 0.9) AS n_high FROM sims GROUP BY pair_id, metric"
WEIGHTS = (("1", 1.5), ("2", 1.2), ("3", 0.8), ("5", 1.8))
WSQL = "w(metric, weight) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS) + ")"


def sims(t):
    return t("lineitem").select(F.col("l_suppkey").alias("pair_id"), F.col("l_linenumber").cast("string").alias("metric"), (F.lit(1.0) - F.col("l_discount")).alias("score"))


#: Student's quantile from the normal one, by its series in 1 / df: to nine digits beyond 200 degrees of freedom.
T_SERIES = """z + (z^3 + z) / (4.0 * (n - 1)) + (5 * z^5 + 16 * z^3 + 3 * z) / (96.0 * (n - 1)^2)
+ (3 * z^7 + 19 * z^5 + 17 * z^3 - 15 * z) / (384.0 * (n - 1)^3)"""


@query(f"WITH {SIMS} {SUMMARY}", "median mean std min max")
def metric_summary(spark, t):
    return A.metric_summary(sims(t), ["pair_id", "metric"])


@query(
    f"""WITH {SIMS}, t(df, t) AS (VALUES {t_values(200)}), z AS (SELECT 1.959963984540054::DOUBLE AS z),
a AS (SELECT pair_id, metric, count(*) AS n, avg(score) AS m, stddev_samp(score) AS s FROM sims GROUP BY pair_id, metric),
q AS (SELECT a.*, coalesce(t, {T_SERIES}) AS t FROM a CROSS JOIN z LEFT JOIN t ON t.df = n - 1)
SELECT pair_id, metric, n, CASE WHEN n < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, m - t * s / sqrt(n))) END AS ci_lo,
CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, least(1.0, m + t * s / sqrt(n))) END AS ci_hi FROM q""",
    "ci_lo ci_hi",
)
def confidence_interval(spark, t):
    return A.confidence_interval(sims(t), ["pair_id", "metric"])


FUSED = f"WITH {SIMS}, {WSQL}, s AS ({SUMMARY}), f AS (SELECT pair_id, sum(coalesce(w.weight, 1.0) * s.median) / sum(coalesce(w.weight, 1.0)) AS final_score, stddev_pop(s.median) AS consistency, count(*) AS metrics FROM s LEFT JOIN w ON s.metric = w.metric GROUP BY pair_id)"


def fused(spark, t):
    weights = spark.createDataFrame(list(WEIGHTS), "metric string, weight double")
    return A.fuse(A.with_weights(A.metric_summary(sims(t), ["pair_id", "metric"]), weights), ["pair_id"])


@query(FUSED + " SELECT * FROM f", "final_score consistency")
def weighted_fusion(spark, t):
    return fused(spark, t)


@query(f"WITH {SIMS}, s AS ({SUMMARY}) SELECT pair_id, stddev_pop(median) AS consistency FROM s GROUP BY pair_id", "consistency")
def method_consistency(spark, t):
    return A.metric_summary(sims(t), ["pair_id", "metric"]).groupBy("pair_id").agg(F.stddev_pop("median").alias("consistency"))


@query(
    FUSED
    + """, v AS (SELECT pair_id, final_score, consistency, CASE WHEN final_score >= 0.95 AND consistency < 0.10 THEN 'very_high' WHEN final_score >= 0.88 AND consistency < 0.12 THEN 'high' WHEN final_score >= 0.80 AND consistency < 0.15 THEN 'probable' WHEN final_score >= 0.70 THEN 'similar' ELSE 'different' END AS verdict_code FROM (SELECT pair_id, round(final_score, 9) AS final_score, round(consistency, 9) AS consistency FROM f))
SELECT v.pair_id, CASE WHEN v.pair_id % 7 = 0 THEN CASE WHEN final_score >= 0.85 THEN 'unreliable_similar' ELSE 'unreliable' END ELSE verdict_code END AS verdict_code,
array_to_string(list_filter([CASE WHEN v.pair_id % 2 = 0 THEN 'modified' END, CASE WHEN consistency > 0.15 THEN 'inconsistent' END], lambda x: x IS NOT NULL), ',') AS warning_codes,
CASE WHEN consistency < 0.05 THEN 'green' WHEN consistency < 0.15 THEN 'yellow' ELSE 'red' END AS consistency_light,
CASE WHEN width < 0.1 THEN 'green' WHEN width < 0.2 THEN 'yellow' ELSE 'red' END AS ci_light, CASE WHEN middle > 0.85 THEN 'green' WHEN middle > 0.7 THEN 'yellow' ELSE 'red' END AS median_light
FROM v JOIN (SELECT l_suppkey AS pair_id, round(4 * stddev_pop(1 - l_discount) / sqrt(count(*)) * (1 + l_suppkey % 6), 9) AS width, round(median(1 - l_discount) - (l_suppkey % 4) * 0.1, 9) AS middle FROM lineitem GROUP BY l_suppkey) AS x ON v.pair_id = x.pair_id""",
)
def verdict_cascade(spark, t):
    # scores right at a threshold: both engines round away what the order of a sum leaves
    f = fused(spark, t).withColumns({c: F.round(c, 9) for c in ("final_score", "consistency")})
    spoof = F.when(F.col("pair_id") % 7 == 0, 0.71).otherwise(0.7)
    k, x = F.col("pair_id"), F.lit(1.0) - F.col("l_discount")
    spread = t("lineitem").groupBy(F.col("l_suppkey").alias("pair_id")).agg((F.stddev_pop(x) / F.sqrt(F.count("*"))).alias("se"), F.median(x).alias("middle"))
    spread = spread.select("pair_id", F.round(F.lit(4.0) * F.col("se") * (k % 6 + 1), 9).alias("width"), F.round(F.col("middle") - (k % 4) * F.lit(0.1), 9).alias("middle"))
    f = f.join(spread, "pair_id")
    lights = [c.alias(name) for name, c in R.lights(F.col("width"), F.col("middle"), F.col("consistency")).items()]
    return f.select("pair_id", R.gated_verdict(F.col("final_score"), F.col("consistency"), spoof, F.lit(0.1)).alias("verdict_code"), F.array_join(R.warnings(F.col("pair_id") % 2 == 0, F.col("consistency")), ",").alias("warning_codes"), *lights)


@query(
    f"""WITH {SIMS}, s AS (SELECT pair_id, metric, score, 'segment' AS scope FROM sims UNION ALL SELECT pair_id, 'file' AS metric, avg(score) AS score, 'file' AS scope FROM sims GROUP BY pair_id)
SELECT scope, metric, count(*) AS n, avg(score) AS mean FROM s GROUP BY scope, metric""",
    "mean",
)
def union_scope(spark, t):
    files = sims(t).groupBy("pair_id").agg(F.avg("score").alias("score")).withColumn("metric", F.lit("file"))
    return A.with_file_scores(sims(t), files).groupBy("scope", "metric").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


@query(f"WITH {SIMS}, {WSQL} SELECT s.metric, coalesce(w.weight, 1.0) AS weight, count(*) AS n FROM sims s LEFT JOIN w ON s.metric = w.metric GROUP BY s.metric, w.weight", "weight")
def default_weight_join(spark, t):
    weights = spark.createDataFrame(list(WEIGHTS), "metric string, weight double")
    return A.with_weights(sims(t).groupBy("metric").agg(F.count("*").alias("n")), weights).select("metric", "weight", "n")


@query(f"WITH {SIMS} SELECT pair_id, metric, coalesce(avg(score), 0.5) AS posterior, CASE WHEN count(*) > 1 THEN stddev_pop(score) ELSE 0.0 END AS spread FROM sims GROUP BY pair_id, metric", "posterior spread")
def bayesian_mean(spark, t):
    return S.bayesian_score(sims(t), ["pair_id", "metric"])


WEIGHTED = """WITH r AS (SELECT l_suppkey AS g, l_quantity AS x, 1.0 - l_discount AS w FROM lineitem WHERE l_quantity > 0),
m AS (SELECT g, sum(w * x) / sum(w) AS m, median(x) AS med, avg(x) AS mu FROM r GROUP BY g),
s AS (SELECT r.g, count(*) AS count, any_value(m.m) AS mean, any_value(m.med) AS median, sum(w * (x - m.m) * (x - m.m)) / sum(w) AS variance, sum(w) * sum(w) / sum(w * w) AS n_eff, min(x) AS min, max(x) AS max,
quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, median(abs(x - m.med)) AS mad, avg((x - mu) * (x - mu)) AS m2, avg((x - mu) * (x - mu) * (x - mu)) AS m3, avg((x - mu) * (x - mu) * (x - mu) * (x - mu)) AS m4, avg(w) AS mean_reliability FROM r JOIN m ON r.g = m.g GROUP BY r.g)"""


def weighted(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.lit(1.0) - F.col("l_discount")).alias("w"))
    return A.weighted_stats(rows, ["g"])


@query(WEIGHTED + " SELECT g, count, mean, variance, sqrt(variance) AS std, n_eff, sqrt(variance / n_eff) AS sem, min, max, median, mean_reliability FROM s", "mean variance std n_eff sem min max median mean_reliability")
def weighted_stats(spark, t):
    return weighted(t).select("g", "count", "mean", "variance", "std", "n_eff", "sem", "min", "max", "median", "mean_reliability")


@query(WEIGHTED + " SELECT g, q1, q3, q3 - q1 AS iqr, mad FROM s", "q1 q3 iqr mad")
def percentiles_iqr(spark, t):
    return weighted(t).select("g", "q1", "q3", "iqr", "mad")


@query(WEIGHTED + " SELECT g, m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) - 3.0 AS kurtosis FROM s", "skewness kurtosis")
def skew_kurt(spark, t):
    return weighted(t).select("g", "skewness", "kurtosis")


@query(None)
def weighted_interval(spark, t):
    """t-intervals with fractional degrees of freedom: no SQL for the quantile; held against golden values in tests."""
    return A.with_t_interval(weighted(t), t_quantile_udf(0.95)).select("g", "n_eff", "mean", "ci_lo", "ci_hi")


TRACKS = """tracks AS (SELECT l_suppkey AS g, l_orderkey AS k, l_linenumber AS t, l_quantity * 20 AS F1, 600 + l_extendedprice / 50 AS F2, 1800 + l_partkey % 1500 AS F3, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE 3200 + l_suppkey * 10 END AS F4, 1.0 - l_discount AS r1, 1.0 - l_tax AS r2, 0.5 + l_discount AS r3, 0.9 AS r4,
CASE l_returnflag WHEN 'A' THEN 'male' WHEN 'N' THEN 'female' ELSE 'child' END AS gender, l_linestatus = 'F' AS is_voiced, l_quantity AS energy, CASE WHEN l_linenumber % 3 = 0 THEN 3 ELSE 4 END AS formant_count FROM lineitem)"""


def tracks(t):
    """lineitem as formant tracks: one row a frame."""
    n = F.col("l_linenumber")
    d = lambda c: c.cast("double")
    return t("lineitem").select(
        F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("k"), n.alias("t"),
        (F.col("l_quantity") * 20).alias("F1"), (F.lit(600.0) + F.col("l_extendedprice") / 50).alias("F2"), d(F.lit(1800) + F.col("l_partkey") % 1500).alias("F3"), F.when(n % 3 != 0, d(F.lit(3200) + F.col("l_suppkey") * 10)).alias("F4"),
        (F.lit(1.0) - F.col("l_discount")).alias("F1_reliability"), (F.lit(1.0) - F.col("l_tax")).alias("F2_reliability"), (F.lit(0.5) + F.col("l_discount")).alias("F3_reliability"), F.lit(0.9).alias("F4_reliability"),
        F.when(F.col("l_returnflag") == "A", "male").when(F.col("l_returnflag") == "N", "female").otherwise("child").alias("gender"),
        (F.col("l_linestatus") == "F").alias("is_voiced"), F.col("l_quantity").alias("energy"), F.when(n % 3 == 0, 3).otherwise(4).alias("formant_count"),
    )


RATIOS = """r AS (SELECT g, unnest(['F2/F1', 'F3/F2', 'F4/F3', 'F3/F1']) AS key, unnest([CASE WHEN F1 > 0 THEN F2 / F1 END, CASE WHEN F2 > 0 THEN F3 / F2 END, CASE WHEN F3 > 0 THEN F4 / F3 END, CASE WHEN F1 > 0 THEN F3 / F1 END]) AS x,
unnest([(r1 + r2) / 2, (r2 + r3) / 2, (r3 + r4) / 2, (r1 + r3) / 2]) AS w FROM tracks)"""


@query(f"WITH {TRACKS}, {RATIOS} SELECT g, key, count(*) AS count, sum(w * x) / sum(w) AS mean, sum(w) * sum(w) / sum(w * w) AS n_eff, min(x) AS min, max(x) AS max, median(x) AS median FROM r WHERE x > 0 AND w > 0 GROUP BY g, key", "mean n_eff min max median")
def ratio_stats(spark, t):
    return A.weighted_stats(A.formant_ratios(tracks(t), ["g"]), ["g", "key"]).select("g", "key", "count", "mean", "n_eff", "min", "max", "median")


@query(
    f"""WITH {TRACKS}, {RATIOS}, s AS (SELECT g, key, count(*) AS count, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS ci_lo, max(x) AS ci_hi FROM r WHERE x > 0 AND w > 0 AND key <> 'F4/F3' GROUP BY g, key),
j AS (SELECT a.g AS ga, b.g AS gb, a.key, 0.6 * (1 - least(1, abs(a.mean - b.mean))) + 0.3 * (greatest(0, least(a.ci_hi, b.ci_hi) - greatest(a.ci_lo, b.ci_lo)) / (greatest(a.ci_hi, b.ci_hi) - least(a.ci_lo, b.ci_lo))) + 0.1 * least(a.std, b.std) / greatest(a.std, b.std) AS s,
CASE a.key WHEN 'F2/F1' THEN 1.5 WHEN 'F3/F2' THEN 1.3 ELSE 1.2 END::DOUBLE AS w FROM s a JOIN s b ON a.key = b.key AND b.g = a.g + 1)
SELECT ga AS pair_id, sum(s * w) / sum(w) AS similarity, count(*) AS keys FROM j GROUP BY ga""",
    "similarity",
)
def profile_overlap(spark, t):
    r = A.formant_ratios(tracks(t), ["g"]).where("key <> 'F4/F3'")
    s = r.groupBy("g", "key").agg(F.count("*").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("ci_lo"), F.max("x").alias("ci_hi"))
    return M.statistical_profile(s.withColumnRenamed("g", "pair_id"), s.withColumn("pair_id", F.col("g") - 1).drop("g"), ["pair_id"])


@query("WITH m AS (SELECT l_suppkey AS g, l_quantity AS x, median(l_quantity) OVER (PARTITION BY l_suppkey) AS med FROM lineitem), d AS (SELECT *, median(abs(x - med)) OVER (PARTITION BY g) AS mad, count(*) OVER (PARTITION BY g) AS n FROM m) SELECT g, any_value(med) AS median, any_value(mad) AS mad, count(*) FILTER (n >= 5 AND abs(x - med) > 1.0 * 1.4826 * mad) AS outliers FROM d GROUP BY g", "median mad")
def mad_outliers(spark, t):
    rows = A.mad_outliers(t("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x")), ["g"], threshold=1.0)
    return rows.groupBy("g").agg(F.first("median").alias("median"), F.first("mad").alias("mad"), F.count_if("is_outlier").alias("outliers"))


@query("SELECT l_suppkey AS g, CASE WHEN avg(l_quantity) > 0 THEN stddev_pop(l_quantity) / avg(l_quantity) ELSE 0 END AS cv FROM lineitem GROUP BY l_suppkey", "cv")
def coefficient_variation(spark, t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("g")).agg(A.coefficient_of_variation("l_quantity").alias("cv"))


@query(
    f"""WITH {TRACKS}, q AS (SELECT g, f, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std, min(x) AS min, max(x) AS max, max(x) - min(x) AS range, count(x) AS n FROM (SELECT g, unnest(['F1', 'F2', 'F3', 'F4']) AS f, unnest([F1, F2, F3, F4]) AS x FROM tracks) GROUP BY g, f)
SELECT * FROM q""",
    "mean median std min max range",
)
def tracker_stats(spark, t):
    long = tracks(t).select("g", F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.col(f).alias("x")) for f in R.FORMANTS])).alias("e")).select("g", "e.*")
    return A.plain_stats(long, ["g", "f"])


@query(
    f"""WITH {TRACKS}, m AS (SELECT g, avg(F1) AS F1, avg(F2) AS F2, avg(F3) AS F3, avg(F4) AS F4 FROM tracks GROUP BY g),
rd AS (SELECT a.g AS pair_id, (1 - least(1, abs(a.F1 - b.F1) / greatest(a.F1, b.F1)) + 1 - least(1, abs(a.F2 - b.F2) / greatest(a.F2, b.F2)) + 1 - least(1, abs(a.F3 - b.F3) / greatest(a.F3, b.F3)) + 1 - least(1, abs(a.F4 - b.F4) / greatest(a.F4, b.F4))) / 4 AS similarity,
(17200.0 / a.F3 + 17200.0 / a.F4) / 2 AS la, (17200.0 / b.F3 + 17200.0 / b.F4) / 2 AS lb FROM m a JOIN m b ON b.g = a.g + 1)
SELECT pair_id, similarity, la AS length_cm, 1 - least(abs(la - lb) / 5, 1) AS tract, CASE WHEN abs(la - lb) < 0.5 THEN 'very_close' WHEN abs(la - lb) < 1.0 THEN 'close' ELSE 'differs' END AS closeness FROM rd""",
    "similarity length_cm tract",
)
def formant_profile(spark, t):
    from ..operators.features import tract_length

    long = tracks(t).select("g", F.explode(F.array(*[F.struct(F.lit(f).alias("formant"), F.col(f).alias("x")) for f in R.FORMANTS])).alias("e")).select("g", "e.*")
    means = A.plain_stats(long, ["g", "formant"]).select("g", "formant", "mean")
    profile = M.tracked_profile(means.withColumnRenamed("g", "pair_id"), means.select((F.col("g") - 1).alias("pair_id"), "formant", "mean"), ["pair_id"])
    wide = means.groupBy("g").pivot("formant", list(R.FORMANTS)).agg(F.first("mean"))
    length = wide.select(F.col("g").alias("pair_id"), tract_length(F.col("F3"), F.col("F4")).alias("la"))
    j = profile.join(length, "pair_id").join(length.select((F.col("pair_id") - 1).alias("pair_id"), F.col("la").alias("lb")), "pair_id")
    return j.select("pair_id", "similarity", F.col("la").alias("length_cm"), M.tract_similarity(F.col("la"), F.col("lb")).alias("tract"), R.tract_length_closeness(F.col("la"), F.col("lb")).alias("closeness"))


def constraint_sql() -> str:
    """The cascade as SQL, one subquery for each step, from the same fixed tables."""
    from ..operators.ranges import FORMANT_INTERVALS, FORMANT_RANGES

    r = {f: f"r{f[1]}" for f in R.FORMANTS}
    pick = lambda values: "CASE gender WHEN 'female' THEN {female} WHEN 'child' THEN {child} ELSE {male} END".format(**{k: f"{v}.0::DOUBLE" for k, v in values.items()})
    sql = "SELECT *, is_voiced AND energy > 0 AS act, FALSE AS modified FROM tracks"
    for a, b in zip(R.FORMANTS, R.FORMANTS[1:], strict=False):
        sql = f"SELECT *, coalesce(act AND {a} > 0 AND {b} > 0 AND {b} <= {a}, FALSE) AS bad FROM ({sql})"
        sql = f"SELECT * REPLACE (CASE WHEN bad AND {r[a]} < {r[b]} THEN {b} - 100 ELSE {a} END AS {a}, CASE WHEN bad AND {r[a]} >= {r[b]} THEN {a} + 100 ELSE {b} END AS {b}, CASE WHEN bad AND {r[a]} < {r[b]} THEN {r[a]} * 0.7 ELSE {r[a]} END AS {r[a]}, CASE WHEN bad AND {r[a]} >= {r[b]} THEN {r[b]} * 0.7 ELSE {r[b]} END AS {r[b]}, modified OR bad AS modified) FROM ({sql})"
        sql = f"SELECT * EXCLUDE (bad) FROM ({sql})"
    for f in R.FORMANTS:
        lo, hi = (pick({g: v[f][i] for g, v in FORMANT_RANGES.items()}) for i in (0, 1))
        sql = f"SELECT *, coalesce(act AND {f} > 0 AND {f} < ({lo}), FALSE) AS low, coalesce(act AND {f} > 0 AND {f} > ({hi}), FALSE) AS high FROM ({sql})"
        sql = f"SELECT * REPLACE (CASE WHEN low THEN ({lo}) WHEN high THEN ({hi}) ELSE {f} END AS {f}, CASE WHEN low THEN {r[f]} * (1 - 0.5 * least(1.0, (({lo}) - {f}) / 100)) WHEN high THEN {r[f]} * (1 - 0.5 * least(1.0, ({f} - ({hi})) / 200)) ELSE {r[f]} END AS {r[f]}, modified OR low OR high AS modified) FROM ({sql})"
        sql = f"SELECT * EXCLUDE (low, high) FROM ({sql})"
    sql = f"SELECT *, CASE WHEN act AND F2 / F1 < 1.3 THEN 0.6 WHEN act AND F2 / F1 > 4.5 THEN 0.7 ELSE 1.0 END AS factor FROM ({sql})"
    sql = f"SELECT * REPLACE (CASE WHEN modified THEN greatest(0.1, r1 * factor) ELSE r1 * factor END AS r1, CASE WHEN modified THEN greatest(0.1, r2 * factor) ELSE r2 * factor END AS r2, CASE WHEN modified THEN greatest(0.1, r3) ELSE r3 END AS r3, CASE WHEN modified THEN greatest(0.1, r4) ELSE r4 END AS r4) FROM ({sql})"
    out = []
    for name, d in (("F2-F1", "F2 - F1"), ("F3-F2", "F3 - F2"), ("F4-F3", "F4 - F3")):
        lo, hi = (pick({g: v[name][i] for g, v in FORMANT_INTERVALS.items()}) for i in (0, 1))
        out.append(f"({d} < ({lo}) OR {d} > ({hi}))")
    odd = f"coalesce(formant_count >= 3 AND F1 > 0 AND F2 > 0 AND F3 > 0 AND ({out[0]} OR {out[1]} OR (F4 > 0 AND {out[2]})), FALSE)"
    return f"WITH {TRACKS}, o AS (SELECT *, {odd} AS odd FROM ({sql})) SELECT k, t, F1, F2, F3, F4, " + ", ".join(f"CASE WHEN odd THEN r{i} * 0.8 ELSE r{i} END AS r{i}" for i in (1, 2, 3, 4)) + ", modified, odd AS odd_intervals FROM o"


@query(constraint_sql(), "F1 F2 F3 F4 r1 r2 r3 r4")
def constraint_cascade(spark, t):
    out = R.enforce_constraints(tracks(t))
    return out.select("k", "t", *R.FORMANTS, *[F.col(f"F{i}_reliability").alias(f"r{i}") for i in (1, 2, 3, 4)], "modified", "odd_intervals")


@query(
    f"""WITH {TRACKS}, s AS (SELECT g, count(*) AS n, stddev_pop(F1) / avg(F1) AS f1_cv, stddev_pop(F2) / avg(F2) AS f2_cv, stddev_pop(F3) / avg(F3) AS f3_cv, avg(F2 / F1) AS mean_f2_f1, avg(F3 / F2) AS mean_f3_f2 FROM tracks WHERE is_voiced AND F1 > 0 AND F2 > 0 AND F3 > 0 GROUP BY g),
u AS (SELECT *, ((f1_cv < 0.10)::INT + (f2_cv < 0.08)::INT + (f3_cv < 0.04)::INT) / 3.0::DOUBLE AS stability_score, (mean_f2_f1 < 1.2 OR mean_f2_f1 > 5.0) AS o1, (mean_f3_f2 < 1.1 OR mean_f3_f2 > 3.0) AS o2 FROM s)
SELECT g, n, stability_score, (o1::INT + o2::INT) / 2.0::DOUBLE AS abnormality_score, n >= 10 AND (stability_score > 0.7 OR (o1::INT + o2::INT) / 2.0 > 0.5) AS is_manipulated,
CASE WHEN n < 10 THEN 'insufficient_data' WHEN stability_score > 0.7 THEN 'synthetic_voice' WHEN o1 AND NOT o2 THEN 'formant_shift_f1f2' WHEN o2 AND NOT o1 THEN 'formant_shift_f2f3' WHEN o1 AND o2 THEN 'complete_formant_shift' ELSE 'unknown' END AS type FROM u""",
    "stability_score abnormality_score",
)
def formant_manipulation(spark, t):
    return R.formant_manipulation(tracks(t), ["g"]).select("g", "n", "stability_score", "abnormality_score", "is_manipulated", "type")


@query(
    f"WITH {SIMS}, {WSQL}, s AS ({SUMMARY}) SELECT metric, '| ' || metric || ' | ' || format('{{:.4f}}', median) || ' | ' || n || ' | ' || n_high || ' |' AS line FROM (SELECT metric, median(score) AS median, count(*) AS n, count(*) FILTER (score > 0.9) AS n_high FROM sims GROUP BY metric)",
)
def markdown_rows(spark, t):
    s = A.metric_summary(sims(t), ["metric"])
    return s.select("metric", F.format_string("| %s | %.4f | %d | %d |", F.col("metric"), F.col("median"), F.col("n"), F.col("n_high")).alias("line"))


@query(
    f"""WITH {SIMS}, s AS ({SUMMARY}), r AS (SELECT pair_id, metric, '<tr class="' || CASE WHEN max - min < 0.1 THEN 'success' WHEN max - min < 0.2 THEN 'info' ELSE 'warning' END || '"><td>' || metric || '</td><td>' || format('{{:.1f}}%', median * 100) || '</td><td>' || format('{{:.1f}}%', min * 100) || ' - ' || format('{{:.1f}}%', max * 100) || '</td><td>' || n_high || '/' || n || '</td></tr>' AS r FROM s),
c AS (SELECT pair_id, avg(median) AS f, stddev_pop(median) AS k FROM s GROUP BY pair_id),
d AS (SELECT *, '<div class="' || CASE WHEN f >= 0.88 THEN 'success' WHEN f >= 0.7 THEN 'info' ELSE 'warning' END || '">' AS box FROM c)
SELECT d.pair_id, '<html><body><h1>VM-20240102030405</h1><section id="objects"><ul><li>a' || d.pair_id || '.wav</li><li>b.wav</li></ul></section><section id="authenticity">'
|| CASE WHEN d.pair_id % 2 = 0 THEN '<div class="warning">pitch_shift</div>' ELSE '<div class="success">authentic</div>' END || '</section><section id="results"><table>' || string_agg(r, '' ORDER BY metric) || '</table><p>consistency: '
|| CASE WHEN k < 0.1 THEN 'high' WHEN k < 0.15 THEN 'medium' ELSE 'low' END || '</p></section><section id="score">' || box || format('{{:.1f}}%', f * 100) || '</div></section><section id="verdict">' || box || 'code</div><ul><li>a</li><li>b</li></ul></section>'
|| CASE WHEN d.pair_id % 3 = 0 THEN '<section id="images"><ul><li>spectrum.png</li></ul></section>' ELSE '' END || '</body></html>' AS html
FROM d JOIN r ON d.pair_id = r.pair_id GROUP BY d.pair_id, f, k, box""",
)
def html_report(spark, t):
    s = A.metric_summary(sims(t), ["pair_id", "metric"]).withColumns({"ci_lo": F.col("min"), "ci_hi": F.col("max")})
    cases = s.groupBy("pair_id").agg(F.avg("median").alias("final_score"), F.stddev_pop("median").alias("consistency"))
    names = F.array(F.concat(F.lit("a"), F.col("pair_id").cast("string"), F.lit(".wav")), F.lit("b.wav"))
    cases = cases.withColumns({
        "case_ts": F.lit("2024-01-02 03:04:05").cast("timestamp"), "verdict_code": F.lit("code"), "warning_codes": F.array(F.lit("a"), F.lit("b")), "objects": names,
        "modification": F.when(F.col("pair_id") % 2 == 0, "pitch_shift"), "images": F.when(F.col("pair_id") % 3 == 0, F.array(F.lit("spectrum.png"))).otherwise(F.array().cast("array<string>")),
    })
    return sinks.html_reports(cases, s)
