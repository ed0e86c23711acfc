"""Queries over whole recordings: a user is a recording, its events are frames, samples or spectral bins.

Frames: t is the event's number, ts = t / 100 s, pitch 0 for errors. Spectra: 16 events in a row are the bins of one
frame, 500 Hz apart. The SQL parts are tables that later parts and queries join.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine as cosine_of
from ..operators import aggregates as A
from ..operators import features as X
from ..operators import metrics as M
from ..operators import ranges as G
from ..operators import recordings as C
from ..operators import rules as R
from ..operators import selection as L
from ..operators import series as S
from ..operators import signal as K
from ..sources import audio, sinks
from .frames import GRADIENT, RUNS
from .registry import query

FRAMES = """f AS (SELECT user_id AS rec, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_type, value,
    CASE WHEN event_type = 'error' THEN 0.0 ELSE value END AS pitch_hz, (event_id % 10) / 10.0::DOUBLE AS pitch_mag,
    event_type <> 'error' AS voiced, (event_id % 7) / 6.0::DOUBLE AS voiced_prob, value / 100.0::DOUBLE AS energy FROM events)"""
V = "WINDOW w AS (PARTITION BY rec ORDER BY t)"
SPECTRUM = "sp AS (SELECT rec, t // 16 AS frame, CAST(t % 16 AS INTEGER) AS bin, (t % 16) * 500.0::DOUBLE AS freq_hz, value AS mag FROM f)"


def numbered(t):
    e = t("events").select(F.col("user_id").alias("rec"), "event_id", "ts", "event_type", "value")
    return e.withColumn("t", F.row_number().over(Window.partitionBy("rec").orderBy("ts", "event_id")).cast("long") - 1).drop("ts")


def frames(t):
    e = F.col("event_id")
    return numbered(t).withColumns({
        "ts": F.col("t") * F.lit(0.01), "pitch_hz": F.when(F.col("event_type") == "error", 0.0).otherwise(F.col("value")), "pitch_mag": (e % 10) / F.lit(10.0),
        "voiced": F.col("event_type") != "error", "voiced_prob": (e % 7) / F.lit(6.0), "energy": F.col("value") / F.lit(100.0),
    })


def spectra(t):
    b = (F.col("t") % 16).cast("int")
    return numbered(t).select("rec", F.floor(F.col("t") / 16).cast("long").alias("frame"), b.alias("bin"), (b * F.lit(500.0)).alias("freq_hz"), F.col("value").alias("mag"))


@query(f"WITH {FRAMES} SELECT rec, count(*) AS n, avg(pitch_hz) AS mean FROM f WHERE voiced AND voiced_prob > 0.7 GROUP BY rec", "mean")
def reliable_pitch(spark, t):
    return S.reliable_pitch(frames(t)).groupBy("rec").agg(F.count("*").alias("n"), F.avg("pitch_hz").alias("mean"))


@query(f"WITH {FRAMES} SELECT rec, count(*) AS n, min(pitch_hz) AS least, min(pitch_mag) AS faintest FROM f WHERE pitch_hz > 0 AND pitch_mag > 0 GROUP BY rec", "least faintest")
def voiced_frames(spark, t):
    return S.voiced(frames(t)).groupBy("rec").agg(F.count("*").alias("n"), F.min("pitch_hz").alias("least"), F.min("pitch_mag").alias("faintest"))


PITCH = f"""k AS (SELECT * FROM f WHERE voiced AND voiced_prob > 0.7 AND pitch_hz > 0),
k1 AS (SELECT *, {GRADIENT.format(x='pitch_hz')} AS d, lag(pitch_hz) OVER w - pitch_hz AS fall FROM k {V}), k2 AS (SELECT *, {GRADIENT.format(x='d')} AS a FROM k1 {V}),
kr AS (SELECT *, max(pitch_hz) OVER (PARTITION BY rec) - min(pitch_hz) OVER (PARTITION BY rec) AS r FROM k2),
pg AS (SELECT rec, avg(pitch_hz) AS mean, median(pitch_hz) AS median, stddev_pop(pitch_hz) AS std, min(pitch_hz) AS min, max(pitch_hz) AS max, max(pitch_hz) - min(pitch_hz) AS range, count(*) AS n,
    avg(abs(d)) AS mean_derivative, stddev_pop(d) AS derivative_std, avg(abs(a)) AS mean_acceleration, stddev_pop(a) AS acceleration_std,
    CASE WHEN count(*) < 10 THEN 0 ELSE coalesce(avg(fall) FILTER (fall > 0.1 * r), 0) END AS mean_drop, CASE WHEN count(*) < 10 THEN 0 ELSE coalesce(avg(fall) FILTER (fall > 0.1 * r) / 0.02, 0) END AS drop_rate,
    CASE WHEN count(*) < 10 THEN 0 ELSE count(*) FILTER (fall > 0.1 * r) / count(*)::DOUBLE END AS frequency
    FROM kr GROUP BY rec),
pf AS (SELECT r.rec, """ + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("mean", "median", "std", "min", "max", "range", "n", "mean_derivative", "derivative_std", "mean_acceleration", "acceleration_std", "mean_drop", "drop_rate", "frequency")) + """,
    CASE WHEN mean BETWEEN 50 AND 180 THEN 'male' WHEN mean BETWEEN 150 AND 300 THEN 'female' ELSE 'unknown' END AS gender,
    CASE WHEN mean IS NULL THEN 0.5 WHEN mean < 50 THEN 0.9 WHEN mean <= 180 THEN 1.0 WHEN mean <= 300 THEN 0.0 ELSE 0.1 END AS male,
    CASE WHEN mean IS NULL THEN 0.5 WHEN mean < 50 THEN 0.1 WHEN mean <= 180 THEN 0.0 WHEN mean <= 300 THEN 1.0 ELSE 0.9 END AS female
    FROM (SELECT DISTINCT rec FROM f) AS r LEFT JOIN pg ON r.rec = pg.rec)"""


@query(f"WITH {FRAMES}, {PITCH} SELECT * FROM pf", "mean median std min max range mean_derivative derivative_std mean_acceleration acceleration_std mean_drop drop_rate frequency male female")
def pitch_features(spark, t):
    return X.pitch_features(frames(t), ["rec"], ["t"], 0.01)


FIVE = "OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
PERTURBATION = f"""v AS (SELECT *, 1.0 / pitch_hz AS p, pitch_mag AS a FROM f WHERE pitch_hz > 0 AND pitch_mag > 0),
v1 AS (SELECT *, abs(p - lag(p) OVER w) AS dp, abs(a - lag(a) OVER w) AS da, abs(20 * log10(a) - 20 * log10(lag(a) OVER w)) AS db, avg(p) {FIVE} AS mp, avg(a) {FIVE} AS ma, count(*) {FIVE} AS c FROM v {V}),
v2 AS (SELECT rec, count(*) >= 5 AS ok, 100 * avg(dp) / avg(p) AS jl, 1000 * avg(dp) AS ja, 100 * avg(abs(p - mp)) FILTER (c = 5) / avg(p) AS jq, 100 * stddev_pop(dp) / avg(p) AS jv,
    100 * avg(da) / avg(a) AS sl, avg(db) AS sd, 100 * avg(abs(a - ma)) FILTER (c = 5) / avg(a) AS sq, 100 * stddev_pop(da) / avg(a) AS sv FROM v1 GROUP BY rec),
jf AS (SELECT r.rec, """ + ", ".join(f"CASE WHEN ok THEN coalesce({a}, 0) ELSE 0 END AS {b}" for a, b in zip(("jl", "ja", "jq", "jv", "sl", "sd", "sq", "sv"), (
    "jitter_local", "jitter_absolute", "jitter_ppq5", "jitter_variability", "shimmer_local", "shimmer_db", "shimmer_apq5", "shimmer_variability"), strict=True)) + " FROM (SELECT DISTINCT rec FROM f) AS r LEFT JOIN v2 ON r.rec = v2.rec)"
EIGHT = "jitter_local jitter_absolute jitter_ppq5 jitter_variability shimmer_local shimmer_db shimmer_apq5 shimmer_variability"


@query(f"WITH {FRAMES}, {PERTURBATION} SELECT * FROM jf", EIGHT)
def perturbation_features(spark, t):
    return X.jitter_shimmer(frames(t), ["rec"], ["t"])


BANDS = """be AS (SELECT rec, frame, avg(mag) AS "all", coalesce(sum(freq_hz * mag) / nullif(sum(mag), 0), 0) AS centroid,
    coalesce(avg(mag) FILTER (freq_hz BETWEEN 250 AND 450), 0) AS nasal1, coalesce(avg(mag) FILTER (freq_hz BETWEEN 1000 AND 1200), 0) AS nasal2,
    coalesce(avg(mag) FILTER (freq_hz BETWEEN 700 AND 900), 0) AS antires, coalesce(avg(mag) FILTER (freq_hz BETWEEN 1000 AND 2000), 0) AS f_v,
    coalesce(avg(mag) FILTER (freq_hz BETWEEN 2000 AND 4000), 0) AS s_z, coalesce(avg(mag) FILTER (freq_hz BETWEEN 4000 AND 8000), 0) AS sh_zh FROM sp GROUP BY rec, frame)"""


@query(f"WITH {FRAMES}, {SPECTRUM}, {BANDS} SELECT * FROM be", '"all" centroid nasal1 nasal2 antires f_v s_z sh_zh')
def band_energies(spark, t):
    return X.band_energies(spectra(t), ["rec", "frame"])


FRICATIVE = """fa AS (SELECT *, f_v > 0.2 * max(f_v) OVER (PARTITION BY rec) AS o1, s_z > 0.2 * max(s_z) OVER (PARTITION BY rec) AS o2, sh_zh > 0.2 * max(sh_zh) OVER (PARTITION BY rec) AS o3,
    CASE WHEN "all" > 0 THEN f_v / "all" ELSE 0 END AS p1, CASE WHEN "all" > 0 THEN s_z / "all" ELSE 0 END AS p2, CASE WHEN "all" > 0 THEN sh_zh / "all" ELSE 0 END AS p3 FROM be),
ff AS (SELECT rec, coalesce(avg(f_v) FILTER (o1), 0) AS f_v_energy, coalesce(avg(p1) FILTER (o1), 0) AS f_v_ratio, coalesce(stddev_pop(p1) FILTER (o1), 0) AS f_v_ratio_std, count(*) FILTER (o1) AS f_v_frames,
    coalesce(avg(s_z) FILTER (o2), 0) AS s_z_energy, coalesce(avg(p2) FILTER (o2), 0) AS s_z_ratio, coalesce(stddev_pop(p2) FILTER (o2), 0) AS s_z_ratio_std, count(*) FILTER (o2) AS s_z_frames,
    coalesce(avg(sh_zh) FILTER (o3), 0) AS sh_zh_energy, coalesce(avg(p3) FILTER (o3), 0) AS sh_zh_ratio, coalesce(stddev_pop(p3) FILTER (o3), 0) AS sh_zh_ratio_std, count(*) FILTER (o3) AS sh_zh_frames,
    coalesce(avg(centroid) FILTER (o1 OR o2 OR o3), 0) AS centroid_mean, coalesce(stddev_pop(centroid) FILTER (o1 OR o2 OR o3), 0) AS centroid_std, count(*) FILTER (o1 OR o2 OR o3) / count(*) AS overall_ratio FROM fa GROUP BY rec)"""


@query(f"WITH {FRAMES}, {SPECTRUM}, {BANDS}, {FRICATIVE} SELECT * FROM ff", " ".join(f"{k}_{x}" for k in ("f_v", "s_z", "sh_zh") for x in ("energy", "ratio", "ratio_std")) + " centroid_mean centroid_std overall_ratio")
def fricative_features(spark, t):
    return X.fricative_features(X.band_energies(spectra(t), ["rec", "frame"]), ["rec"])


NASAL = """na AS (SELECT *, CASE WHEN "all" > 0 THEN nasal1 / "all" ELSE 0 END AS r1, CASE WHEN "all" > 0 THEN nasal2 / "all" ELSE 0 END AS r2, CASE WHEN "all" > 0 THEN antires / "all" ELSE 0 END AS dip FROM be),
nb AS (SELECT *, r1 > 1.5 * avg(r1) OVER (PARTITION BY rec) AND dip < 0.7 * avg(dip) OVER (PARTITION BY rec) AS nasal FROM na),
nf AS (SELECT rec, avg(nasal::INT) AS presence, coalesce(avg(r1) FILTER (nasal), avg(r1)) AS mean_r1, coalesce(avg(r2) FILTER (nasal), avg(r2)) AS mean_r2, coalesce(avg(dip) FILTER (nasal), avg(dip)) AS mean_anti,
    coalesce(avg(r1 / (dip + 1e-10)) FILTER (nasal), 0) AS quality, coalesce(avg(r1 / (r2 + 1e-10)) FILTER (nasal), 0) AS resonance_ratio, stddev_pop(r1) AS std_r1, count(*) AS frames FROM nb GROUP BY rec)"""


@query(f"WITH {FRAMES}, {SPECTRUM}, {BANDS}, {NASAL} SELECT * FROM nf", "presence mean_r1 mean_r2 mean_anti quality resonance_ratio std_r1")
def nasal_features(spark, t):
    return X.nasal_features(X.band_energies(spectra(t), ["rec", "frame"]), ["rec"])


SHAPE = """sa AS (SELECT *, sum(mag) OVER (PARTITION BY rec, frame ORDER BY bin) AS run, sum(mag) OVER (PARTITION BY rec, frame) AS al FROM sp),
sh AS (SELECT rec, frame, sum(freq_hz * mag) / nullif(sum(mag), 0) AS centroid, exp(avg(ln(greatest(mag * mag, 1e-10)))) / avg(greatest(mag * mag, 1e-10)) AS flatness,
    min(freq_hz) FILTER (run >= 0.85 * al) AS rolloff, CASE WHEN count(*) > 1 THEN regr_slope(mag, freq_hz) END AS slope FROM sa GROUP BY rec, frame)"""


@query(f"WITH {FRAMES}, {SPECTRUM}, {SHAPE} SELECT * FROM sh", "centroid flatness rolloff slope")
def spectral_shape(spark, t):
    return X.spectral_shape(spectra(t), ["rec", "frame"])


MEL = "ml AS (SELECT rec, event_id % 128 AS bin, value / 10 AS db FROM f), ct AS (SELECT rec, event_id % 7 AS band, avg(value / 5) AS c FROM f GROUP BY ALL)"


@query(
    f"""WITH {FRAMES}, {SPECTRUM}, {SHAPE}, {MEL}, b AS (SELECT rec, bin, avg(db) AS m FROM ml GROUP BY rec, bin), m AS (SELECT rec, avg(m) FILTER (bin BETWEEN 0 AND 42) AS low_energy, avg(m) FILTER (bin BETWEEN 43 AND 85) AS mid_energy,
    avg(m) FILTER (bin BETWEEN 86 AND 127) AS high_energy, sum(m) FILTER (bin >= 86) / nullif(sum(m), 0) AS brightness FROM b GROUP BY rec),
s AS (SELECT rec, avg(rolloff) AS rolloff_mean, stddev_pop(rolloff) AS rolloff_std, avg(centroid) AS centroid_mean, stddev_pop(centroid) AS centroid_std FROM sh GROUP BY rec)
SELECT m.*, low_energy / (high_energy + 1e-10) AS low_to_high, mid_energy / (high_energy + 1e-10) AS mid_to_high, low_energy / (mid_energy + high_energy + 1e-10) AS warmth, s.* EXCLUDE (rec), x.* EXCLUDE (rec)
FROM m JOIN s ON m.rec = s.rec JOIN (SELECT rec, arg_min(c, band) AS first_contrast, arg_max(c, band) AS last_contrast, avg(c) AS richness FROM ct GROUP BY rec) AS x ON m.rec = x.rec""",
    "first_contrast last_contrast richness low_energy mid_energy high_energy brightness low_to_high mid_to_high warmth rolloff_mean rolloff_std centroid_mean centroid_std",
)
def perceptual_features(spark, t):
    mel = numbered(t).select("rec", (F.col("event_id") % 128).alias("bin"), (F.col("value") / 10).alias("db"))
    contrast = numbered(t).select("rec", (F.col("event_id") % 7).alias("band"), (F.col("value") / 5).alias("contrast"))
    got = X.perceptual_features(mel, X.spectral_shape(spectra(t), ["rec", "frame"]), ["rec"], contrast)
    return got.withColumns({"first_contrast": F.element_at("contrast_mean", 1), "last_contrast": F.element_at("contrast_mean", -1)}).drop("contrast_mean")


QUALITY = """qs AS (SELECT rec, least(1, abs(avg(slope)) * 10) AS steep FROM sh GROUP BY rec), qe AS (SELECT rec, avg(nasal1) AS nasal, avg("all") AS al, count(*) AS k FROM be GROUP BY rec),
qj AS (SELECT rec, least(1, jitter_local / 1.04) AS j, least(1, shimmer_local / 3.81) AS h FROM jf),
qf AS (SELECT qs.rec, 0.5 * coalesce(j, 0) + 0.5 * coalesce(h, 0) AS breathiness,
    CASE WHEN mean > 0 THEN 0.6 * CASE WHEN mean < 100 THEN 1 ELSE greatest(0, 1 - (mean - 100) / 50) END + 0.4 * least(1, std / 20) ELSE 0 END AS creakiness,
    0.5 * CASE WHEN mean > 0 THEN CASE WHEN gender = 'male' THEN greatest(0, least(1, (mean - 100) / 80)) ELSE greatest(0, least(1, (mean - 180) / 120)) END ELSE 0 END + 0.5 * coalesce(steep, 0) AS tenseness,
    least(1, CASE WHEN al > 0 THEN 3 * nasal / al ELSE 0 END) AS nasality, greatest(0, least(1, coalesce(n, 0) / k::DOUBLE)) AS voicing_degree,
    CASE WHEN mean > 0 THEN 0.3 * (1 - coalesce(j, 0)) + 0.3 * (1 - coalesce(h, 0)) + 0.4 * (1 - least(1, std / (0.2 * mean))) ELSE 0 END AS stability
    FROM qs JOIN qe ON qs.rec = qe.rec LEFT JOIN pf ON qs.rec = pf.rec LEFT JOIN qj ON qs.rec = qj.rec)"""


@query(f"WITH {FRAMES}, {SPECTRUM}, {BANDS}, {SHAPE}, {PITCH}, {PERTURBATION}, {QUALITY} SELECT * FROM qf", "breathiness creakiness tenseness nasality voicing_degree stability")
def voice_quality(spark, t):
    sp, f = spectra(t), frames(t)
    return X.voice_quality(X.spectral_shape(sp, ["rec", "frame"]), X.pitch_features(f, ["rec"], ["t"], 0.01), X.jitter_shimmer(f, ["rec"], ["t"]), X.band_energies(sp, ["rec", "frame"]), ["rec"])


_PARTS = """pf.mean pf.median pf.std pf.mean_derivative pf.mean_acceleration jf.jitter_local jf.jitter_absolute jf.jitter_ppq5 jf.shimmer_local jf.shimmer_db jf.shimmer_apq5
ff.s_z_ratio ff.sh_zh_ratio ff.centroid_mean nf.mean_r1 nf.mean_r2 nf.resonance_ratio qf.breathiness qf.creakiness qf.tenseness qf.nasality qf.stability""".split()


@query(
    f"""WITH {FRAMES}, {SPECTRUM}, {BANDS}, {SHAPE}, {PITCH}, {PERTURBATION}, {FRICATIVE}, {NASAL}, {QUALITY}, r AS (SELECT DISTINCT rec FROM f),
bv AS (SELECT r.rec, [{', '.join(f'coalesce({c}, 0)' for c in _PARTS)}] AS v FROM r LEFT JOIN pf ON r.rec = pf.rec LEFT JOIN jf ON r.rec = jf.rec LEFT JOIN ff ON r.rec = ff.rec LEFT JOIN nf ON r.rec = nf.rec LEFT JOIN qf ON r.rec = qf.rec)
SELECT rec, unnest(range(0, {len(_PARTS)}))::INTEGER AS pos, unnest(v)::DOUBLE AS x FROM bv""",
    "x",
)
def biometric_vector(spark, t):
    """All feature groups of each recording, then its 22 numbers."""
    every = C.all_features(frames(t), spectra(t).withColumnRenamed("frame", "t"), ["rec"])
    return C.biometric_vector(every, ["rec"]).select("rec", F.posexplode("v").alias("pos", "x"))


CLOSE = """sp AS (SELECT rec, t // 16 AS frame, CAST(t % 16 AS INTEGER) AS bin, t % 16 * 100.0::DOUBLE + CASE WHEN t % 16 > 11 THEN 2000 ELSE 0 END AS freq_hz, value AS mag FROM f)"""


def close_spectra(t):
    """Bins 100 Hz apart, the last four above 3 kHz, so that nasal and fricative bands all have some."""
    f = F.col("bin") * F.lit(100.0) + F.when(F.col("bin") > 11, 2000.0).otherwise(0.0)
    return spectra(t).withColumn("freq_hz", f)


def _cosine(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"


@query(
    f"""WITH {FRAMES}, {CLOSE}, {BANDS}, {SHAPE}, {FRICATIVE}, {NASAL}, q AS (SELECT be.*, sh.flatness AS fl, CASE WHEN s_z > 0 THEN sh_zh / s_z ELSE 0 END AS r3,
    CASE WHEN "all" > 0 THEN nasal1 / "all" ELSE 0 END AS r1, CASE WHEN "all" > 0 THEN nasal2 / "all" ELSE 0 END AS r2 FROM be JOIN sh ON be.rec = sh.rec AND be.frame = sh.frame),
u AS (SELECT rec, [avg(centroid), stddev_pop(centroid), avg(fl), stddev_pop(fl), avg(s_z), avg(sh_zh), avg(r3), stddev_pop(r3)] AS fv,
    [avg(nasal1), stddev_pop(nasal1), avg(nasal2), stddev_pop(nasal2), avg(r1), stddev_pop(r1), avg(r2), stddev_pop(r2)] AS nv FROM q GROUP BY rec),
p AS (SELECT ff.rec, s_z_ratio AS a, sh_zh_ratio AS b, centroid_mean AS c, mean_r1 AS d, resonance_ratio AS e, quality AS g, fv, nv FROM ff JOIN nf ON ff.rec = nf.rec JOIN u ON ff.rec = u.rec)
SELECT x.rec, {_cosine('x.fv', 'y.fv')} AS fricative_vector, {_cosine('x.nv', 'y.nv')} AS nasal_vector,
    0.35 * (1 - least(1, 5 * abs(x.a - y.a))) + 0.35 * (1 - least(1, 5 * abs(x.b - y.b))) + 0.3 * (1 - least(1, abs(x.c - y.c) / 1000)) AS fricative,
    0.3 * (1 - least(1, 5 * abs(x.d - y.d))) + 0.5 * (1 - least(1, 2 * abs(x.e - y.e))) + 0.2 * (1 - least(1, 2 * abs(x.g - y.g))) AS nasal FROM p AS x JOIN p AS y ON y.rec = x.rec + 1""",
    "fricative_vector nasal_vector fricative nasal",
)
def fricative_nasal_similarity(spark, t):
    """Neighbouring recordings by their fricative and nasal vectors and features."""
    sp, by = close_spectra(t), ["rec"]
    energies = X.band_energies(sp, ["rec", "frame"])
    fv = X.fricative_vector(energies, X.spectral_shape(sp, ["rec", "frame"]), by, "frame").withColumnRenamed("v", "fv")
    every = fv.join(X.nasal_vector(energies, by).withColumnRenamed("v", "nv"), by).join(X.fricative_features(energies, by), by).join(X.nasal_features(energies, by), by)
    parts = ("fv", "nv", "s_z_ratio", "sh_zh_ratio", "centroid_mean", "mean_r1", "resonance_ratio", "quality")
    a = every.select("rec", *[F.col(c).alias(f"a_{c}") for c in parts])
    pair = a.join(every.select((F.col("rec") - 1).alias("rec"), *[F.col(c).alias(f"b_{c}") for c in parts]), "rec")
    d = {c: F.col(f"a_{c}") - F.col(f"b_{c}") for c in parts[2:]}
    cosine = lambda c: F.coalesce(cosine_of(F.col(f"a_{c}"), F.col(f"b_{c}")), F.lit(0.0))
    return pair.select(
        "rec", cosine("fv").alias("fricative_vector"), cosine("nv").alias("nasal_vector"), M.fricative_similarity(d["sh_zh_ratio"], d["s_z_ratio"], d["centroid_mean"]).alias("fricative"),
        M.nasal_similarity(d["mean_r1"], d["resonance_ratio"], d["quality"]).alias("nasal"),
    )


@query(f"WITH {FRAMES}, {CLOSE}, {BANDS}, {NASAL} SELECT * REPLACE (least(quality, 1000) AS quality, least(resonance_ratio, 1000) AS resonance_ratio) FROM nf", "presence mean_r1 mean_r2 mean_anti quality resonance_ratio std_r1")
def nasal_frames(spark, t):
    """Nasal features where every nasal band has bins, so that there are nasal frames. A last frame with fewer bins has
    parts over nothing: what such quotients give is cut off."""
    got = X.nasal_features(X.band_energies(close_spectra(t), ["rec", "frame"]), ["rec"])
    return got.withColumns({c: F.least(F.col(c), F.lit(1000.0)) for c in ("quality", "resonance_ratio")})


FORMANTS = "fm AS (SELECT rec, 'F' || (t % 4 + 1) AS formant, value * 10 AS hz FROM f)"


def formants(t):
    return numbered(t).select("rec", F.concat(F.lit("F"), (F.col("t") % 4 + 1).cast("string")).alias("formant"), (F.col("value") * 10).alias("hz"))


@query(
    f"""WITH {FRAMES}, {FORMANTS}, g AS (SELECT rec, formant, count(*) AS n, avg(hz) AS a, stddev_pop(hz) AS b, max(hz) - min(hz) AS c FROM fm WHERE hz > 0 GROUP BY rec, formant),
r AS (SELECT DISTINCT rec, formant, pos FROM (SELECT rec FROM f), (SELECT unnest(['F1', 'F2', 'F3', 'F4']) AS formant, unnest([0, 1, 2, 3]) AS pos))
SELECT r.rec, r.pos * 3 + i AS pos, CASE WHEN n > 2 THEN [a, b, c][i + 1] ELSE 0 END AS x FROM r CROSS JOIN (SELECT unnest([0, 1, 2]) AS i) LEFT JOIN g ON r.rec = g.rec AND r.formant = g.formant""",
    "x",
)
def formant_dynamics(spark, t):
    return X.formant_dynamics(formants(t), ["rec"]).select("rec", F.posexplode("v").alias("pos", "x"))


@query(
    f"""WITH {FRAMES}, {FORMANTS}, g AS (SELECT rec, formant, avg(hz) AS mean FROM fm WHERE hz > 0 GROUP BY rec, formant), l AS (SELECT rec, 17200.0 / mean AS l FROM g WHERE formant IN ('F3', 'F4'))
SELECT rec, avg(l) AS length_cm, stddev_pop(l) AS std_cm, count(*) AS formants, CASE WHEN count(*) > 1 THEN greatest(0, 1 - stddev_pop(l) / avg(l)) ELSE 0.5 END AS confidence FROM l GROUP BY rec""",
    "length_cm std_cm confidence",
)
def tract_length_tracked(spark, t):
    return X.tracked_tract_length(A.plain_stats(formants(t), ["rec", "formant"], "hz"), ["rec"])


@query(
    f"""WITH {FRAMES}, {FORMANTS}, g AS (SELECT rec, formant, count(*) AS n, avg(hz) AS mean FROM fm WHERE hz > 4000 GROUP BY rec, formant),
d AS (SELECT DISTINCT rec, formant FROM (SELECT rec FROM f), (SELECT unnest(['F1', 'F2', 'F3', 'F4']) AS formant))
SELECT d.rec, d.formant, coalesce(n, 0) AS n, coalesce(mean, 0) AS mean FROM d LEFT JOIN g ON d.rec = g.rec AND d.formant = g.formant""",
    "mean",
)
def empty_statistics(spark, t):
    stats = formants(t).where("hz > 4000").groupBy("rec", "formant").agg(F.count("*").alias("n"), F.avg("hz").alias("mean"))
    dim = t("events").select(F.col("user_id").alias("rec")).distinct().select("rec", F.explode(F.array(*[F.lit(f) for f in R.FORMANTS])).alias("formant"))
    return A.filled(stats, dim, ["rec", "formant"])


def _gauss(x: str, mean: float, sd: float) -> str:
    return f"exp(-0.5 * (({x} - {mean}) / {sd}) ^ 2)"


_MIXED = {k: f"0.6 * {_gauss('m', *v)} + 0.4 * {_gauss('o', *v)}" for k, v in {"male": (120.0, 25.0), "female": (210.0, 30.0)}.items()}
_MIXED["child"] = f"0.5 * {_gauss('m', 300.0, 50.0)} + 0.3 * {_gauss('o', 300.0, 50.0)} + 0.2 * CASE WHEN m > 250 THEN 1.0 ELSE 0.0 END"


@query(
    """WITH k AS (SELECT user_id, value FROM events WHERE value > 0), b AS (SELECT user_id, least(19, CAST(floor((value - 50.0) / 22.5) AS INTEGER)) AS bin, count(*) AS c FROM k WHERE value BETWEEN 50 AND 500 GROUP BY ALL),
h AS (SELECT user_id, 50.0 + (bin + 0.5) * 22.5 AS mode FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, bin) AS r FROM b) WHERE r = 1),
s AS (SELECT k.user_id, count(*) AS n, median(value) AS m, coalesce(any_value(mode), median(value)) AS o FROM k LEFT JOIN h ON k.user_id = h.user_id GROUP BY k.user_id),
p AS (SELECT user_id, n, """ + ", ".join(f"CASE WHEN n >= 10 THEN {e} ELSE {d} END AS {k}" for (k, e), d in zip(_MIXED.items(), (0.6, 0.3, 0.1), strict=True)) + """ FROM s)
SELECT user_id, n, """ + ", ".join(f"CASE WHEN male + female + child > 0 THEN {k} / (male + female + child) ELSE {k} END AS {k}" for k in _MIXED) + " FROM p",
    "male female child",
)
def gender_probability(spark, t):
    return X.gender_estimate(t("events").select("user_id", F.col("value").alias("pitch_hz")), ["user_id"])


@query("SELECT event_id, CASE WHEN value > 0 THEN 10 * log10(d * d / (value * value - d * d + 1e-10)) END AS snr_db FROM (SELECT *, value * (event_id % 9) / 10.0 AS d FROM events) WHERE event_id % 9 > 0 AND value > 0", "snr_db")
def frame_snr(spark, t):
    e = t("events").where("event_id % 9 > 0 and value > 0")
    return e.select("event_id", X.frame_snr(F.col("value"), F.col("value"), F.col("value") * (F.col("event_id") % 9) / F.lit(10.0)).alias("snr_db"))


@query(
    f"WITH {FRAMES}, g AS (SELECT DISTINCT rec, i AS seg_no, i * 0.2 AS a, i * 0.2 + 0.3 AS b FROM f, (SELECT unnest([0, 1, 2]) AS i)) SELECT g.rec, seg_no, avg(energy) AS energy, avg(voiced_prob) AS snr_db, count(*) AS frames FROM g JOIN f ON g.rec = f.rec AND t * 0.01 >= a AND t * 0.01 < b GROUP BY g.rec, seg_no",
    "energy snr_db",
)
def segment_energy(spark, t):
    f = frames(t).withColumn("snr_db", F.col("voiced_prob"))
    i = F.explode(F.array(*[F.lit(k) for k in (0, 1, 2)]))
    segments = f.select("rec").distinct().select("rec", i.alias("seg_no")).withColumns({"start_s": F.col("seg_no") * F.lit(0.2), "end_s": F.col("seg_no") * F.lit(0.2) + F.lit(0.3)})
    return X.segment_means(f, segments, ["rec"])


@query(
    RUNS + """, z AS (SELECT f.user_id, f.t, f.value, k.start_s FROM f LEFT JOIN k ON f.user_id = k.user_id AND f.t >= floor(start_s * 10) AND f.t < floor(end_s * 10))
SELECT user_id, count(start_s) AS n, coalesce(sum(value) FILTER (start_s IS NOT NULL), 0) AS total, 100 * (1 - count(start_s) / count(*)::DOUBLE) AS removed_percent FROM z GROUP BY user_id""",
    "total removed_percent",
)
def silence_removed(spark, t):
    from .frames import speech

    ordered = F.array_sort(F.collect_list(F.struct("t", "value")))
    samples = numbered(t).groupBy(F.col("rec").alias("user_id")).agg(F.transform(ordered, lambda x: x["value"]).alias("amp"))
    out = X.silence_removed(samples, S.speech_runs(speech(t), ["user_id"], "s", "speech", 0.15), ["user_id"], 10)
    return out.select("user_id", F.size("kept").cast("long").alias("n"), F.aggregate("kept", F.lit(0.0), lambda a, x: a + x).alias("total"), "removed_percent")


def _over(first: int, last: int) -> str:
    return f"OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN {first} PRECEDING AND {last} FOLLOWING)"


@query(f"WITH {FRAMES}, a AS (SELECT *, (value > 60)::INT AS m FROM f), b AS (SELECT *, min(m) {_over(2, 2)} AS e FROM a), c AS (SELECT *, max(e) {_over(2, 2)} AS o FROM b), d AS (SELECT *, max(o) {_over(5, 4)} AS x FROM c) SELECT rec, t, min(x) {_over(4, 5)} AS m FROM d")
def mask_opened_closed(spark, t):
    return S.opened_closed(numbered(t).select("rec", "t", (F.col("value") > 60).cast("int").alias("m")), ["rec"], ["t"], "m").select("rec", "t", "m")


@query(
    f"""WITH {FRAMES}, {SPECTRUM}, p AS (SELECT rec, frame, arg_max(bin, mag * 1e6 - bin) AS peak_bin, max(mag) AS peak_mag FROM sp GROUP BY rec, frame), j AS (SELECT sp.*, peak_bin, peak_mag, mag <= peak_mag / sqrt(2.0) AS low FROM sp JOIN p ON sp.rec = p.rec AND sp.frame = p.frame)
SELECT rec, frame, peak_bin, coalesce(arg_min(freq_hz, bin) FILTER (low AND bin > peak_bin), max(freq_hz)) - coalesce(arg_max(freq_hz, bin) FILTER (low AND bin < peak_bin), min(freq_hz)) AS bandwidth_hz FROM j GROUP BY rec, frame, peak_bin""",
    "bandwidth_hz",
)
def half_power_bandwidth(spark, t):
    sp = spectra(t)
    peaks = S.argmax_bin(sp, ["rec", "frame"]).select("rec", "frame", F.col("bin").alias("peak_bin"), F.col("mag").alias("peak_mag"))
    return S.half_power_bandwidth(sp, ["rec", "frame"], peaks)


@query(f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM f) SELECT event_id, value * least(1.0, t / greatest(n // 10 - 1, 1)::DOUBLE, (n - 1 - t) / greatest(n // 10 - 1, 1)::DOUBLE) AS x FROM n", "x")
def fade_ramp(spark, t):
    n = F.count("*").over(Window.partitionBy("rec"))
    return numbered(t).select("event_id", (F.col("value") * S.fade_factor(F.col("t"), n, F.floor(n / 10))).alias("x"))


@query(f"WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY rec) AS n FROM f) SELECT event_id, CASE WHEN n > 1 THEN n * 0.03 * t / greatest(n - 1, 1) ELSE 0 END AS ts FROM n", "ts")
def aligned_times(spark, t):
    rows = numbered(t).withColumn("duration_s", F.count("*").over(Window.partitionBy("rec")) * F.lit(0.03))
    return C.aligned_times(rows, ["rec"], "t").select("event_id", "ts")


@query(
    f"""WITH {FRAMES}, g AS (SELECT rec, t * 1.0::DOUBLE AS s, energy, max(t * 1.0::DOUBLE) OVER (PARTITION BY rec) AS e FROM f), w AS (SELECT DISTINCT rec, e, unnest(range(0, CAST(e // 4 AS BIGINT) + 1)) AS k FROM g)
SELECT w.rec, k * 4.0 AS start_s, avg(energy) AS energy FROM w JOIN g ON w.rec = g.rec AND s > k * 4 - 0.0001 AND floor(s / 4) >= k AND s < k * 4 + 8 WHERE k * 4 + 8 <= w.e GROUP BY w.rec, k""",
    "start_s energy",
)
def window_energy(spark, t):
    return C.window_energy(frames(t).withColumn("ts", F.col("t") * F.lit(1.0)), ["rec"], 8.0, 4.0)


@query(
    f"""WITH {FRAMES}, g AS (SELECT rec, t, avg(energy) OVER (PARTITION BY rec ORDER BY t ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS energy, max(t) OVER (PARTITION BY rec) AS e FROM f)
SELECT rec, t * 4.0 AS start_s, energy FROM g WHERE t < floor((e - 8.0) / 4) + 1""",
    "start_s energy",
)
def window_energy_literal(spark, t):
    return C.window_energy(frames(t).withColumn("ts", F.col("t") * F.lit(1.0)), ["rec"], 8.0, 4.0, literal=True)


SEGMENTS = "sg AS (SELECT rec, value AS quality, t * 10.0 AS start_s, t * 10.0 + 30 AS end_s FROM f WHERE t % 3 = 0 AND rec % 4 > 0)"


@query(
    f"""WITH {FRAMES}, {SEGMENTS}, r AS (SELECT rec, count(*) * CASE WHEN rec % 5 = 0 THEN 0.05 WHEN rec % 5 = 1 THEN 0.5 ELSE 10.0 END AS d FROM f GROUP BY rec), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY quality DESC, start_s) AS n FROM sg) WHERE n = 1)
SELECT r.rec, CASE WHEN d <= 5 THEN 'short' WHEN d <= 58 THEN 'whole' WHEN start_s IS NULL THEN 'none' ELSE 'cut' END AS status, CASE WHEN d <= 58 THEN 0 ELSE start_s END AS start_s, CASE WHEN d <= 58 THEN d ELSE end_s END AS end_s, quality FROM r LEFT JOIN b ON r.rec = b.rec""",
    "start_s end_s quality",
)
def voice_segment(spark, t):
    f = numbered(t)
    rec = F.col("rec")
    length = F.when(rec % 5 == 0, 0.05).when(rec % 5 == 1, 0.5).otherwise(10.0)
    recordings = f.groupBy("rec").agg(F.count("*").alias("n")).select("rec", (F.col("n") * length).alias("duration_s"))
    segments = f.where((F.col("t") % 3 == 0) & (rec % 4 > 0)).select("rec", F.col("value").alias("quality"), (F.col("t") * F.lit(10.0)).alias("start_s"), (F.col("t") * F.lit(10.0) + 30).alias("end_s"))
    return C.voice_segment(recordings, segments, ["rec"])


@query(
    f"""WITH {FRAMES}, g AS (SELECT rec, t * 1.0 AS start_s, t + value / 100 AS end_s, value / 100 AS d FROM f WHERE rec % 4 > 0), k AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY d DESC, start_s) AS r FROM g),
e AS (SELECT rec, count(*) * 1.0 AS d FROM f WHERE rec % 4 = 0 GROUP BY rec)
SELECT rec, row_number() OVER (PARTITION BY rec ORDER BY start_s)::INTEGER AS part, start_s, end_s FROM k WHERE r <= 5 UNION ALL SELECT rec, i::INTEGER + 1, d / 5 * i, d / 5 * (i + 1) FROM e, (SELECT unnest(range(0, 5)) AS i)""",
    "start_s end_s",
)
def speech_cuts(spark, t):
    f = numbered(t)
    recordings = f.groupBy("rec").agg((F.count("*") * F.lit(1.0)).alias("duration_s"))
    segments = f.where(F.col("rec") % 4 > 0).select("rec", (F.col("t") * F.lit(1.0)).alias("start_s"), (F.col("t") + F.col("value") / 100).alias("end_s"), (F.col("value") / 100).alias("duration_s"))
    return L.cut_points(recordings, segments, ["rec"])


BAND = "CASE " + " ".join(f"WHEN value * 12 BETWEEN {lo} AND {hi} THEN '{k}'" for k, lo, hi in G.PEAK_BANDS) + " END"


@query(f"WITH {FRAMES}, c AS (SELECT rec, t // 8 AS frame, {BAND} AS key, event_id, value * 1000 + event_id / 1e7 AS mag FROM f) SELECT rec, frame, key, arg_max(event_id, mag) AS event_id, max(mag) AS mag FROM c WHERE key IS NOT NULL GROUP BY rec, frame, key", "mag")
def best_in_band(spark, t):
    c = numbered(t).select("rec", F.floor(F.col("t") / 8).cast("long").alias("frame"), G.first_band_key(F.col("value") * 12, G.PEAK_BANDS).alias("key"), "event_id", (F.col("value") * 1000 + F.col("event_id") / 1e7).alias("mag"))
    return G.best_in_band(c.where("key is not null"), ["rec", "frame"], "key", "mag")


RANGES = "rg(gender, key, lo, hi, ord) AS (VALUES " + ", ".join(f"('{g}', '{k}', {lo}::DOUBLE, {hi}::DOUBLE, {i})" for g, by in G.FORMANT_RANGES.items() for i, (k, (lo, hi)) in enumerate(by.items())) + ")"


@query(
    f"""WITH {FRAMES}, {RANGES}, c AS (SELECT rec, t // 8 AS frame, ['male', 'female', 'child'][rec % 3 + 1] AS gender, value * 20 + event_id / 1e5 AS freq_hz, pitch_mag AS reliability FROM f),
h AS (SELECT * FROM (SELECT c.*, key, lo, hi, row_number() OVER (PARTITION BY rec, frame, freq_hz ORDER BY ord) AS n FROM c JOIN rg ON c.gender = rg.gender AND freq_hz BETWEEN lo AND hi) WHERE n = 1),
m AS (SELECT *, reliability * (1 - abs(freq_hz - (lo + hi) / 2) / ((hi - lo) / 2)) AS match_score FROM h)
SELECT rec, frame, key, freq_hz, match_score FROM (SELECT *, row_number() OVER (PARTITION BY rec, frame, key ORDER BY match_score DESC, freq_hz) AS b FROM m) WHERE b = 1""",
    "freq_hz match_score",
)
def range_candidates(spark, t):
    gender = F.element_at(F.array(F.lit("male"), F.lit("female"), F.lit("child")), (F.col("rec") % 3 + 1).cast("int"))
    c = frames(t).select("rec", F.floor(F.col("t") / 8).cast("long").alias("frame"), gender.alias("gender"), (F.col("value") * 20 + F.col("event_id") / 1e5).alias("freq_hz"), F.col("pitch_mag").alias("reliability"))
    return G.range_candidates(c, ["rec", "frame"], "freq_hz", G.range_table(spark), "reliability").select("rec", "frame", "key", "freq_hz", "match_score")


@query(f"WITH {FRAMES}, s AS (SELECT rec, voiced AND energy > 0.5 AS x, voiced OR energy > 0.5 AS y FROM f) SELECT rec, count(*) FILTER (x) AS n_both, count(*) FILTER (y) AS n_any FROM s GROUP BY rec")
def mask_sets(spark, t):
    loud = F.col("energy") > 0.5
    return frames(t).groupBy("rec").agg(F.count_if(F.col("voiced") & loud).alias("n_both"), F.count_if(F.col("voiced") | loud).alias("n_any"))


PAIRED = "g AS (SELECT user_id, avg(value) / 100 AS m, stddev_pop(value) / 100 AS s, count(*) / 100.0::DOUBLE AS n FROM events GROUP BY user_id), pr AS (SELECT a.user_id AS pair_id, a.m AS ma, b.m AS mb, a.s AS sa, b.s AS sb, a.n AS na, b.n AS nb FROM g a JOIN g b ON b.user_id = a.user_id + 1)"


def paired(t):
    g = t("events").groupBy("user_id").agg((F.avg("value") / 100).alias("m"), (F.stddev_pop("value") / 100).alias("s"), (F.count("*") / F.lit(100.0)).alias("n"))
    a = g.select(F.col("user_id").alias("pair_id"), *[F.col(c).alias(f"{c}a") for c in "msn"])
    return a.join(g.select((F.col("user_id") - 1).alias("pair_id"), *[F.col(c).alias(f"{c}b") for c in "msn"]), "pair_id")


def _kernel(d: str, slope: str) -> str:
    return f"(1 - least(1, {slope} * abs({d})))"


NASAL_SIM = f"0.3 * {_kernel('na - nb', '5')} + 0.5 * {_kernel('ma - mb', '2')} + 0.2 * {_kernel('sa - sb', '2')}"
EIGHT_SIM = "1 - (" + " + ".join(f"least(abs({c}a - {c}b) * {i + 1} / {s}, 1)" for i, (c, s) in enumerate(zip("msnmsnms", M.PERTURBATION_SPANS, strict=True))) + ") / 8"


@query(
    f"""WITH {PAIRED}, x AS (SELECT pair_id, {NASAL_SIM} AS nasal, {EIGHT_SIM} AS perturbation, CASE WHEN pair_id % 3 > 0 THEN least(1, na) END AS pitch FROM pr)
SELECT pair_id, nasal, perturbation, (1.0 * nasal + 1.2 * perturbation + 1.0 * coalesce(pitch, 0)) / (2.2 + CASE WHEN pitch IS NULL THEN 0 ELSE 1 END) AS voice FROM x""",
    "nasal perturbation voice",
)
def voice_similarity(spark, t):
    c = {k: F.col(k) for k in ("ma", "mb", "sa", "sb", "na", "nb")}
    eight = lambda side: F.array(*[c[k + side] * (i + 1) for i, k in enumerate("msnmsnms")])
    x = paired(t).select("pair_id", M.nasal_similarity(c["na"] - c["nb"], c["ma"] - c["mb"], c["sa"] - c["sb"]).alias("nasal"), M.perturbation_similarity(eight("a"), eight("b")).alias("perturbation"), F.when(F.col("pair_id") % 3 > 0, F.least(F.lit(1.0), c["na"])).alias("pitch"))
    return x.select("pair_id", "nasal", "perturbation", M.voice_feature_similarity({"nasal": F.col("nasal"), "jitter_shimmer": F.col("perturbation"), "pitch": F.col("pitch")}).alias("voice"))


@query(
    """WITH g AS (SELECT user_id, avg(value) * 8 AS f1, avg(value) * 24 + (user_id % 7) * 100 AS f2, avg(value) * 5 AS m, stddev_pop(value) / avg(value) AS cv, count(*) AS n, min(value) / avg(value) AS fl FROM events GROUP BY user_id),
eb AS (SELECT user_id, CASE WHEN hi > lo THEN least(99, CAST(floor((value - lo) / (hi - lo) * 100) AS INTEGER)) ELSE 0 END AS bin, count(*) AS c FROM (SELECT user_id, value, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM (SELECT user_id, CASE WHEN user_id % 3 = 0 AND event_id % 20 > 0 THEN 100.0 ELSE value END AS value FROM events)) GROUP BY ALL),
en AS (SELECT user_id, CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END AS e FROM (SELECT user_id, c / sum(c) OVER (PARTITION BY user_id) AS p FROM eb) GROUP BY user_id),
h AS (SELECT g.*, e, n >= 10 AND (m < 80 OR m > 300 OR e < 0.4) AS ps, CASE WHEN n >= 10 AND (m < 80 OR m > 300) THEN 12 * log2(m / 150.0) ELSE 0 END AS st, n >= 10 AND abs(f1 / 500 - f2 / 1500) < 0.2 AND (f1 / 500 < 0.7 OR f1 / 500 > 1.3) AS fs, fl > 0.4 OR (n >= 10 AND (cv < 0.05 OR g.user_id % 11 = 0)) AS rb FROM g JOIN en ON g.user_id = en.user_id),
i AS (SELECT *, CASE WHEN fs THEN f1 / 500 ELSE 0.0 END AS r FROM h)
SELECT user_id, e AS entropy, ps AS pitch, fs AS formant, r AS ratio, rb AS robot, (ps AND abs(st) > 3) OR fs OR rb AS is_modified, CASE WHEN ps AND abs(st) > 3 THEN 'pitch_shift' WHEN fs THEN 'formant_shift' WHEN rb THEN 'robot_voice' END AS type,
CASE WHEN ps AND abs(st) > 3 THEN least(abs(st) / 6, 1) WHEN fs THEN least(abs(r - 1) / 0.5, 1) WHEN rb THEN 0.8 ELSE 0 END AS confidence FROM i""",
    "entropy ratio confidence",
)
def combined_modification(spark, t):
    m = A.mean_in_order("_run", "value", ["event_id"])
    g = t("events").withColumn("_run", A.running_sum("value", ["user_id"], ["event_id"])).groupBy("user_id").agg((m * 8).alias("f1"), (m * 24).alias("f2"), (m * 5).alias("m"), A.coefficient_of_variation("value").alias("cv"), F.count("*").alias("n"), (F.min("value") / m).alias("fl"))
    f2 = F.col("f2") + (F.col("user_id") % 7) * 100
    # a third of the voices hardly leave one pitch
    steady = F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 20 > 0), 100.0).otherwise(F.col("value"))
    g = g.join(A.histogram_entropy(t("events").select("user_id", steady.alias("x")), ["user_id"], "x").select("user_id", F.col("normalized").alias("entropy")), "user_id")
    shifted, steps = R.pitch_shift(F.col("m"), F.col("entropy"), F.col("n"))
    formant, r = R.formant_shift(F.col("f1"), f2, F.col("n"))
    robot = R.robot_voice(F.col("fl"), F.col("cv"), F.col("user_id") % 11 == 0, F.col("n"))
    is_modified, kind, sure = R.combined_modification(shifted, steps, formant, r, robot)
    return g.select("user_id", "entropy", shifted.alias("pitch"), formant.alias("formant"), r.alias("ratio"), robot.alias("robot"), is_modified.alias("is_modified"), kind.alias("type"), sure.alias("confidence"))


@query(
    """WITH s AS (SELECT l_suppkey AS pair_id, CAST(l_linenumber AS VARCHAR) AS metric, 1.0 - l_discount AS score FROM lineitem WHERE l_suppkey % 5 > 0), q AS (SELECT pair_id, metric, median(score) AS m FROM s GROUP BY pair_id, metric),
f AS (SELECT pair_id, round(sum(CASE metric WHEN '1' THEN 1.5 WHEN '2' THEN 1.2 ELSE 1.0 END * m) / sum(CASE metric WHEN '1' THEN 1.5 WHEN '2' THEN 1.2 ELSE 1.0 END), 9) AS x, round(stddev_pop(m), 9) AS k FROM q GROUP BY pair_id)
SELECT p.pair_id, CASE WHEN x IS NULL THEN 'no_segments' WHEN x >= 0.95 AND k < 0.10 THEN 'very_high' WHEN x >= 0.88 AND k < 0.12 THEN 'high' WHEN x >= 0.80 AND k < 0.15 THEN 'probable' WHEN x >= 0.70 THEN 'similar' ELSE 'different' END AS verdict_code
FROM (SELECT DISTINCT l_suppkey AS pair_id FROM lineitem) p LEFT JOIN f ON p.pair_id = f.pair_id""",
)
def decisions(spark, t):
    """The whole decision for each pair; a pair without scores has a verdict of its own."""
    s = t("lineitem").select(F.col("l_suppkey").alias("pair_id"), F.col("l_linenumber").cast("string").alias("metric"), (F.lit(1.0) - F.col("l_discount")).alias("score"))
    weights = spark.createDataFrame([("1", 1.5), ("2", 1.2)], "metric string, weight double")
    return C.compare(s.where("pair_id % 5 > 0"), weights, s.select("pair_id").distinct()).select("pair_id", "verdict_code")


@query(
    """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events), s AS (SELECT user_id, count(*) AS len FROM f GROUP BY user_id),
w AS (SELECT user_id, st, st // 16 AS t FROM (SELECT user_id, unnest(range(0, len - 32 + 1, 16)) AS st FROM s)),
x AS (SELECT w.user_id, w.t, i - st AS n, value * (0.5 - 0.5 * cos(2 * pi() * (i - st) / 32)) AS x FROM w JOIN f ON f.user_id = w.user_id AND i >= st AND i < st + 32),
d AS (SELECT user_id, t, k, sqrt(sum(x * cos(2 * pi() * k * n / 32)) ^ 2 + sum(x * sin(2 * pi() * k * n / 32)) ^ 2) AS mag, k * 500.0 AS freq_hz FROM x, (SELECT unnest(range(0, 17)) AS k) GROUP BY user_id, t, k)
SELECT user_id, t::INTEGER AS t, avg(mag) AS "all", sum(freq_hz * mag) / sum(mag) AS centroid, coalesce(avg(mag) FILTER (freq_hz BETWEEN 250 AND 450), 0) AS nasal1,
    coalesce(avg(mag) FILTER (freq_hz BETWEEN 1000 AND 1200), 0) AS nasal2, coalesce(avg(mag) FILTER (freq_hz BETWEEN 700 AND 900), 0) AS antires, avg(mag) FILTER (freq_hz BETWEEN 1000 AND 2000) AS f_v,
    avg(mag) FILTER (freq_hz BETWEEN 2000 AND 4000) AS s_z, avg(mag) FILTER (freq_hz BETWEEN 4000 AND 8000) AS sh_zh FROM d GROUP BY user_id, t""",
    '"all" centroid nasal1 nasal2 antires f_v s_z sh_zh',
)
def fft_band_energy(spark, t):
    """Spectra of framed series (numpy in Arrow batches), then band means."""
    e = t("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("amp"))
    s = K.spectrum(S.framed(e, 32, 16).select("user_id", "t", "frame"), ["user_id", "t"], 32)
    return X.band_energies(s, ["user_id", "t"])


@query(f"WITH {FRAMES} SELECT rec, t * 0.01 AS ts, unnest(['pitch_hz', 'energy']) AS series, unnest([pitch_hz, energy]) AS y FROM f", "ts y")
def plot_data(spark, t):
    return sinks.plot_data(frames(t), ["rec"], ["pitch_hz", "energy"])


@query(f"WITH {PAIRED}, b AS (SELECT pair_id, unnest(['m', 's']) AS feature, unnest([least(1.0, abs(ma - mb) / 0.4), least(1.0, abs(sa - sb) / 0.2)]) AS difference FROM pr) SELECT *, CASE WHEN difference < 0.3 THEN 'low' WHEN difference < 0.7 THEN 'medium' ELSE 'high' END AS level FROM b", "difference")
def difference_bars(spark, t):
    g = t("events").groupBy("user_id").agg((F.avg("value") / 100).alias("m"), (F.stddev_pop("value") / 100).alias("s")).withColumnRenamed("user_id", "pair_id")
    return sinks.difference_bars(g, g.withColumn("pair_id", F.col("pair_id") - 1), ["pair_id"], {"m": 0.4, "s": 0.2})


@query(
    """WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, trunc(least(1, value / 600) * 32767) / 32768 AS x FROM events),
g AS (SELECT user_id, count(*) AS frames, sqrt(avg(x * x)) AS rms, max(abs(x)) AS top, sum(x * (i + 1)) AS s FROM f GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS rec_id, 16000 AS sr, 1 AS channels, 16 AS bits, frames, frames / 16000.0 AS duration_s, 'short' AS status, CASE WHEN top > 0 AND 20 * log10(rms) < -30 THEN s / top * 10 ^ (-3.0 / 20) ELSE s END AS weighted, TRUE AS valid, 'short' AS warnings FROM g""",
    "duration_s weighted",
)
def wav_round_trip(spark, t):
    """Samples to WAV bytes and back: rate, channels, frames, level and integrity of what was written."""
    e = t("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"] / 600).alias("amp"))
    files = sinks.wav_rows(e, ["user_id"]).select(F.concat(F.lit("/recordings/"), F.col("user_id").cast("string"), F.lit(".wav")).alias("path"), F.col("wav").alias("content"))
    got = audio.decoded(files)
    status = audio.integrity(got).select("rec_id", "valid", F.array_join("warnings", ",").alias("warnings"))
    weighted = F.aggregate(F.transform("amp", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return got.select("rec_id", "sr", "channels", "bits", "frames", "duration_s", "status", weighted.alias("weighted")).join(status, "rec_id")


@query(
    """WITH f AS (SELECT event_id, ['.wav', '.MP3', '.txt', '.flac', ''][event_id % 5 + 1] AS ext, CAST(value * 100000 AS BIGINT) AS length FROM events)
SELECT event_id, CASE WHEN lower(ext) NOT IN ('.wav', '.mp3', '.m4a', '.flac', '.ogg') THEN 'extension' WHEN length > 20971520 THEN 'too_large' END AS reason FROM f""",
)
def upload_guard(spark, t):
    ext = F.element_at(F.array(*[F.lit(x) for x in (".wav", ".MP3", ".txt", ".flac", "")]), (F.col("event_id") % 5 + 1).cast("int"))
    files = t("events").select("event_id", F.concat(F.lit("/in/"), F.col("event_id").cast("string"), ext).alias("path"), F.round(F.col("value") * 100000).cast("long").alias("length"))
    taken, rejected = audio.guarded(files)
    return taken.select("event_id", F.lit(None).cast("string").alias("reason")).union(rejected.select("event_id", "reason"))


@query(
    """WITH f AS (SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, event_id || '.wav' AS file_name, ['pcm_s16le', 'mp3', 'flac'][k % 3 + 1] AS codec, k * 1000 AS sample_rate, k % 2 + 1 AS channels, CASE WHEN k % 2 = 0 THEN k * 10 ELSE 64000 END AS bit_rate, k / 2.0 AS duration_s,
CASE WHEN k % 4 = 0 THEN 'enc' WHEN k % 4 = 1 THEN 'art' END AS creation_tool, ['uncompressed', 'lossy', 'lossless'][k % 3 + 1] AS codec_note FROM f""",
    "duration_s",
)
def file_metadata(spark, t):
    k = F.from_json("props", "k int")["k"]
    codec = F.element_at(F.array(F.lit("pcm_s16le"), F.lit("mp3"), F.lit("flac")), (k % 3 + 1).cast("int"))
    stream = F.format_string('{"codec_type": "audio", "codec_name": "%s", "sample_rate": "%d", "channels": %d%s}', codec, k * 1000, k % 2 + 1, F.when(k % 2 == 0, F.format_string(', "bit_rate": "%d"', k * 10)).otherwise(""))
    tags = F.when(k % 4 == 0, '"artist": "art", "encoder": "enc"').when(k % 4 == 1, '"artist": "art"').otherwise("")
    probe = F.format_string('{"streams": [{"codec_type": "video"}, %s], "format": {"duration": "%.1f", "bit_rate": "64000", "tags": {%s}}}', stream, k / F.lit(2.0), tags)
    files = t("events").select("event_id", F.format_string("/in/%d.wav", "event_id").alias("path"), probe.alias("probe_json"))
    return audio.file_metadata(files).select("event_id", "file_name", "codec", "sample_rate", "channels", "bit_rate", "duration_s", "creation_tool", "codec_note")


def _framed(t, size: int, hop: int):
    e = t("events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda x: x["value"]).alias("amp"))
    return S.framed(e, size, hop).select("user_id", "t", "frame")


@query(None)
def response_formants(spark, t):
    """Peaks of the linear-prediction response by band; tests hold them against the roots' frequencies."""
    return K.response_formants(_framed(t, 32, 16), ["user_id", "t"], 8)


@query(None)
def lpc_models(spark, t):
    """Order by the information criterion and the best of four windows for each frame; held against numpy in tests."""
    f = _framed(t, 40, 20).withColumn("peaks", F.lit(4))
    best = K.lpc_window_ranks(f, ["user_id", "t"], 8).where("rank = 0").drop("rank")
    return K.lpc_orders(f, ["user_id", "t"], "peaks").join(best, ["user_id", "t"])


@query(None)
def timbre(spark, t):
    """Contrast of seven bands and 13 cepstral coefficients of each frame; held against numpy in tests."""
    f, keys = _framed(t, 32, 16), ["user_id", "t"]
    a = K.spectral_contrast(f, keys, 512).select(*keys, F.lit("contrast").alias("kind"), F.col("band").alias("i"), F.col("contrast").alias("x"))
    return a.union(K.mfccs(f, keys, 13, 512).select(*keys, F.lit("mfcc"), "coefficient", "value"))
