"""Feature groups against their definitions, written out in numpy for one recording and for awkward ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.operators import features as X
from vocalith.operators import metrics as M
from vocalith.operators import ranges as G
from vocalith.operators import recordings as C
from vocalith.operators import rules as R
from vocalith.operators import series as S

FREQ = np.arange(0, 8001, 50.0)
FRAMES = 60


@pytest.fixture(scope="module")
def voice():
    rng = np.random.default_rng(11)
    mag = rng.gamma(0.6, 1.0, size=(FRAMES, len(FREQ))) * np.exp(-FREQ / 2500)[None]
    mag[::3, (FREQ >= 250) & (FREQ <= 450)] *= 9
    mag[::3, (FREQ >= 700) & (FREQ <= 900)] *= 0.01
    mag[10] = 0
    pitch = rng.uniform(90, 260, size=FRAMES)
    pitch[::7] = 0
    return {"mag": mag, "pitch": pitch, "amp": rng.uniform(0.1, 1, size=FRAMES), "prob": rng.uniform(0.5, 1, size=FRAMES), "energy": np.where(np.arange(FRAMES) % 20 < 13, rng.uniform(0.5, 1, FRAMES), 0.01)}


@pytest.fixture(scope="module")
def tables(spark, voice):
    v = voice
    f = [("a", t, t * 0.01, float(v["energy"][t]), float(v["pitch"][t]), float(v["amp"][t]), bool(v["pitch"][t] > 0), float(v["prob"][t])) for t in range(FRAMES)]
    f += [("silent", t, t * 0.01, 0.0, 0.0, 0.0, False, 0.0) for t in range(8)]
    s = [("a", t, i, float(FREQ[i]), float(v["mag"][t, i])) for t in range(FRAMES) for i in range(len(FREQ))]
    s += [("silent", t, i, float(FREQ[i]), 0.0) for t in range(8) for i in range(len(FREQ))]
    frames = spark.createDataFrame(f, "rec string, t int, ts double, energy double, pitch_hz double, pitch_mag double, voiced boolean, voiced_prob double")
    return frames, spark.createDataFrame(s, "rec string, t int, bin int, freq_hz double, mag double")


def expected(v):
    """All groups of the recording ``a``."""
    mag = v["mag"]
    band = lambda lo, hi: mag[:, (FREQ >= lo) & (FREQ <= hi)].mean(axis=1)
    every = mag.mean(axis=1)
    part = lambda x: np.divide(x, every, out=np.zeros(FRAMES), where=every > 0)
    s, sh, fv = band(2000, 4000), band(4000, 8000), band(1000, 2000)
    centroid = np.divide((mag * FREQ).sum(axis=1), mag.sum(axis=1), out=np.zeros(FRAMES), where=mag.sum(axis=1) > 0)
    own = {k: x > 0.2 * x.max() for k, x in (("s_z", s), ("sh_zh", sh), ("f_v", fv))}
    union = own["s_z"] | own["sh_zh"] | own["f_v"]
    fric = {"centroid_mean": centroid[union].mean(), "centroid_std": centroid[union].std(), "overall_ratio": union.mean()}
    for k, x in (("s_z", s), ("sh_zh", sh), ("f_v", fv)):
        fric |= {f"{k}_energy": x[own[k]].mean(), f"{k}_ratio": part(x)[own[k]].mean(), f"{k}_ratio_std": part(x)[own[k]].std(), f"{k}_frames": own[k].sum()}
    r1, r2, anti = part(band(250, 450)), part(band(1000, 1200)), part(band(700, 900))
    nasal = (r1 > 1.5 * r1.mean()) & (anti < 0.7 * anti.mean())
    assert 0 < nasal.sum() < FRAMES
    nose = {"presence": nasal.mean(), "mean_r1": r1[nasal].mean(), "mean_r2": r2[nasal].mean(), "mean_anti": anti[nasal].mean(), "quality": (r1 / (anti + 1e-10))[nasal].mean(), "resonance_ratio": (r1 / (r2 + 1e-10))[nasal].mean()}
    keep = (v["pitch"] > 0) & (v["prob"] > 0.7)
    p = v["pitch"][keep]
    d, a = np.gradient(p), np.gradient(np.gradient(p))
    pitch = {"mean": p.mean(), "median": np.median(p), "std": p.std(), "mean_derivative": np.abs(d).mean(), "derivative_std": d.std(), "mean_acceleration": np.abs(a).mean(), "acceleration_std": a.std()}
    on = v["pitch"] > 0
    period, amp = 1 / v["pitch"][on], v["amp"][on]
    dp, da = np.abs(np.diff(period)), np.abs(np.diff(amp))
    five = lambda x: np.mean([abs(x[i] - x[i - 2 : i + 3].mean()) for i in range(2, len(x) - 2)]) / x.mean() * 100
    perturbation = {
        "jitter_local": 100 * dp.mean() / period.mean(), "jitter_absolute": 1000 * dp.mean(), "jitter_ppq5": five(period), "jitter_variability": 100 * dp.std() / period.mean(),
        "shimmer_local": 100 * da.mean() / amp.mean(), "shimmer_db": np.abs(np.diff(20 * np.log10(amp / amp.mean()))).mean(), "shimmer_apq5": five(amp), "shimmer_variability": 100 * da.std() / amp.mean(),
    }
    speech = v["energy"] > 0.05 * v["energy"].max()
    phrase = [12 * 0.01] * 3  # runs of 13 frames, both ends inside
    temporal = {"speech_ratio": speech.mean(), "pause_ratio": 1 - speech.mean(), "mean_phrase": np.mean(phrase), "mean_pause": 6 * 0.01, "speech_rate": 3 / 0.59, "tempo": speech.mean() / np.mean(phrase), "phrase_count": 3, "pause_count": 3}
    return {"fricative": fric, "nasal": nose, "pitch": pitch, "perturbation": perturbation, "temporal": temporal}


def test_groups(tables, voice):
    got = {r["rec"]: r for r in C.all_features(*tables, ["rec"]).collect()}
    for group, values in expected(voice).items():
        for k, x in values.items():
            assert got["a"][group][k] == pytest.approx(x, abs=1e-9), (group, k)
    quiet = got["silent"]
    assert all(x == 0 for x in quiet["fricative"]) and quiet["perturbation"]["jitter_local"] == 0
    assert quiet["pitch"]["mean"] == 0 and quiet["pitch"]["male"] == quiet["pitch"]["female"] == 0.5 and quiet["pitch"]["gender"] == "unknown"
    assert (quiet["temporal"]["speech_ratio"], quiet["temporal"]["pause_ratio"], quiet["temporal"]["mean_pause"], quiet["temporal"]["tempo"]) == (0, 1, 0, 0)
    assert (quiet["nasal"]["presence"], quiet["nasal"]["quality"], quiet["nasal"]["resonance_ratio"]) == (0, 0, 0)


def test_vector_of_22(tables, voice):
    """The list by hand: five of pitch, six of perturbation, three fricative, three nasal, five of quality."""
    every = C.all_features(*tables, ["rec"])
    r = every.where("rec = 'a'").first()
    e = expected(voice)
    q = r["quality"]
    want = [
        e["pitch"]["mean"], e["pitch"]["median"], e["pitch"]["std"], e["pitch"]["mean_derivative"], e["pitch"]["mean_acceleration"],
        e["perturbation"]["jitter_local"], e["perturbation"]["jitter_absolute"], e["perturbation"]["jitter_ppq5"],
        e["perturbation"]["shimmer_local"], e["perturbation"]["shimmer_db"], e["perturbation"]["shimmer_apq5"],
        e["fricative"]["s_z_ratio"], e["fricative"]["sh_zh_ratio"], e["fricative"]["centroid_mean"],
        e["nasal"]["mean_r1"], e["nasal"]["mean_r2"], e["nasal"]["resonance_ratio"],
        q["breathiness"], q["creakiness"], q["tenseness"], q["nasality"], q["stability"],
    ]
    assert C.biometric_vector(every, ["rec"]).where("rec = 'a'").first()["v"] == pytest.approx(want, abs=1e-9)


def test_vectors_of_eight(tables, voice):
    _, spectrum = tables
    energies, shape = X.band_energies(spectrum, ["rec", "t"]), X.spectral_shape(spectrum, ["rec", "t"])
    mag = voice["mag"]
    band = lambda lo, hi: mag[:, (FREQ >= lo) & (FREQ <= hi)].mean(axis=1)
    centroid = np.nan_to_num((mag * FREQ).sum(axis=1) / np.maximum(mag.sum(axis=1), 1e-300))
    power = np.maximum(mag**2, 1e-10)
    flat = np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1)
    s, sh = band(2000, 4000), band(4000, 8000)
    r = np.divide(sh, s, out=np.zeros(FRAMES), where=s > 0)
    want = [centroid.mean(), centroid.std(), flat.mean(), flat.std(), s.mean(), sh.mean(), r.mean(), r.std()]
    got = {x["rec"]: x["v"] for x in X.fricative_vector(energies, shape, ["rec"], "t").collect()}
    assert got["a"] == pytest.approx(want, abs=1e-9) and got["silent"] == pytest.approx([0, 0, 1, 0, 0, 0, 0, 0])
    e1, e2, all_ = band(250, 450), band(1000, 1200), mag.mean(axis=1)
    parts = [np.divide(e, all_, out=np.zeros(FRAMES), where=all_ > 0) for e in (e1, e2)]
    want = [e1.mean(), e1.std(), e2.mean(), e2.std(), parts[0].mean(), parts[0].std(), parts[1].mean(), parts[1].std()]
    got = {x["rec"]: x["v"] for x in X.nasal_vector(energies, ["rec"]).collect()}
    assert got["a"] == pytest.approx(want, abs=1e-9) and got["silent"] == [0.0] * 8


def test_gender_shares(spark):
    means = [None, 0.0, 49.9, 50.0, 180.0, 180.1, 300.0, 300.1]
    df = spark.createDataFrame([(m,) for m in means], "m double").select(*[c.alias(k) for k, c in R.gender_shares_by_pitch(F.col("m")).items()])
    assert [r["male"] for r in df.collect()] == [0.5, 0.5, 0.9, 1.0, 1.0, 0.0, 0.0, 0.1]


def test_candidates_score_by_half_the_range(spark):
    """Male F1 is 250 to 900: its middle scores the whole reliability, its ends nothing."""
    rows = [(0, 575.0, 0.8, "male"), (1, 250.0, 0.8, "male"), (2, 737.5, 0.8, "male")]
    got = G.range_candidates(spark.createDataFrame(rows, "t int, hz double, q double, gender string"), ["t"], "hz", G.range_table(spark), "q").collect()
    assert {r["t"]: round(r["match_score"], 9) for r in got} == {0: 0.8, 1: 0.0, 2: 0.4}


def resonances(hz, r=0.985, n=2400, seed=1):
    x = np.random.default_rng(seed).normal(size=n)
    for f in hz:
        y = np.zeros(n)
        for i in range(n):
            y[i] = x[i] + (2 * r * np.cos(2 * np.pi * f / 16000) * y[i - 1] if i else 0) - (r * r * y[i - 2] if i > 1 else 0)
        x = y / np.abs(y).max()
    return x[400:].tolist()


def test_tracks_by_gender_and_quality(spark):
    frame = resonances((600, 1500, 2500, 3600))
    rows = [(0, frame, "male", 1.0), (1, frame, "robot", 1.0), (2, frame, "male", 0.5)]
    df = spark.createDataFrame(rows, "t int, frame array<double>, gender string, q double")
    got = {r["t"]: r for r in C.track_formants(df, ["t"], G.range_table(spark), quality="q").collect()}
    assert abs(got[0]["F1"] - 600) < 60 and got[1]["F1"] == got[0]["F1"]  # an unknown gender is a male
    assert got[2]["F1_reliability"] == pytest.approx(got[0]["F1_reliability"] / 2)


def test_disorder_halves_every_reliability(spark):
    """F1 at 890 is in male F1 only; F2 at 850 is in F1's range too but F1 comes first, so ranges are made to overlap here."""
    ranges = spark.createDataFrame([("male", "F1", 800.0, 1000.0, 0), ("male", "F2", 400.0, 700.0, 1), ("male", "F3", 2000.0, 3000.0, 2)], "gender string, key string, lo double, hi double, ord int")
    df = spark.createDataFrame([(0, resonances((550, 900, 2500)), "male")], "t int, frame array<double>, gender string")
    plain = C.track_formants(df, ["t"], ranges.where("key <> 'F2'")).first()
    both = C.track_formants(df, ["t"], ranges).first()
    assert both["F2"] <= both["F1"] and both["F1_reliability"] == pytest.approx(plain["F1_reliability"] / 2) and both["F3_reliability"] == pytest.approx(plain["F3_reliability"] / 2)


def test_profiles_without_spread(spark):
    schema = "p int, key string, mean double, std double, ci_lo double, ci_hi double, count int"
    a = spark.createDataFrame([(0, "F1", 500.0, 0.0, 490.0, 510.0, 9)], schema)
    assert M.statistical_profile(a, a, ["p"]).first()["similarity"] == pytest.approx(1.0)
    b = spark.createDataFrame([(0, "F1", 0.0, 0.0, 0.0, 0.0, 9)], schema)
    assert M.statistical_profile(b, b, ["p"]).first()["similarity"] == pytest.approx(0.1)


def test_robot_needs_ten_voiced_frames(spark):
    rows = [(0.1, 0.01, True, 9), (0.1, 0.01, False, 10), (0.1, 0.2, True, 10), (0.41, 0.9, False, 1), (0.1, None, None, 99)]
    df = spark.createDataFrame(rows, "f double, cv double, r boolean, n int").select(R.robot_voice(F.col("f"), F.col("cv"), F.col("r"), F.col("n")).alias("x"))
    assert [r["x"] for r in df.collect()] == [False, True, True, True, False]


def test_phrases_count_frames(spark):
    df = spark.createDataFrame([("r", t * 0.1, s) for t, s in enumerate([True, False, True, True, True])], "r string, ts double, speech boolean")
    got = S.temporal_features(df, ["r"], "ts", "speech").first()
    assert got["speech_ratio"] == pytest.approx(0.8) and got["mean_phrase"] == pytest.approx(0.1) and got["tempo"] == pytest.approx(8.0)
