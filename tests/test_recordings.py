"""A recording from samples to verdict."""

import numpy as np
from pyspark.sql import functions as F

from vocalith.operators import ranges as G
from vocalith.operators import recordings as P
from vocalith.operators import series as S
from vocalith.operators import signal as K

SR = K.SAMPLE_RATE


def voice(f0, seconds=1.0, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(SR * seconds)) / SR
    x = sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 25))
    return x / np.abs(x).max() * 0.5 + rng.standard_normal(len(t)) * 1e-3


def test_samples_to_features(spark):
    df = spark.createDataFrame([("a", voice(120).tolist()), ("b", voice(220).tolist())], "rec_id string, amp array<double>")
    frames = S.framed(df, 1024, 512).withColumn("ts", F.col("start") / SR)
    keys = ["rec_id", "t"]
    pitch = K.pitch_frames(frames, [*keys, "ts"]).withColumns({"voiced": F.col("pitch_mag") > 0.3, "voiced_prob": F.col("pitch_mag")})
    spec = K.spectrum(frames, keys, 1024)
    got = {r["rec_id"]: r for r in P.all_features(pitch, spec, ["rec_id"]).collect()}
    assert abs(got["a"]["pitch"]["median"] - 120) < 3 and abs(got["b"]["pitch"]["median"] - 220) < 4
    assert got["a"]["pitch"]["gender"] == "male" and got["b"]["pitch"]["gender"] == "female"
    assert got["a"]["perturbation"]["jitter_local"] < 2 and got["a"]["temporal"]["speech_ratio"] > 0.9
    v = {r["rec_id"]: r["v"] for r in P.biometric_vector(P.all_features(pitch, spec, ["rec_id"]), ["rec_id"]).collect()}
    assert len(v["a"]) == 22 and all(np.isfinite(v["a"]))


def test_tracks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal(3000)
    for f, r in ((500, 0.97), (1500, 0.97), (2500, 0.97)):  # resonances
        y = np.zeros_like(x)
        for i in range(len(x)):
            y[i] = x[i] + (2 * r * np.cos(2 * np.pi * f / SR) * y[i - 1] if i > 0 else 0) - (r * r * y[i - 2] if i > 1 else 0)
        x = y / np.abs(y).max()
    df = spark.createDataFrame([("a", 0, x[500:2500].tolist(), "male")], "rec_id string, t int, frame array<double>, gender string")
    r = P.track_formants(df, ["rec_id", "t"], G.range_table(spark)).first()
    assert abs(r["F1"] - 500) < 60 and abs(r["F2"] - 1500) < 90 and abs(r["F3"] - 2500) < 120


def test_windows_of_energy(spark):
    df = spark.createDataFrame([("a", float(i), float(i)) for i in range(10)], "r string, ts double, energy double")
    got = {r["start_s"]: r["energy"] for r in P.window_energy(df, ["r"], 4.0, 2.0).collect()}
    assert got == {0.0: 1.5, 2.0: 3.5, 4.0: 5.5}
    literal = {r["start_s"]: r["energy"] for r in P.window_energy(df, ["r"], 4.0, 2.0, literal=True).collect()}
    assert literal == {0.0: 0.5, 2.0: 1.5, 4.0: 2.5}


def test_voice_segment_and_times(spark):
    rec = spark.createDataFrame([("a", 4.0), ("b", 30.0), ("c", 100.0), ("d", 100.0)], "r string, duration_s double")
    seg = spark.createDataFrame([("c", 0.5, 3.0, 50.0), ("c", 0.5, 1.0, 40.0)], "r string, quality double, start_s double, end_s double")
    got = {r["r"]: (r["status"], r["start_s"]) for r in P.voice_segment(rec, seg, ["r"]).collect()}
    assert got == {"a": ("short", 0.0), "b": ("whole", 0.0), "c": ("cut", 1.0), "d": ("none", None)}
    t = spark.createDataFrame([("a", i, 2.0) for i in range(5)], "r string, i int, duration_s double")
    assert [r["ts"] for r in P.aligned_times(t, ["r"], "i").orderBy("i").collect()] == np.linspace(0, 2, 5).tolist()


def test_spectrum_quality_and_cleaning(spark):
    f = np.fft.rfftfreq(2048, 1 / SR)
    assert P.spectrum_quality(np.zeros(1025), f) == 0.1
    peaky = 0.01 + sum(np.exp(-0.5 * ((f - c) / 60) ** 2) for c in (500, 1500, 2500, 3500))
    assert P.spectrum_quality(peaky, f) > 0.8
    df = spark.createDataFrame([("a", voice(150, 0.5).tolist())], "rec_id string, amp array<double>")
    one = P.cleaned(df).first()["amp"]
    assert one == P.cleaned(df).first()["amp"] and abs(max(map(abs, one)) - 1) < 1e-9
    assert len(P.cleaned(df, "enhance").first()["amp"]) == SR // 2


def test_decision(spark):
    v = [1.0, 2.0, 3.0]
    seg = lambda p, x: (p, 1, x, x, x, x)
    schema = "pair_id string, rn int, ecapa array<double>, xvec array<double>, res array<double>, yamnet array<double>"
    a = spark.createDataFrame([seg("same", v), seg("other", v)], schema)
    b = spark.createDataFrame([seg("same", v), seg("other", [-1.0, 0.5, 0.0])], schema)
    pairs = spark.createDataFrame([("same",), ("other",), ("empty",)], "pair_id string")
    weights = spark.createDataFrame([("ecapa", 1.5)], "metric string, weight double")
    got = {r["pair_id"]: r["verdict_code"] for r in P.compare(P.segment_similarities(a, b), weights, pairs).collect()}
    assert got == {"same": "very_high", "other": "different", "empty": "no_segments"}
    swapped = P.segment_similarities(b, a).orderBy("pair_id", "metric").collect()
    assert swapped == P.segment_similarities(a, b).orderBy("pair_id", "metric").collect()
