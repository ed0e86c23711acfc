"""Formulas against numbers: hand-computed values, numpy, invariants and thresholds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.functions import numbers as N
from vocalith.functions import vectors as V
from vocalith.operators import aggregates as A
from vocalith.operators import features as X
from vocalith.operators import ranges as G
from vocalith.operators import rules as R
from vocalith.operators import selection as L
from vocalith.operators import series as S
from vocalith.operators import signal as K
from vocalith.operators import similarity as Y


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.mark.parametrize(("df", "want"), [(1, 12.706205), (2, 4.302653), (3, 3.182446), (4, 2.776445), (9, 2.262157), (4.5, 2.658912), (30.25, 2.041565)])
def test_t_quantile(df, want):
    assert abs(N.t_quantile(df) - want) < 1e-5


def test_t_quantile_edges():
    assert math.isnan(N.t_quantile(0)) and abs(N.t_quantile(5, 0.5)) < 1e-9 and N.t_quantile(7, 0.025) == -N.t_quantile(7, 0.975)
    with pytest.raises(ValueError):
        N.t_quantile_udf(1.0)


def test_weighted_interval(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 2.0), ("a", 4.0, 0.5), ("b", 2.0, 1.0), ("c", 2.0, 0.0), ("c", 4.0, 0.0)], "g string, x double, w double")
    got = {r["g"]: r for r in A.with_t_interval(A.weighted_stats(df, ["g"]), N.t_quantile_udf()).collect()}
    x, w = np.array([1, 3, 4.0]), np.array([1, 2, 0.5])
    m = (x * w).sum() / w.sum()
    n = w.sum() ** 2 / (w**2).sum()
    half = N.t_quantile(n - 1) * math.sqrt((w * (x - m) ** 2).sum() / w.sum() / n)
    assert abs(got["a"]["ci_lo"] - (m - half)) < 1e-9 and got["b"]["ci_lo"] is None
    assert got["c"]["mean"] == 3.0  # no weight at all: each counts alike


def test_vectors(spark):
    a, b, z = arr(1, 2, 3), arr(2, 4, 6), arr(0, 0, 0)
    r = one(spark, V.cosine(a, b), V.cosine(a, z), V.cosine_or_null(a, z), V.euclid_similarity(a, a), V.pearson(a, arr(3, 2, 1)), V.pearson(a, arr(1, 1, 1)), V.norm(V.l2_normalize(b)), V.calibrated(F.lit(0.5)), V.confidence(F.lit(0.5)))
    assert [None if x is None else round(x, 9) for x in r] == [1.0, 0.0, None, 1.0, -1.0, 0.0, 1.0, 0.5, 0.0]


def test_pair_stats_fill_pairs_without_segments(spark):
    sims = spark.createDataFrame([(1, 1, 1, 0.5), (1, 1, 2, 0.7)], "p int, i int, j int, sim double")
    got = {r["p"]: r for r in Y.pair_stats(sims, ["p"], spark.createDataFrame([(1,), (2,)], "p int"), keep_all=True).collect()}
    assert got[1]["all_similarities"] == [0.5, 0.7] and got[2]["mean"] == 0.0 and got[2]["n"] == 0


def test_confidence_interval_edges(spark):
    df = spark.createDataFrame([("one", 0.5), ("two", 0.0), ("two", 1.0)], "m string, score double")
    got = {r["m"]: (r["ci_lo"], r["ci_hi"]) for r in A.confidence_interval(df, ["m"]).collect()}
    assert got == {"one": (0.0, 1.0), "two": (0.0, 1.0)}


VERDICTS = [(0.95, 0.09, "very_high"), (0.95, 0.10, "high"), (0.88, 0.12, "probable"), (0.80, 0.15, "similar"), (0.99, 0.5, "similar"), (0.70, 0.9, "similar"), (0.6999, 0.0, "different")]


def test_verdicts_at_their_thresholds(spark):
    df = spark.createDataFrame([(s, c) for s, c, _ in VERDICTS], "s double, c double")
    assert [r[0] for r in df.select(R.verdict(F.col("s"), F.col("c"))).collect()] == [v for *_, v in VERDICTS]
    r = one(spark, R.gated_verdict(F.lit(0.9), F.lit(0.0), F.lit(0.7), F.lit(0.0)), R.gated_verdict(F.lit(0.85), F.lit(0.0), F.lit(0.71), F.lit(0.0)), R.gated_verdict(F.lit(0.84), F.lit(0.0), F.lit(0.0), F.lit(0.9)))
    assert list(r) == ["high", "unreliable_similar", "unreliable"]


def test_environment_order(spark):
    e = lambda r, b, c: R.recording_environment(F.lit(r).cast("int"), F.lit(b).cast("int"), F.lit(c).cast("int"))
    r = one(spark, e(44100, 320000, 2), e(8000, 1, 1), e(8000, 1, 2), e(16000, 1, 2), e(24000, 1, 1), e(None, None, None), e(32000, 1, 1))
    assert list(r) == ["professional", "phone", "call", "voip", "voip", "call", "unknown"]


def test_cascades(spark):
    r = one(spark, R.live_modification(F.lit(5.1), F.lit(1.0), F.lit(50.0), F.lit(50.0), F.lit(0.9)), R.live_modification(F.lit(5.0), F.lit(0.05), F.lit(50.0), F.lit(50.0), F.lit(0.51)), R.live_modification(F.lit(1.0), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(50.0), F.lit(0.6)), R.live_modification(F.lit(1.0), F.lit(1.0), F.lit(10.0), F.lit(20.0), F.lit(0.6)))
    assert list(r) == ["pitch_shift", "robot_voice", "formant_modification", None]
    hit, steps = R.pitch_shift(F.lit(300.0), F.lit(0.39), F.lit(10))
    r = one(spark, hit, steps, R.pitch_shift(F.lit(301.0), F.lit(0.9), F.lit(9))[0], R.formant_shift(F.lit(700.0), F.lit(2100.0), F.lit(10))[0], R.robot_voice(F.lit(0.4), F.lit(0.05), F.lit(False), F.lit(10)))
    assert list(r) == [True, 0.0, False, True, False]
    m = R.combined_modification(F.lit(True), F.lit(3.0), F.lit(True), F.lit(1.25), F.lit(True))
    assert list(one(spark, *[c.alias(f"c{i}") for i, c in enumerate(m)])) == [True, "formant_shift", 0.5]


def test_constraints_are_sequential(spark):
    row = ("male", True, 1.0, 4, 900.0, 850.0, 2500.0, 3500.0, 0.9, 0.5, 0.9, 0.9)
    names = ["gender", "is_voiced", "energy", "formant_count", *R.FORMANTS, *[f"{f}_reliability" for f in R.FORMANTS]]
    r = R.enforce_constraints(spark.createDataFrame([row], names)).first()
    # F2 is pushed to 1000, F2/F1 = 1.11 takes 0.6 of both, F2-F1 = 100 is unusual: 0.8 of all
    assert (r["F1"], r["F2"]) == (900.0, 1000.0) and r["modified"] and r["odd_intervals"]
    assert abs(r["F1_reliability"] - 0.9 * 0.6 * 0.8) < 1e-9 and abs(r["F2_reliability"] - 0.5 * 0.7 * 0.6 * 0.8) < 1e-9
    silent = R.enforce_constraints(spark.createDataFrame([(*row[:2], 0.0, 2, *row[4:])], names)).first()
    assert silent["F2"] == 850.0 and not silent["modified"]


def test_series(spark):
    x = [1.0, 2.0, 4.0, 7.0, 11.0, 16.0]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(x)], "r string, t int, x double")
    g = [r["g"] for r in df.withColumn("g", S.gradient("x", ["r"], ["t"])).orderBy("t").collect()]
    assert g == np.gradient(x).tolist()
    pq = S.perturbation_quotient(df, ["r"], ["t"], "x").first()
    inner = [abs(x[i] - np.mean(x[i - 2 : i + 3])) for i in (2, 3)]
    assert abs(pq["pq"] - 100 * np.mean(inner) / np.mean(x)) < 1e-9 and pq["n"] == 2
    assert S.perturbation_quotient(df.where("t < 4"), ["r"], ["t"], "x").first()["pq"] == 0.0
    starts = lambda n, last: one(spark, S.frame_starts(F.lit(n), 4, 2, last))[0]
    assert starts(8, True) == [0, 2, 4] and starts(8, False) == [0, 2] and starts(3, True) == [] and starts(4, False) == []


def test_runs_and_phrases(spark):
    mask = [0, 1, 1, 0, 1, 0, 0, 0, 1, 1]
    df = spark.createDataFrame([("r", i * 0.1, bool(m)) for i, m in enumerate(mask)], "r string, ts double, speech boolean")
    runs = sorted((round(r["start_s"], 1), round(r["end_s"], 1)) for r in S.speech_runs(df, ["r"], "ts", "speech", 0.05).collect())
    assert runs == [(0.1, 0.3), (0.4, 0.5), (0.8, 0.9)]
    merged = sorted((round(r["start_s"], 1), round(r["end_s"], 1)) for r in S.merge_runs(S.speech_runs(df, ["r"], "ts", "speech", 0.05), ["r"], 0.15).collect())
    assert merged == [(0.1, 0.5), (0.8, 0.9)]
    p = sorted((round(r["start_s"], 1), round(r["duration_s"], 1)) for r in S.phrases(df, ["r"], "ts", "speech").collect() if r["speech"])
    assert p == [(0.1, 0.1), (0.4, 0.0), (0.8, 0.1)]


def test_opening_drops_short_runs_and_closing_fills_gaps(spark):
    mask = [1, 0, 1, 1, 1, 1, 1, 1, 0, 0, 1, 1, 1, 1, 1, 0]
    df = spark.createDataFrame([("r", i, m) for i, m in enumerate(mask)], "r string, t int, m int")
    got = [r["m"] for r in S.opened_closed(df, ["r"], ["t"], "m", 5, 3).orderBy("t").collect()]
    assert got[:2] == [0, 0] and got[2:15] == [1] * 13


@pytest.mark.parametrize("n", [1, 5, 10, 11, 12, 19, 57, 100])
def test_even_subsample_is_linspace(spark, n):
    df = spark.range(n).withColumn("g", F.lit(1))
    assert sorted(r["id"] for r in S.even_subsample(df, ["g"], ["id"], 10).collect()) == sorted(set(N.even_indices(n, 10) if n > 10 else range(n)))


def test_half_power_bandwidth(spark):
    mags = [0.1, 0.5, 0.9, 1.0, 0.8, 0.6, 0.2]
    s = spark.createDataFrame([(1, i, i * 10.0, m) for i, m in enumerate(mags)], "t int, bin int, freq_hz double, mag double")
    peaks = spark.createDataFrame([(1, 3, 1.0)], "t int, peak_bin int, peak_mag double")
    assert S.half_power_bandwidth(s, ["t"], peaks).first()["bandwidth_hz"] == 40.0


def test_bands_overlap_and_first_match(spark):
    df = spark.createDataFrame([(1, 2000.0), (2, 4000.0), (3, 900.0), (4, 3200.0), (5, 50.0)], "i int, hz double")
    both = {}
    for r in G.in_bands(df, "hz", G.band_table(spark, G.ENERGY_BANDS)).collect():
        both.setdefault(r["i"], set()).add(r["key"])
    assert both[1] == {"f_v", "s_z"} and both[2] == {"s_z", "sh_zh"}
    join = {r["i"]: r["key"] for r in G.first_band(df, ["i", "hz"], "hz", G.band_table(spark, G.PEAK_BANDS)).collect()}
    case = {r["i"]: r["key"] for r in df.withColumn("key", G.first_band_key(F.col("hz"), G.PEAK_BANDS)).where("key is not null").collect()}
    assert join == case == {1: "F2", 2: "F4", 3: "F1", 4: "F3"}


def test_range_candidates(spark):
    roots = spark.createDataFrame([(1, "male", 600.0, 0.9), (1, "male", 700.0, 0.9), (1, "male", 850.0, 0.5), (1, "male", 100.0, 0.9)], "t int, gender string, hz double, quality double")
    got = G.range_candidates(roots, ["t"], "hz", G.range_table(spark), "quality").collect()
    assert {(r["key"], r["hz"]) for r in got} == {("F1", 600.0)}


def test_greedy_selection(spark):
    df = spark.createDataFrame([("r", float(s), v) for s, v in ((0, 9.0), (10, 8.0), (40, 7.0), (20, 6.0), (80, 1.0))], "r string, s double, v double")
    got = sorted((r["rank"], r["s"], r["filled"]) for r in L.greedy_segments(df, ["r"], "v", "s", 30.0, 4, 0.25).collect())
    assert got == [(1, 0.0, False), (2, 40.0, False), (3, 80.0, False), (4, 10.0, True)]
    top = [r["s"] for r in L.top_segments(df, ["r"], "v", "s", 2).orderBy("rank").collect()]
    assert top == [0.0, 10.0] and L.best_segment(df, ["r"], "v", "s").first()["s"] == 0.0


def test_cut_points_and_equal_parts(spark):
    rec = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "r string, duration_s double")
    seg = spark.createDataFrame([("a", 1.0, 2.0, 1.0), ("a", 4.0, 7.0, 3.0), ("a", 8.0, 9.5, 1.5)], "r string, start_s double, end_s double, duration_s double")
    got = L.cut_points(rec, seg, ["r"], 2).collect()
    assert sorted((r["part"], r["start_s"]) for r in got if r["r"] == "a") == [(1, 4.0), (2, 8.0)]
    assert sorted((r["part"], r["start_s"]) for r in got if r["r"] == "b") == [(i + 1, 2.0 * i) for i in range(5)]


def test_gender_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([("m", 118.0 + i) for i in range(12)] + [("c", 310.0 + i) for i in range(12)] + [("few", 200.0)], "r string, pitch_hz double")
    got = {r["r"]: r for r in X.gender_estimate(df, ["r"]).collect()}
    for r in got.values():
        assert abs(r["male"] + r["female"] + r["child"] - 1) < 1e-9
    assert got["m"]["male"] > 0.9 and got["c"]["child"] > 0.9 and abs(got["few"]["male"] - 0.6) < 1e-9


def test_dynamics_and_tract(spark):
    df = spark.createDataFrame([("r", "F1", v) for v in (500.0, 600.0, 700.0)] + [("r", "F2", 1500.0), ("r", "F2", 1600.0)], "r string, formant string, hz double")
    v = X.formant_dynamics(df, ["r"]).first()["v"]
    assert len(v) == 12 and abs(v[0] - 600) < 1e-9 and v[2] == 200.0 and v[3:] == [0.0] * 9
    r = one(spark, X.tract_length(F.lit(2500.0), F.lit(3500.0)), X.tract_length(F.lit(0.0), F.lit(3500.0)))
    assert abs(r[0] - (17200 / 2500 + 17200 / 3500) / 2) < 1e-9 and r[1] == 0.0


def sine(f, n=1024, sr=16000):
    return np.sin(2 * np.pi * f * np.arange(n) / sr)


def test_signal_kernels():
    assert abs(K.autocorrelation_pitch(sine(200))[0] - 200) < 2 and K.autocorrelation_pitch(np.zeros(400)) == (0.0, 0.0)
    assert abs(np.argmax(K.magnitudes(sine(1000))) * 16000 / 2048 - 1000) < 8
    assert K.find_peaks(np.array([0, 2, 0, 3, 0, 1, 0.0]), 1.5).tolist() == [1, 3]
    assert K.find_peaks(np.array([0, 2, 0, 3, 0, 1, 0.0]), distance=3).tolist() == [3]
    assert K.find_peaks(np.array([0, 3, 2.5, 2.8, 0.0]), prominence=1).tolist() == [1]
    rng = np.random.default_rng(0)
    x = rng.standard_normal(4000)
    for i in range(2, len(x)):
        x[i] += 1.6 * np.cos(2 * np.pi * 1000 / 16000) * x[i - 1] - 0.64 * x[i - 2]
    a, _ = K.lpc(x, 2)
    assert abs(a[1] + 1.6 * np.cos(2 * np.pi * 1000 / 16000)) < 0.1 and abs(a[2] - 0.64) < 0.1
    r = 0.97
    f, b = K.formants_from_polynomial(np.array([1, -2 * r * np.cos(2 * np.pi * 700 / 16000), r * r]))[0]
    assert abs(f - 700) < 1e-6 and abs(b + math.log(r) * 16000 / math.pi) < 1e-6
    low = K.butterworth_bandpass(sine(50, 8000), 300, 3400)
    mid = K.butterworth_bandpass(sine(1000, 8000), 300, 3400)
    assert np.abs(low[1000:-1000]).max() < 0.05 and abs(np.abs(mid[1000:-1000]).max() - 1) < 0.05
    assert len(K.resample(sine(200, 800, 8000), 8000)) == 1600 and K.adaptive_order(x[:800], 4)[0] % 2 == 0
    assert np.array_equal(K.preprocess(x), K.preprocess(x)) and len(K.mfcc(K.magnitudes(x[:1024]) ** 2)) == 13
    q = [w[2] for w in K.lpc_windows(x[:400], 8)]
    assert q == sorted(q, reverse=True) and K.sinc_bank().shape == (64, 1024)
    assert abs(np.abs(K.enhance_speech(0.1 * sine(1000, 8000))).max() - 0.9) < 1e-9


def test_band_energy_of_a_sine(spark):
    df = spark.createDataFrame([("r", 0, sine(3000, 2048).tolist())], "r string, t int, frame array<double>")
    e = X.band_energies(K.spectrum(df, ["r", "t"]), ["r", "t"]).first()
    assert e["s_z"] > 10 * e["sh_zh"] and e["s_z"] > 10 * e["nasal1"]
    shape = X.spectral_shape(K.spectrum(df, ["r", "t"]), ["r", "t"]).first()
    assert abs(shape["centroid"] - 3000) < 60 and shape["flatness"] < 0.1


def test_self_comparison_is_one(spark):
    v = spark.createDataFrame([(1, i, [float(i + j) for j in range(4)]) for i in range(3)], "label int, seq int, v array<double>")
    s = Y.pair_stats(Y.all_pairs(v, v, ["label"]).where("i = j"), ["label"]).first()
    assert abs(s["min"] - 1) < 1e-12


def test_frames_of_zero_pitch_or_amplitude_are_no_voiced_frames(spark):
    from vocalith.operators import series as S

    rows = [("a", t, x) for t, x in enumerate((100.0, 0.0, 125.0, 100.0))] + [("z", 0, 0.0)]
    f = spark.createDataFrame(rows, "k string, t int, x double")
    j = {r["k"]: r for r in S.jitter(f, ["k"], ["t"], "x").collect()}
    assert set(j) == {"a"} and j["a"]["n"] == 3
    assert j["a"]["absolute"] == pytest.approx(2.0) and j["a"]["local"] == pytest.approx(100 * 0.002 / (0.028 / 3))
    s = {r["k"]: r for r in S.shimmer(f, ["k"], ["t"], "x").collect()}
    assert set(s) == {"a"} and s["a"]["db"] == pytest.approx(20 * np.log10(1.25))
    p = {r["k"]: r for r in S.semitone_jumps(f, ["k"], ["t"], "x").collect()}
    assert p["a"]["p95"] == pytest.approx(12 * np.log2(1.25)) and p["a"]["n"] == 3


def test_interval_is_student_s_beyond_400_scores(spark):
    from vocalith.functions.numbers import t_quantile
    from vocalith.operators import aggregates as A

    scores = [0.4 + 0.2 * (i % 2) for i in range(403)]
    got = A.confidence_interval(spark.createDataFrame([("a", x) for x in scores], "k string, score double"), ["k"]).first()
    half = t_quantile(402) * np.std(scores, ddof=1) / np.sqrt(403)
    assert got["ci_hi"] - got["ci_lo"] == pytest.approx(2 * half, rel=1e-9)


def test_silence_removed_joins_samples_once(spark):
    from vocalith.operators import features as X

    samples = spark.createDataFrame([("a", [float(i) for i in range(10)]), ("b", [1.0, 2.0])], "k string, amp array<double>")
    runs = spark.createDataFrame([("a", 0.6, 0.9), ("a", 0.1, 0.3)], "k string, start_s double, end_s double")
    got = {r["k"]: (r["kept"], r["removed_percent"]) for r in X.silence_removed(samples, runs, ["k"], 10).collect()}
    assert got["a"] == ([1.0, 2.0, 6.0, 7.0, 8.0], pytest.approx(50.0)) and got["b"] == ([], pytest.approx(100.0))


def _voice(n=400, sr=16000):
    """Damped resonances at 500, 1500 and 2500 Hz driven by pulses."""
    x = np.zeros(n)
    x[:: sr // 100] = 1.0
    for f, b in ((500, 80), (1500, 100), (2500, 120)):
        r = np.exp(-np.pi * b / sr)
        y = np.zeros(n)
        for i in range(n):
            y[i] = x[i] + 2 * r * np.cos(2 * np.pi * f / sr) * (y[i - 1] if i else 0) - r * r * (y[i - 2] if i > 1 else 0)
        x = y
    return x


def test_response_peaks_find_the_resonances(spark):
    x = _voice()
    frames = spark.createDataFrame([(1, [float(v) for v in x])], "k int, frame array<double>")
    got = {r["formant"]: r for r in K.response_formants(frames, ["k"], 12).collect()}
    for f, hz in (("F1", 500), ("F2", 1500)):
        assert abs(got[f]["freq_hz"] - hz) < 60 and 20 < got[f]["bandwidth_hz"] < 400
    roots = [f for f, _ in K.formants_from_polynomial(K.lpc(x * K.windows_of(len(x))["hamming"], 12)[0])]
    assert all(min(abs(r["freq_hz"] - f) for f in roots) < 40 for r in got.values())


def test_lpc_models_and_timbre_are_the_kernels(spark):
    x = [float(v) for v in _voice(256)]
    frames = spark.createDataFrame([(1, x, 3)], "k int, frame array<double>, peaks int")
    o = K.lpc_orders(frames, ["k"], "peaks").first()
    assert (o["order"], o["cost"]) == pytest.approx(K.adaptive_order(np.array(x), 3))
    ranks = K.lpc_window_ranks(frames, ["k"], 10).orderBy("rank").collect()
    assert [(r["window"], r["quality"]) for r in ranks] == [(n, pytest.approx(q)) for n, _, q in K.lpc_windows(np.array(x), 10)]
    c = [r["contrast"] for r in K.spectral_contrast(frames, ["k"], 512).orderBy("band").collect()]
    assert c == pytest.approx(K.contrast_of(K.magnitudes(np.array(x), 512), np.fft.rfftfreq(512, 1 / 16000))) and len(c) == 7
    m = [r["value"] for r in K.mfccs(frames, ["k"], 13, 512).orderBy("coefficient").collect()]
    assert m == pytest.approx(list(K.mfcc(K.magnitudes(np.array(x), 512) ** 2)))
