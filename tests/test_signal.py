"""Numeric kernels against plain versions, and their DataFrame forms."""

import numpy as np
import pytest

from vocalith.operators import recordings as C
from vocalith.operators import selection as L
from vocalith.operators import signal as K

SR = K.SAMPLE_RATE


def plain_burg(x, order):
    """The recursion as in a textbook, sample by sample."""
    a, f, b = [1.0], list(x), list(x)
    for _ in range(order):
        f, b = f[1:], b[:-1]
        power = sum(u * u + v * v for u, v in zip(f, b, strict=True))
        k = -2 * sum(u * v for u, v in zip(f, b, strict=True)) / power if power else 0.0
        padded = [*a, 0.0]
        a = [u + k * v for u, v in zip(padded, padded[::-1], strict=True)]
        f, b = [u + k * v for u, v in zip(f, b, strict=True)], [v + k * u for u, v in zip(f, b, strict=True)]
    return np.array(a)


def test_burg_against_plain_version_and_its_poles():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6, 60)).cumsum(axis=1)
    x[5] = 0
    got = K.burg(x, 10)
    for row, f in zip(got, x, strict=True):
        assert np.allclose(row, plain_burg(f, 10))
    short = K.burg(rng.normal(size=(200, 20)), 12)  # stable where the frame is hardly longer than the order
    assert (np.abs(K.roots_of(short)) < 1).all()
    assert np.allclose(np.sort_complex(K.roots_of(short[:1])[0]), np.sort_complex(np.roots(short[0])))
    assert K.burg(np.ones((2, 1)), 3).tolist() == [[1, 0, 0, 0]] * 2


def test_burg_finds_a_resonance_in_a_short_frame():
    x = np.cos(2 * np.pi * 700 / SR * np.arange(160) + 0.3)
    (f, width), *_ = K.formants_from_polynomial(K.lpc(x, 2)[0])
    assert abs(f - 700) < 7 and 0 < width < 20


def test_batched_formants_are_those_of_single_frames(spark):
    rng = np.random.default_rng(2)
    frames = [rng.normal(size=n).cumsum().tolist() for n in (400, 400, 300, 400, 300)]
    df = spark.createDataFrame(list(enumerate(frames)), "t int, frame array<double>")
    got = {}
    for r in K.lpc_formants(df, ["t"], 8).collect():
        got.setdefault(r["t"], []).append((r["freq_hz"], r["bandwidth_hz"]))
    for t, f in enumerate(frames):
        a = plain_burg(np.array(f) * K.windows_of(len(f))["hamming"], 8)
        assert np.allclose(sorted(got.get(t, [])), K.formants_from_polynomial(a), atol=1e-4)


def test_gate_follows_a_step_of_the_noise():
    rng = np.random.default_rng(4)
    n = SR * 8
    noise = rng.normal(size=n) * np.where(np.arange(n) < n // 2, 0.01, 0.1)
    t = np.arange(n) / SR
    burst = (np.floor(t * 2) % 4 == 1) * rng.normal(size=n)
    y = K.noise_gate(noise + burst)
    level = lambda x, a, b: np.sqrt(np.mean(x[int(a * SR) : int(b * SR)] ** 2))
    quiet = [(1.2, 1.9), (7.2, 7.9)]  # before and after the step, between the bursts
    turned = [level(y, *q) / level(noise, *q) for q in quiet]
    assert all(r < 0.5 for r in turned) and abs(turned[0] - turned[1]) < 0.15
    assert level(y, 4.6, 4.9) / level(burst, 4.6, 4.9) > 0.8
    assert len(y) == n and np.isfinite(y).all()
    assert K.noise_gate(np.zeros(4000)).tolist() == [0.0] * 4000 and K.noise_gate(np.ones(10)).tolist() == [1.0] * 10


def plain_peaks(x, height, distance, prominence):
    at = []
    for i in range(1, len(x) - 1):
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j + 1 < len(x) and x[j + 1] < x[i]:
            at.append((i + j) // 2)
    at = [i for i in at if x[i] >= height]
    kept = []
    for i in sorted(at, key=lambda i: (-x[i], -i)):
        if all(abs(i - j) >= distance for j in kept):
            kept.append(i)
    out = []
    for i in sorted(kept):
        left = max((j for j in range(i) if x[j] > x[i]), default=-1)
        right = min((j for j in range(i + 1, len(x)) if x[j] > x[i]), default=len(x))
        p = x[i] - max(min(x[left + 1 : i + 1]), min(x[i:right]))
        if p >= prominence:
            out.append((i, p))
    return out


def test_peaks_against_plain_version(spark):
    rng = np.random.default_rng(6)
    series = {k: rng.integers(0, 8, size=n).astype(float).tolist() for k, n in enumerate([40, 41, 3, 2, 1, 60])}
    rows = [(k, i, v) for k, x in series.items() for i, v in enumerate(x)] + [(7, 0, None), (0, 99, None)]
    df = spark.createDataFrame(rows, "k int, i int, x double").repartition(5)
    for height, distance, prominence in ((0.0, 1, 0.0), (3.0, 1, 0.0), (0.0, 4, 0.0), (1.0, 3, 2.0), (0.0, 1, 3.0)):
        got = {(r["k"], r["i"], r["x"], r["prominence"]) for r in K.peaks(df, ["k"], "i", "x", height, distance, prominence).collect()}
        assert got == {(k, i, x[i], p) for k, x in series.items() for i, p in plain_peaks(x, height, distance, prominence)}
    x = np.array(series[5])
    for i in range(60):
        left = max((j for j in range(i) if x[j] > x[i]), default=-1)
        right = min((j for j in range(i + 1, 60) if x[j] > x[i]), default=60)
        assert K.prominences(x)[i] == x[i] - max(x[left + 1 : i + 1].min(), x[i:right].min())


def test_remove_silence(spark):
    tone = np.sin(2 * np.pi * 200 * np.arange(SR) / SR)
    gap = np.zeros(SR)
    x = np.concatenate([gap, tone, gap[: SR // 5], tone, gap, tone[: SR // 50], gap])
    rows = [("a", x.tolist()), ("quiet", np.zeros(SR).tolist()), ("short", [0.5] * 100), ("none", [])]
    got = {r["r"]: r for r in C.remove_silence(spark.createDataFrame(rows, "r string, amp array<double>"), ["r"], SR).collect()}
    assert abs(len(got["a"]["kept"]) - 2.2 * SR) < 0.06 * SR  # the short gap stays, the long ones and the click go
    assert abs(got["a"]["removed_percent"] - 100 * (1 - len(got["a"]["kept"]) / len(x))) < 1e-9
    assert len(got["quiet"]["kept"]) == SR and got["quiet"]["removed_percent"] == 0
    assert len(got["short"]["kept"]) == 100 and got["none"]["kept"] == []


def test_prepared_segments(spark):
    rows = [("a", float(i), s, v) for i, (s, v) in enumerate([(0.9, 0.1), (1.0, 0.0), (0.2, 1.0), (0.5, 0.5), (0.6, 0.6), (0.0, 0.0), (0.3, 0.3)])] + [("b", 0.0, 0.1, 0.1)]
    got = L.prepared_segments(spark.createDataFrame(rows, "r string, s double, speech_ratio double, voiced_ratio double"), ["r"], "s", 4.0, k=3).orderBy("r", "seg_no").collect()
    # scores .58 .6 .52 .5 .6 0 .3: windows 1 and 4 (3 apart, one second in common), then the best of the rest
    assert [(x["r"], x["s"], x["seg_no"], x["filled"]) for x in got] == [("a", 0.0, 1, True), ("a", 1.0, 2, False), ("a", 4.0, 3, False), ("b", 0.0, 1, False)]
    assert got[0]["score"] == pytest.approx(0.58)


def test_mel_scale_and_decibels(spark):
    assert K.mel_of([0, 1000, 6400]).tolist() == pytest.approx([0, 15, 42]) and K.hz_of(K.mel_of([30, 999, 1001, 7000])).tolist() == pytest.approx([30, 999, 1001, 7000])
    bank = K.mel_filters(2048, SR, 128, 50.0, 8000.0)
    width = SR / 2048
    assert bank.shape == (128, 1025) and abs(bank[100].sum() * width - 1) < 0.05  # unit area
    t = np.arange(2048) / SR
    rows = [("a", 0, np.sin(2 * np.pi * 1000 * t).tolist()), ("a", 1, (0.1 * np.sin(2 * np.pi * 1000 * t)).tolist()), ("b", 0, [0.0] * 2048)]
    df = spark.createDataFrame(rows, "r string, t int, frame array<double>")
    got = {(r["r"], r["t"], r["bin"]): r["db"] for r in K.mel_decibels(df, ["r"], "t").collect()}
    power = [bank @ K.magnitudes(np.array(f), 2048) ** 2 for _, _, f in rows[:2]]
    for k in (0, 1):
        want = np.maximum(10 * np.log10(np.maximum(power[k], 1e-10)) - 10 * np.log10(power[0].max()), -80)
        assert [got["a", k, i] for i in range(128)] == pytest.approx(want.tolist())
    assert max(got["a", 1, i] for i in range(128)) == pytest.approx(-20) and all(got["b", 0, i] == 0 for i in range(128))
