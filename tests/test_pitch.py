"""Pitch trackers against plain versions and known tones."""

import numpy as np
import pytest

from vocalith.operators import pitch as P

SR = 8000
STATES = P.Pitches(50.0, 400.0, SR, 0.02, 4)


def tone(hz, harmonics=6):
    """Samples of a voice with the pitch ``hz`` at each sample."""
    phase = 2 * np.pi * np.cumsum(hz) / SR
    return sum(np.sin(k * phase) / k for k in range(1, harmonics))


def frames_of(x, size=512, hop=160):
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def plain_path(lists, p):
    """The best path by the full table of all states and moves."""
    n = p.n
    move = np.kron(np.array([[1 - p.switch, p.switch], [p.switch, 1 - p.switch]]), np.exp(p.moves()))
    with np.errstate(divide="ignore"):
        move = np.log(move)
        seen = []
        for states, mass in lists:
            v = np.zeros(2 * n)
            v[states] = mass
            v[n:] = (1 - min(1.0, mass.sum())) / n
            seen.append(np.log(v))
    best, back = seen[0] - np.log(2 * n), []
    for s in seen[1:]:
        x = best[:, None] + move
        back.append(x.argmax(axis=0))
        best = x.max(axis=0) + s
    path, score = [int(best.argmax())], best.max()
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1], score


def score_of(path, lists, p):
    n = p.n
    with np.errstate(divide="ignore"):
        move = np.log(np.kron(np.array([[1 - p.switch, p.switch], [p.switch, 1 - p.switch]]), np.exp(p.moves())))
        total = -np.log(2 * n)
        for k, (s, (states, mass)) in enumerate(zip(path, lists, strict=True)):
            v = np.zeros(2 * n)
            v[states] = mass
            v[n:] = (1 - min(1.0, mass.sum())) / n
            total += np.log(v[s]) + (move[path[k - 1], s] if k else 0.0)
    return total


@pytest.mark.parametrize("every", [1, 7, 1000])
def test_search_is_the_best_path(every):
    p = P.Pitches(100.0, 200.0, SR, 0.02, 2)
    rng = np.random.default_rng(every)
    lists = []
    for i in range(120):
        k = rng.integers(0, 4)
        states = np.sort(rng.choice(p.n, size=k, replace=False))
        lists.append((states, rng.dirichlet(np.ones(k)) * rng.uniform(0, 0.99) if k else np.zeros(0)))
        if i % 9 == 4:  # no doubt about these
            lists[-1] = (np.array([12 + i % 3]), np.array([0.9999]))
    search, got = P.Search(p, every=every), []
    longest = 0
    for s, m in lists:
        got += search.step(s, m)
        longest = max(longest, len(search.back))
    got += search.end()
    path = [int(round(12 * p.per_semitone * np.log2(hz / p.low))) + (0 if voiced else p.n) for hz, voiced, _ in got]
    assert score_of(path, lists, p) == pytest.approx(plain_path(lists, p)[1], abs=1e-8)
    assert every > 100 or longest < 120  # frames leave before the end


def test_silence_needs_no_memory():
    p, search = P.Pitches(100.0, 200.0, SR, 0.02, 2), P.Search(P.Pitches(100.0, 200.0, SR, 0.02, 2))
    for _ in range(3):
        search.step(np.array([5]), np.array([0.99]))
    for _ in range(2000):
        search.step(np.zeros(0, dtype=int), np.zeros(0))
    assert len({id(b) for b in search.back}) < 100 and p.n > 5
    assert len(search.back) + 0 <= 2003 and [v for _, v, _ in search.end()].count(True) <= 3


def test_differences_against_their_definition():
    x = np.random.default_rng(0).normal(size=(3, 200))
    got = P.normalised_differences(x, 60)
    for row, f in zip(got, x, strict=True):
        d = np.array([np.sum((f[:140] - f[lag : lag + 140]) ** 2) for lag in range(61)])
        want = [1.0] + [d[lag] * lag / d[1 : lag + 1].sum() for lag in range(1, 61)]
        assert np.allclose(row, want)
    assert (P.normalised_differences(np.zeros((1, 200)), 60) == 1).all()


def test_glide_and_octave_jump(spark):
    n = SR * 2
    glide = 100 * 2 ** (np.arange(n) / n)
    jump = np.where(np.arange(n) < n // 2, 110.0, 220.0)
    noise = np.random.default_rng(3).normal(size=SR)
    rows = []
    for rec, x in (("glide", tone(glide)), ("jump", tone(jump)), ("noise", noise), ("silence", np.zeros(SR)), ("short", np.ones(100))):
        rows += [(rec, t, f.tolist()) for t, f in enumerate(frames_of(x) if len(x) > 512 else [x])]
    rows.append((None, 0, None))
    df = spark.createDataFrame(rows, "rec string, t int, frame array<double>").repartition(7)
    got = {}
    for r in P.probabilistic_yin(df, "rec", "t", P.Pitches(50.0, 400.0, SR, 0.02)).collect():
        got.setdefault(r["rec"], {})[r["t"]] = r
    assert sum(len(x) for x in got.values()) == len(rows)
    for rec, hz in (("glide", glide), ("jump", jump)):
        size, right = 512, []
        for t, r in got[rec].items():
            span = hz[t * 160 : t * 160 + size]
            if span.max() / span.min() < 1.1:  # not across the jump
                right.append(r["voiced"] and abs(r["pitch_hz"] / span[: size // 2].mean() - 1) < 0.01 * (1 if rec == "jump" else 2))
        assert np.mean(right) > 0.97, rec
    assert np.mean([r["voiced"] for r in got["noise"].values()]) < 0.1
    assert not any(r["voiced"] for k in ("silence", "short", None) for r in got[k].values())
    assert all(0 <= r["voiced_prob"] <= 1 for x in got.values() for r in x.values())


def test_spectral_peaks(spark):
    """Against a plain version, frame by frame; places of pure tones are found between the bins."""
    rng = np.random.default_rng(5)
    step, rows, want = 10.0, [], {}
    for f in range(30):
        mag = rng.uniform(0, 1, size=60)
        if f < 10:
            x = np.sin(2 * np.pi * (120.3 + 7 * f) * np.arange(1024) / SR)
            mag = np.abs(np.fft.rfft(x * np.hanning(1024), 1024))[:60]
        if f == 29:
            mag = np.zeros(60)
        rows += [(f, i, float(v)) for i, v in enumerate(mag)]
        width = SR / 1024 if f < 10 else step
        best = (0.0, 0.0)
        m = np.where(mag > 0.1 * mag.max(), mag, 0)
        for i in range(1, 60):
            if not (50 <= i * step < 400) or not (m[i] > m[i - 1] and (i == 59 or m[i] >= m[i + 1])):
                continue
            a, b, c = mag[i - 1], mag[i], mag[i + 1]
            slope, curve = (c - a) / 2, 2 * b - a - c
            shift = slope / (curve + (abs(curve) < 1e-300))
            if b + slope * shift / 2 > best[1]:
                best = ((i + shift) * step, b + slope * shift / 2)
        want[f] = best
        if f < 10:
            assert abs(best[0] / step * width - (120.3 + 7 * f)) < 2
    got = P.spectral_peak_pitch(spark.createDataFrame(rows, "f int, bin int, mag double"), ["f"], step).collect()
    assert len(got) == 30 and all((r["pitch_hz"], r["pitch_mag"]) == pytest.approx(want[r["f"]]) for r in got)
