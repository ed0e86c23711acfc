"""Speech activity on made recordings, and the network against loops over single numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vocalith.operators import activity as V
from vocalith.operators import rules as R
from vocalith.operators import series as S
from vocalith.operators.signal import SAMPLE_RATE as SR
from vocalith.operators.signal import sinc_bank

N = 480


def recording(spans, seconds, noise, seed=0):
    """Voice-like bursts in noise, and for each frame whether it lies in a burst (None at an edge)."""
    rng = np.random.default_rng(seed)
    n = int(SR * seconds)
    t = np.arange(n) / SR
    level = noise(t) if callable(noise) else noise
    on = np.zeros(n, dtype=bool)
    for a, b in spans:
        on[int(a * SR) : int(b * SR)] = True
    voice = sum(np.sin(2 * np.pi * 140 * k * t) / k for k in range(1, 25)) * 0.2
    x = rng.normal(size=n) * level + voice * on
    frames = x[: n // N * N].reshape(-1, N)
    share = on[: n // N * N].reshape(-1, N).mean(axis=1)
    return frames, [None if 0 < s < 1 else bool(s == 1) for s in share]


def told(spark, recordings, partitions=3, **how):
    rows = [(rec, t, f.tolist()) for rec, frames in recordings.items() for t, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "rec string, t int, frame array<double>").repartition(partitions)
    out = {}
    for r in V.speech_frames(df, "rec", "t", **how).collect():
        out.setdefault(r["rec"], {})[r["t"]] = r["is_speech"]
    return {rec: [x[i] for i in range(len(x))] for rec, x in out.items()}


def test_bursts_in_noise(spark):
    spans = [(1.0, 2.0), (2.6, 3.1), (4.0, 5.5)]
    made = {
        "quiet": recording(spans, 7, 0.003),
        "loud": recording(spans, 7, 0.05, 1),
        "rising": recording([(1.0, 2.0), (6.0, 7.0), (10.0, 11.0)], 13, lambda t: 0.003 * 10 ** (t / 13), 2),
        "noise": recording([], 5, 0.05, 3),
    }
    got = told(spark, {k: v[0] for k, v in made.items()})
    for rec, (_, want) in made.items():
        speech = [g for g, w in zip(got[rec], want, strict=True) if w is True]
        rest = [g for g, w in zip(got[rec], want, strict=True) if w is False]
        assert (not speech or np.mean(speech) > 0.95) and np.mean(rest) < 0.15, (rec, np.mean(speech or [1]), np.mean(rest))


def test_order_and_batches_do_not_matter(spark):
    frames, _ = recording([(0.5, 1.2)], 2, 0.01)
    levels, state = V.band_levels(frames), V.Activity()
    want = [state.step(x.copy()) for x in levels]
    assert told(spark, {"a": frames, "b": frames}, 5) == {"a": want, "b": want}
    assert told(spark, {"a": frames}, 1) == {"a": want}


def test_hang_over_and_awkward_frames(spark):
    frames, want = recording([(0.6, 1.2)], 2, 0.005)
    long = told(spark, {"a": frames}, hang=12)["a"]
    short = told(spark, {"a": frames}, hang=1)["a"]
    last = max(i for i, w in enumerate(want) if w)
    assert all(long[last + 2 : last + 8]) and not any(short[last + 3 : last + 8])
    df = spark.createDataFrame([(None, 0, None), (None, 1, []), ("z", 0, [0.0] * N), ("z", 1, [0.0] * N)], "rec string, t int, frame array<double>")
    rows = V.speech_frames(df, "rec", "t").collect()
    assert len(rows) == 4 and not any(r["is_speech"] for r in rows)
    flags = spark.createDataFrame([("a", i, bool(x)) for i, x in enumerate(long)], "rec string, t int, is_speech boolean")
    assert S.is_voiced(flags, ["rec"]).first()["is_voiced"]


def weights(rng, inputs=8, size=3, dense=4):
    w, wide = {}, inputs
    for layer in (0, 1):
        for way in ("forward", "backward"):
            name = f"layer{layer}.{way}"
            w |= {f"{name}.input": rng.normal(size=(3 * size, wide)), f"{name}.state": rng.normal(size=(3 * size, size)), f"{name}.input_bias": rng.normal(size=3 * size), f"{name}.state_bias": rng.normal(size=3 * size)}
        wide = 2 * size
    return w | {"dense0": rng.normal(size=(dense, 2 * size)), "dense0_bias": rng.normal(size=dense), "dense1": rng.normal(size=(2, dense)), "dense1_bias": rng.normal(size=2)}


def plain_network(x, w, bank, stride):
    """One window, one number at a time."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    steps = [[max(0.0, sum(b * x[a + i] for i, b in enumerate(f))) for f in bank] for a in range(0, len(x) - len(bank[0]) + 1, stride)]
    for layer in (0, 1):
        both = []
        for way in ("forward", "backward"):
            wi, ws, bi, bs = (w[f"layer{layer}.{way}.{p}"] for p in ("input", "state", "input_bias", "state_bias"))
            size = len(wi) // 3
            h, out = [0.0] * size, []
            for s in steps if way == "forward" else steps[::-1]:
                i = [sum(a * b for a, b in zip(row, s, strict=True)) + c for row, c in zip(wi, bi, strict=True)]
                o = [sum(a * b for a, b in zip(row, h, strict=True)) + c for row, c in zip(ws, bs, strict=True)]
                r, z = [sig(i[k] + o[k]) for k in range(size)], [sig(i[size + k] + o[size + k]) for k in range(size)]
                n = [np.tanh(i[2 * size + k] + r[k] * o[2 * size + k]) for k in range(size)]
                h = [(1 - z[k]) * n[k] + z[k] * h[k] for k in range(size)]
                out.append(h)
            both.append(out if way == "forward" else out[::-1])
        steps = [a + b for a, b in zip(*both, strict=True)]
    x = [sum(s[k] for s in steps) / len(steps) for k in range(len(steps[0]))]
    x = [max(0.0, sum(a * b for a, b in zip(row, x, strict=True)) + c) for row, c in zip(w["dense0"], w["dense0_bias"], strict=True)]
    x = [sum(a * b for a, b in zip(row, x, strict=True)) + c for row, c in zip(w["dense1"], w["dense1_bias"], strict=True)]
    return float(np.exp(x[1]) / (np.exp(x[0]) + np.exp(x[1])))


def test_network_against_loops(spark):
    rng = np.random.default_rng(7)
    w, bank = weights(rng), sinc_bank(8, 32, SR)
    x = [rng.normal(size=n) for n in (100, 100, 120, 100)]
    want = [plain_network(v, w, bank, 16) for v in x]
    table = spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in w.items()], "name string, shape array<int>, data array<double>")
    rows = [("r", i, v.tolist()) for i, v in enumerate(x)] + [("r", 9, [0.1] * 31), ("r", 10, None)]
    df = spark.createDataFrame(rows, "rec string, window int, frame array<double>")
    probs = V.spoof_probabilities(df, ["rec", "window"], table, filters=8, kernel=32, stride=16)
    got = {r["window"]: r["p"] for r in probs.collect()}
    assert [got[i] for i in range(4)] == pytest.approx(want, abs=1e-9) and got[9] is None and got[10] is None
    chosen = S.even_subsample(probs.where("p is not null"), ["rec"], ["window"], 3)  # the first, the second, the last
    s = R.spoof_summary(chosen, ["rec"]).first()
    assert s["windows"] == 3 and s["mean"] == pytest.approx(np.mean([want[0], want[1], want[3]]))
    with pytest.raises(ValueError, match="weights"):
        V.spoof_probabilities(df, ["rec"], spark.createDataFrame([("w", [0.0] * 9)], "name string, data array<double>").withColumn("data", F.array_repeat(F.lit(0.0), 1 << 25)))
