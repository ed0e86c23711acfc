"""Speech activity of frames, and scores of windows by a small recurrent network with given weights.

Activity: each frame's log energies in a few bands are found in Arrow batches over frames. The frames of a recording then
pass in order through one task, which keeps two normal distributions a band, of noise and of speech, that follow
the recording; the weighted sum of the bands' log likelihood ratios decides, and speech hangs over for some frames.
The state is a few numbers a band, whatever the length of the recording.

Network: band-pass filters with a stride, rectifier, two recurrent layers in both directions, mean over time, two dense layers. Weights
come as a table, windows are scored in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .signal import SAMPLE_RATE, hann, sinc_bank

#: Bands in Hz and their weights in the decision: speech is told best by the middle ones.
BANDS = ((80, 250, 6.0), (250, 500, 8.0), (500, 1000, 10.0), (1000, 2000, 12.0), (2000, 3000, 14.0), (3000, 4000, 16.0))


@dataclass
class Activity:
    """The state of a recording. ``step`` takes a frame's band levels (natural logarithms) and tells whether it is speech."""

    threshold: float = 1.0  # of the weighted mean of log likelihood ratios
    one_band: float = 6.0  # or of a single band
    hang: int = 3  # frames after speech that still count, once speech has lasted as long
    follow: tuple[float, float] = (0.05, 0.02)  # how fast noise and speech follow
    apart: float = 1.5  # least distance of the two means
    noise: np.ndarray | None = None
    speech: np.ndarray = field(default_factory=lambda: np.zeros(0))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    weights: np.ndarray = field(default_factory=lambda: np.array([b[2] for b in BANDS]) / sum(b[2] for b in BANDS))
    lasted: int = 0
    left: int = 0

    def step(self, level: np.ndarray) -> bool:
        if self.noise is None:
            self.noise, self.speech, self.spread = level.copy(), level + 4.0, np.ones((2, len(level)))
        n, s = ((level - self.noise) / self.spread[0]), ((level - self.speech) / self.spread[1])
        # beyond the mean of speech a frame is no less speech, below that of noise no less noise
        ratio = (np.maximum(n, 0) ** 2 - np.minimum(s, 0) ** 2) / 2 + np.log(self.spread[0] / self.spread[1])
        told = float(self.weights @ ratio) > self.threshold or float(ratio.max()) > self.one_band
        k, mean = (1, self.speech) if told else (0, self.noise)
        mean += self.follow[k] * (level - mean)
        self.spread[k] = np.clip(np.sqrt((1 - self.follow[k]) * self.spread[k] ** 2 + self.follow[k] * (level - mean) ** 2), 0.5, 2.5)
        # levels under the noise are noise at once; what is loud for long becomes it, slowly
        self.noise = np.where(level < self.noise, self.noise + 0.3 * (level - self.noise), self.noise + 0.003 * np.clip(level - self.noise, 0, 3))
        self.speech = np.maximum(self.speech, self.noise + self.apart)
        self.lasted = self.lasted + 1 if told else 0
        if told:
            self.left = self.hang if self.lasted >= self.hang else self.left
            return True
        self.left -= self.left > 0
        return self.left > 0


def band_levels(frames: np.ndarray, sr: int = SAMPLE_RATE) -> np.ndarray:
    """Log of the mean power of each band, a row for each frame."""
    n = frames.shape[1]
    power = np.abs(np.fft.rfft(frames * hann(n), axis=1)) ** 2 / n
    f = np.fft.rfftfreq(n, 1 / sr)
    return np.log(np.stack([power[:, (f >= lo) & (f < hi)].sum(axis=1) for lo, hi, _ in BANDS], axis=1) + 1e-10)


def speech_frames(frames: DataFrame, by: str, t: str, frame: str = "frame", sr: int = SAMPLE_RATE, **how) -> DataFrame:
    """Frame rows (by, t, frame of about 30 ms) -> rows (by, t, is_speech). A null or empty frame is no speech and
    changes nothing; rows of a null ``by`` are one recording. ``how``: fields of ``Activity``."""
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (by, t)}

    @F.pandas_udf("array<double>")
    def levels(x: pd.Series) -> pd.Series:
        out: list = [None] * len(x)
        sizes = x.map(lambda v: 0 if v is None else len(v)).to_numpy()
        for size in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == size)
            for i, row in zip(at, band_levels(np.stack(x.iloc[at].to_numpy()).astype(float), sr), strict=True):
                out[i] = row
        return pd.Series(out)

    rows = frames.select(by, t, levels(frame).alias("levels")).repartition(by).sortWithinPartitions(by, t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, own = Activity(**how), object()
        for b in batches:
            told = []
            for r, level in zip(b[by], b["levels"], strict=True):
                r = None if pd.isna(r) else r
                if r != own:
                    state, own = Activity(**how), r
                told.append(level is not None and state.step(np.array(level, dtype=float)))
            yield pd.DataFrame({by: b[by], t: b[t], "is_speech": told})

    return rows.mapInPandas(run, f"`{by}` {kinds[by]}, `{t}` {kinds[t]}, is_speech boolean")


def filtered(windows: np.ndarray, bank: np.ndarray, stride: int = 256) -> np.ndarray:
    """(windows, steps, filters): each filter at every ``stride`` samples, rectified."""
    at = np.lib.stride_tricks.sliding_window_view(windows, bank.shape[1], axis=1)[:, ::stride]
    return np.maximum(at @ bank.T, 0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def recurrent(x: np.ndarray, w: dict[str, np.ndarray], name: str, backwards: bool) -> np.ndarray:
    """A gated recurrent layer over (windows, steps, inputs), all windows at once; gates in the order reset, update, new."""
    inputs = x @ w[f"{name}.input"].T + w[f"{name}.input_bias"]
    size = inputs.shape[2] // 3
    h, out = np.zeros((len(x), size)), np.empty((len(x), x.shape[1], size))
    for k in range(x.shape[1] - 1, -1, -1) if backwards else range(x.shape[1]):
        i, own = inputs[:, k], h @ w[f"{name}.state"].T + w[f"{name}.state_bias"]
        reset, update = _sigmoid(i[:, :size] + own[:, :size]), _sigmoid(i[:, size : 2 * size] + own[:, size : 2 * size])
        new = np.tanh(i[:, 2 * size :] + reset * own[:, 2 * size :])
        h = (1 - update) * new + update * h
        out[:, k] = h
    return out


def network(windows: np.ndarray, w: dict[str, np.ndarray], bank: np.ndarray, stride: int = 256) -> np.ndarray:
    """Probability of the second class for each window."""
    x = filtered(windows, bank, stride)
    for layer in (0, 1):
        x = np.concatenate([recurrent(x, w, f"layer{layer}.{way}", way == "backward") for way in ("forward", "backward")], axis=2)
    x = np.maximum(x.mean(axis=1) @ w["dense0"].T + w["dense0_bias"], 0.0)
    x = x @ w["dense1"].T + w["dense1_bias"]
    return _sigmoid(x[:, 1] - x[:, 0])


#: Numbers that a table of weights may hold: it is sent to all executors.
_MOST_WEIGHTS = 1 << 24


def spoof_probabilities(windows: DataFrame, keys: list[str], weights: DataFrame, frame: str = "frame", filters: int = 64, kernel: int = 1024, stride: int = 256, sr: int = SAMPLE_RATE) -> DataFrame:
    """Window rows (keys, frame) -> (keys, p). ``weights``: rows (name, shape array<int>, data array<float>).

    A null window, or one shorter than the kernel, has p null. For ``rules.spoof_summary``."""
    numbers = weights.agg(F.sum(F.size("data"))).first()[0] or 0
    if numbers > _MOST_WEIGHTS:
        raise ValueError(f"{numbers} weights: more than {_MOST_WEIGHTS}")
    w = {r["name"]: np.array(r["data"], dtype=float).reshape(r["shape"]) for r in weights.collect()}
    shared, bank = windows.sparkSession.sparkContext.broadcast(w), sinc_bank(filters, kernel, sr)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        out = np.full(len(x), np.nan)
        sizes = x.map(lambda v: 0 if v is None else len(v)).to_numpy()
        for size in np.unique(sizes[sizes >= kernel]):
            at = np.flatnonzero(sizes == size)
            for a in range(0, len(at), 32):  # windows at a time
                some = at[a : a + 32]
                out[some] = network(np.stack(x.iloc[some].to_numpy()).astype(float), shared.value, bank, stride)
        return pd.Series(out)

    return windows.select(*keys, run(frame).alias("p"))
