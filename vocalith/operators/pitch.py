"""Pitch trackers: spectral peaks as window expressions, and probabilistic YIN with a streamed Viterbi search.

Spectral peaks need nothing but the spectrum table. Probabilistic YIN works in two steps. Each frame, on its own,
becomes a short list of candidates (a pitch state and its probability), in Arrow batches over frames. The candidates
of a recording then pass in order of time through one task that searches the best path over pitch states; it keeps the
best predecessors of those frames only that are not decided yet, that is, for which the best paths to all states still
differ, and hands out frames once they agree. So the path is that of a search over the whole recording, while
memory does not grow with its length as long as paths meet. In silence they do not, but there the predecessors soon
are the same from frame to frame, and are kept once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, floor, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signal import SAMPLE_RATE


def spectral_peak_pitch(spectrum: DataFrame, keys: list[str], step_hz: float, low: float = 50.0, high: float = 400.0, share: float = 0.1) -> DataFrame:
    """Rows (keys, bin, mag), bins ``step_hz`` apart -> (keys, pitch_hz, pitch_mag): the highest peak of each frame.

    A peak is a bin from ``low`` to under ``high`` above ``share`` of the frame's largest magnitude, above the bin before and not
    under the bin after; its place and height are those of the parabola through the three bins. The lowest of
    equals counts; a frame without a peak has zeros.
    """
    w = Window.partitionBy(*keys).orderBy("bin")
    whole = Window.partitionBy(*keys)
    rows = spectrum.select(*keys, "bin", F.col("mag").cast("double").alias("mag")).withColumns(
        {"_a": F.lag("mag").over(w), "_b": F.lead("mag").over(w), "_m": F.when(F.col("mag") > F.lit(float(share)) * F.max("mag").over(whole), F.col("mag")).otherwise(0.0)}
    )
    rows = rows.withColumns({"_ma": F.lag("_m").over(w), "_mb": F.lead("_m").over(w)})
    slope, curve = (F.col("_b") - F.col("_a")) / 2, F.lit(2.0) * F.col("mag") - F.col("_a") - F.col("_b")
    shift = F.coalesce(slope / F.when(F.abs(curve) < 1e-300, curve + 1.0).otherwise(curve), F.lit(0.0))
    hz = F.col("bin") * F.lit(float(step_hz))
    peak = (hz >= low) & (hz < high) & (F.col("_m") > F.col("_ma")) & (F.col("_m") >= F.coalesce("_mb", F.col("_m")))
    rows = rows.withColumns({"_hz": (F.col("bin") + shift) * F.lit(float(step_hz)), "_top": F.col("mag") + F.coalesce(slope, F.lit(0.0)) * shift / 2, "_peak": peak})
    best = F.max(F.when(F.col("_peak") & (F.col("_top") > 0), F.struct(F.col("_top"), -F.col("bin"), F.col("_hz"))))
    got = rows.groupBy(*keys).agg(best.alias("_p"))
    return got.select(*keys, F.coalesce("_p._hz", F.lit(0.0)).alias("pitch_hz"), F.coalesce("_p._top", F.lit(0.0)).alias("pitch_mag"))


def normalised_differences(frames: np.ndarray, longest: int) -> np.ndarray:
    """Cumulative mean normalised difference of each frame (rows) at the lags 0 to ``longest``, over half a frame."""
    n, size = frames.shape
    window = size - longest
    full = 1 << (size + window - 1).bit_length()
    spectrum = np.fft.rfft(frames, full, axis=1) * np.conj(np.fft.rfft(frames[:, :window], full, axis=1))
    match = np.fft.irfft(spectrum, full, axis=1)[:, : longest + 1]
    energy = np.concatenate([np.zeros((n, 1)), np.cumsum(frames**2, axis=1)], axis=1)
    own = energy[:, window : window + longest + 1] - energy[:, : longest + 1]
    d = np.maximum(0.0, own[:, :1] + own - 2 * match)
    mean = np.cumsum(d[:, 1:], axis=1) / np.arange(1, longest + 1)
    out = np.ones_like(d)
    np.divide(d[:, 1:], mean, out=out[:, 1:], where=mean > 1e-12 * (1 + own[:, :1]))
    return out


@dataclass(frozen=True)
class Pitches:
    """The states of a search: pitches ``per_semitone`` to a semitone from ``low`` to ``high`` Hz, voiced and not."""

    low: float = 50.0
    high: float = 400.0
    sr: int = SAMPLE_RATE
    step_s: float = 0.01
    per_semitone: int = 10
    #: Octaves a second that a pitch moves at most, and the probability to change voicing.
    octaves_a_second: float = 35.92
    switch: float = 0.01

    @property
    def n(self) -> int:
        return floor(12 * self.per_semitone * log2(self.high / self.low)) + 1

    @property
    def reach(self) -> int:
        """States up or down that the pitch moves from frame to frame."""
        return max(1, floor(self.octaves_a_second * 12 * self.step_s) * self.per_semitone // 2)

    def hz(self, state):
        return self.low * 2.0 ** (np.asarray(state) / (12 * self.per_semitone))

    def moves(self) -> np.ndarray:
        """Log probability of moving from state to state (columns: to), triangular, each row summing to 1."""
        i = np.arange(self.n)
        p = np.maximum(0.0, 1 - np.abs(i[:, None] - i[None]) / (self.reach + 1))
        with np.errstate(divide="ignore"):
            return np.log(p / p.sum(axis=1, keepdims=True))


#: Thresholds and the parameters of their distribution (beta), the preference for the first trough, the
#: probability of the deepest lag where no trough is under the threshold.
_THRESHOLDS, _BETA, _FIRST, _NO_TROUGH = 100, (2, 18), 2.0, 0.01


def _threshold_weights() -> np.ndarray:
    """The share of the beta distribution between neighbouring thresholds, by its sum of binomial terms."""
    a, b = _BETA
    x = np.linspace(0, 1, _THRESHOLDS + 1)
    n = a + b - 1
    terms, c = np.zeros_like(x), 1.0
    for j in range(n + 1):
        if j >= a:
            terms += c * x**j * (1 - x) ** (n - j)
        c = c * (n - j) / (j + 1)
    return np.diff(terms)


def candidates(frames: np.ndarray, p: Pitches) -> list[tuple[np.ndarray, np.ndarray]]:
    """(states, probabilities) of the pitch candidates of each frame; several candidates of one state are added."""
    first, last = max(2, floor(p.sr / p.high)), ceil(p.sr / p.low)
    d = normalised_differences(frames, last + 1)
    weights, limits = _threshold_weights(), np.linspace(0, 1, _THRESHOLDS + 1)[1:]
    out = []
    for row, frame in zip(d, frames, strict=True):
        near = row[first : last + 1]
        trough = (near < row[first - 1 : last]) & (near <= row[first + 1 : last + 2])
        at = np.flatnonzero(trough)
        if not len(at) or not frame.any():
            out.append((np.zeros(0, dtype=int), np.zeros(0)))
            continue
        under = near[at][:, None] < limits[None]  # trough, threshold
        count = under.sum(axis=0)
        rank = np.cumsum(under, axis=0) - 1
        prior = np.where(under, np.exp(-_FIRST * rank), 0.0) * (1 - np.exp(-_FIRST)) / np.maximum(1e-300, 1 - np.exp(-_FIRST * np.maximum(count, 1)))
        mass = prior @ weights
        mass[np.argmin(near[at])] += _NO_TROUGH * weights[count == 0].sum()
        lag = at + first
        a, b, c = row[lag - 1], row[lag], row[lag + 1]
        curve = a + c - 2 * b
        shift = np.where(curve > 0, (a - c) / 2 / np.where(curve > 0, curve, 1.0), 0.0)
        state = np.rint(12 * p.per_semitone * np.log2(p.sr / (lag + np.clip(shift, -1, 1)) / p.low)).astype(int)
        keep = (mass > 0) & (state >= 0) & (state < p.n)
        states, where = np.unique(state[keep], return_inverse=True)
        out.append((states, np.bincount(where, mass[keep], len(states))))
    return out


@dataclass
class Search:
    """The best path over frames given one by one: ``step`` returns the frames decided by it, ``end`` the rest."""

    p: Pitches
    best: np.ndarray | None = None
    back: list[np.ndarray] = field(default_factory=list)
    waiting: list[float] = field(default_factory=list)
    every: int = 64
    _look: int = 0
    _moves: np.ndarray | None = None

    def step(self, states: np.ndarray, mass: np.ndarray) -> list[tuple[float, bool, float]]:
        n, voiced = self.p.n, float(min(1.0, mass.sum()))
        with np.errstate(divide="ignore"):
            seen = np.full(2 * n, -np.inf)
            seen[states] = np.log(mass)
            seen[n:] = np.log((1 - voiced) / n)
            if not np.isfinite(seen).any():
                seen[n:] = -700.0
        if self.best is None:
            self.best, before = seen - np.log(2 * n), np.arange(2 * n, dtype=np.int32)
        else:
            before, value = self._moved()
            self.best = value + seen
        self.best -= self.best.max()
        same = self.back and np.array_equal(before, self.back[-1])
        self.back.append(self.back[-1] if same else before)
        self.waiting.append(voiced)
        if len(self.back) < max(self.every, self._look):
            return []
        out = self._decided()
        self._look = 2 * len(self.back)  # so that looking back costs no more than the search, however long it stays open
        return out

    def _moved(self) -> tuple[np.ndarray, np.ndarray]:
        n, stay, switch = self.p.n, np.log(1 - self.p.switch), np.log(self.p.switch)
        if self._moves is None:
            moves, r = self.p.moves(), self.p.reach
            at = np.arange(n)[:, None] + np.arange(-r, r + 1)[None]  # from which states each is reached
            inside = (at >= 0) & (at < n)
            self._from = np.clip(at, 0, n - 1)
            self._moves = np.where(inside, moves[self._from, np.arange(n)[:, None]], -np.inf)
        before, value = np.empty(2 * n, dtype=np.int32), np.empty(2 * n)
        reach = [(x := self.best[k * n + self._from] + self._moves, x.argmax(axis=1)) for k in (0, 1)]
        tops = [x[np.arange(n), i] for x, i in reach]
        for to in (0, 1):
            same, other = tops[to] + stay, tops[1 - to] + switch
            change = other > same
            own = to * n + self._from[np.arange(n), reach[to][1]]
            else_ = (1 - to) * n + self._from[np.arange(n), reach[1 - to][1]]
            before[to * n : (to + 1) * n] = np.where(change, else_, own)
            value[to * n : (to + 1) * n] = np.where(change, other, same)
        return before, value

    def _told(self, path: list[int]) -> list[tuple[float, bool, float]]:
        n = self.p.n
        return [(float(self.p.hz(s % n)), s < n, v) for s, v in zip(path, self.waiting, strict=False)]

    def _decided(self) -> list[tuple[float, bool, float]]:
        """Frames on which the best paths to all states agree."""
        at = np.flatnonzero(np.isfinite(self.best))
        for k in range(len(self.back) - 1, 0, -1):
            at = np.unique(self.back[k][at])
            if len(at) == 1:  # frame k - 1 is in this state whatever comes
                path = [int(at[0])]
                for j in range(k - 1, 0, -1):
                    path.append(int(self.back[j][path[-1]]))
                out = self._told(path[::-1])
                self.back, self.waiting = self.back[k:], self.waiting[k:]
                return out
        return []

    def end(self) -> list[tuple[float, bool, float]]:
        if not self.back:
            return []
        path = [int(np.argmax(self.best))]
        for j in range(len(self.back) - 1, 0, -1):
            path.append(int(self.back[j][path[-1]]))
        out = self._told(path[::-1])
        self.best, self.back, self.waiting, self._look = None, [], [], 0
        return out


def pitch_candidates(frames: DataFrame, keep: list[str], p: Pitches, frame: str = "frame") -> DataFrame:
    """Frame rows -> rows (keep, states, mass). Frames of all lengths of two periods of ``low`` and more."""

    @F.pandas_udf("states array<int>, mass array<double>")
    def run(x: pd.Series) -> pd.DataFrame:
        out: list = [None] * len(x)
        sizes = x.map(lambda f: 0 if f is None else len(f)).to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            enough = size > ceil(p.sr / p.low) + 2
            got = candidates(np.stack(x.iloc[at].to_numpy()).astype(float), p) if enough else [(np.zeros(0, dtype=int), np.zeros(0))] * len(at)
            for i, (s, m) in zip(at, got, strict=True):
                out[i] = (s.tolist(), m.tolist())
        return pd.DataFrame(out, columns=["states", "mass"])

    return frames.select(*keep, run(frame).alias("c")).select(*keep, "c.*")


def probabilistic_yin(frames: DataFrame, by: str, t: str, p: Pitches | None = None, frame: str = "frame") -> DataFrame:
    """Frame rows (by, t, frame) -> rows (by, t, pitch_hz, voiced, voiced_prob) by the best path over the recording.

    ``pitch_hz`` is the best path's pitch, in unvoiced frames too. A frame too short for two periods of the lowest pitch, an empty one or
    a null has no candidate and counts as unvoiced. Rows of a null ``by`` are one recording.
    """
    p = p or Pitches()
    kinds = {c: frames.schema[c].dataType.simpleString() for c in (by, t)}
    rows = pitch_candidates(frames, [by, t], p, frame)
    rows = rows.repartition(by).sortWithinPartitions(by, t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search, own, times = Search(p), None, []

        def told(decided):
            nonlocal times
            out = [(own, x, *d) for x, d in zip(times, decided, strict=False)]
            times = times[len(decided) :]
            return out

        for b in batches:
            out = []
            for r, x, s, m in zip(b[by], b[t], b["states"], b["mass"], strict=True):
                r = None if pd.isna(r) else r
                if r != own:
                    out += told(search.end())
                    own = r
                times.append(x)
                out += told(search.step(np.asarray(s, dtype=int), np.asarray(m, dtype=float)))
            yield pd.DataFrame(out, columns=[by, t, "pitch_hz", "voiced", "voiced_prob"])
        yield pd.DataFrame(told(search.end()), columns=[by, t, "pitch_hz", "voiced", "voiced_prob"])

    return rows.mapInPandas(run, f"`{by}` {kinds[by]}, `{t}` {kinds[t]}, pitch_hz double, voiced boolean, voiced_prob double")
