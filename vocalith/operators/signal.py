"""Numeric kernels that have no relational form: spectra, linear prediction, filters, peaks, pitch.

Kernels are numpy functions over one recording or frame; the DataFrame forms run them in Arrow batches over frame
rows, so recordings of any length spread over tasks. Everything after a spectrum is relational again (series, ranges).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

SAMPLE_RATE = 16_000


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def windows_of(n: int) -> dict[str, np.ndarray]:
    """The four analysis windows."""
    k = np.arange(n)
    c = lambda *a: sum(x * np.cos(2 * np.pi * i * k / max(1, n - 1)) for i, x in enumerate(a))
    return {"hamming": c(0.54, -0.46), "hann": c(0.5, -0.5), "blackman": c(0.42, -0.5, 0.08), "rectangular": np.ones(n)}


def magnitudes(frame: np.ndarray, n_fft: int = 2048) -> np.ndarray:
    return np.abs(np.fft.rfft(np.asarray(frame, dtype=float) * hann(len(frame)), n_fft))


def burg(frames: np.ndarray, order: int) -> np.ndarray:
    """Prediction polynomials (leading 1), a row for each row of ``frames``, by Burg's lattice: each step's reflection makes the
    forward and backward errors of the whole frame least, so all poles are stable, on short frames too."""
    x = np.asarray(frames, dtype=float)
    a = np.zeros((len(x), order + 1))
    a[:, 0] = 1.0
    ahead, back = x[:, 1:].copy(), x[:, :-1].copy()
    for i in range(1, order + 1):
        if not ahead.shape[1]:
            break
        power = (ahead**2).sum(axis=1) + (back**2).sum(axis=1)
        k = np.divide(-2 * (ahead * back).sum(axis=1), power, out=np.zeros(len(x)), where=power > 0)[:, None]
        a[:, 1 : i + 1] += k * a[:, i - 1 :: -1][:, :i]
        ahead, back = ahead[:, 1:] + k * back[:, 1:], back[:, :-1] + k * ahead[:, :-1]
    return a


def lpc(frame: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """LPC polynomial by Burg's method, and mean squared residual of the frame predicted from its past."""
    x = np.asarray(frame, dtype=float)
    a = burg(x[None], order)[0]
    residual = np.convolve(x, a)[order : len(x)]
    return a, float(np.mean(residual**2)) if len(residual) else 0.0


def roots_of(a: np.ndarray) -> np.ndarray:
    """Roots of each row's polynomial (leading 1), by the eigenvalues of all companion matrices at once."""
    n, order = len(a), a.shape[1] - 1
    companion = np.zeros((n, order, order))
    companion[:, 0] = -a[:, 1:]
    companion[:, np.arange(1, order), np.arange(order - 1)] = 1.0
    return np.linalg.eigvals(companion)


def formants_from_polynomial(a: np.ndarray, sr: int = SAMPLE_RATE, widest: float = 500.0) -> list[tuple[float, float]]:
    """(frequency, bandwidth) of the roots above the real axis that are narrower than ``widest``, by frequency."""
    return formants_from_roots(np.roots(a), sr, widest)


def formants_from_roots(roots: np.ndarray, sr: int = SAMPLE_RATE, widest: float = 500.0) -> list[tuple[float, float]]:
    roots = roots[np.imag(roots) > 1e-9]
    freq = np.angle(roots) * sr / (2 * np.pi)
    width = -np.log(np.maximum(np.abs(roots), 1e-12)) * sr / np.pi
    return sorted((float(f), float(b)) for f, b in zip(freq, width, strict=True) if 0 < b < widest)


def adaptive_order(frame: np.ndarray, peaks: int, low: int = 12, high: int = 36) -> tuple[int, float]:
    """Even order near 4 + 2 peaks with the least N log(mse) + 2 p + 0.05 (p - 12)^2."""
    base = int(np.clip(4 + 2 * peaks, low, high))
    tried = [p for p in range(low, high + 1, 2) if abs(p - base) <= 8] or [base]
    cost = {p: len(frame) * np.log(max(lpc(frame, p)[1], 1e-12)) + 2 * p + 0.05 * (p - 12) ** 2 for p in tried}
    best = min(cost, key=lambda p: (cost[p], p))
    return best, float(cost[best])


def lpc_windows(frame: np.ndarray, order: int) -> list[tuple[str, np.ndarray, float]]:
    """(window, polynomial, quality) by falling quality: 1 / (1 + 20 err) * (0.8 stable, else 0.3)."""
    x, out = np.asarray(frame, dtype=float), []
    for name, w in windows_of(len(x)).items():
        a, mse = lpc(x * w, order)
        power = float(np.mean((x * w) ** 2))
        stable = bool(np.all(np.abs(np.roots(a)) < 1)) if np.any(a[1:]) else True
        out.append((name, a, (0.8 if stable else 0.3) / (1 + 20 * (mse / power if power > 0 else 0.0))))
    return sorted(out, key=lambda x: -x[2])


def find_peaks(x: np.ndarray, height: float | None = None, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Positions of local maxima with a height, a distance (higher ones first, of equals the later) and a prominence.

    A plateau counts once, at its middle, if both sides are lower; the ends are no maxima."""
    x = np.asarray(x, dtype=float)
    if len(x) < 3:
        return np.zeros(0, dtype=int)
    change = np.flatnonzero(np.diff(x) != 0)
    start, end = np.concatenate([[0], change + 1]), np.concatenate([change, [len(x) - 1]])  # runs of equal values
    v = x[start]
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:])) + 1
    at = (start[top] + end[top]) // 2
    if height is not None:
        at = at[x[at] >= height]
    if distance > 1 and len(at):
        keep = np.ones(len(at), dtype=bool)
        for i in np.argsort(x[at], kind="stable")[::-1]:
            if keep[i]:
                keep[np.searchsorted(at, at[i] - distance, "right") : i] = False
                keep[i + 1 : np.searchsorted(at, at[i] + distance, "left")] = False
        at = at[keep]
    return at[prominences(x)[at] >= prominence] if prominence > 0 else at


def _drops(x: np.ndarray) -> np.ndarray:
    """From each position back to the nearest higher value (or the start): how far the lowest value between lies below it.

    A stack holds the values that no later one has passed, each with the lowest value since the one below it."""
    out, stack = np.zeros(len(x)), []
    for i, v in enumerate(x.tolist()):
        low = v
        while stack and stack[-1][0] <= v:
            low = min(low, stack.pop()[1])
        out[i] = v - low
        stack.append((v, low))
    return out


def prominences(x: np.ndarray) -> np.ndarray:
    """How far each value stands above the higher of the lowest points towards the next higher value on either side."""
    x = np.asarray(x, dtype=float)
    return np.minimum(_drops(x), _drops(x[::-1])[::-1])


def peaks(rows: DataFrame, keys: list[str], position: str, x: str, height: float | None = None, distance: int = 1, prominence: float = 0.0, plateaus: bool = True) -> DataFrame:
    """Rows (keys, position, x) -> a row (keys, position, x, prominence) for each peak of the series of each key.

    Without ``plateaus`` a peak is above both its neighbours; this choice comes after the one by distance. Nulls of ``x`` are left out. A key's values meet in one row: frames of a spectrum, or the mean of one."""

    @F.pandas_udf("array<struct<i:int,prominence:double>>")
    def run(series: pd.Series) -> pd.Series:
        def one(v):
            v = np.asarray(v, dtype=float)
            at = find_peaks(v, height, distance, prominence)
            at = at if plateaus else at[(v[at] > v[at - 1]) & (v[at] > v[at + 1])]
            return [{"i": int(i), "prominence": float(p)} for i, p in zip(at, prominences(v)[at], strict=True)]

        return series.map(one)

    kept = rows.where(F.col(x).isNotNull())
    ordered = kept.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(x).cast("double").alias("x")))).alias("_s"))
    found = ordered.select(*keys, "_s", F.explode(run(F.transform("_s", lambda v: v["x"]))).alias("_f"))
    at = F.get("_s", F.col("_f.i"))
    return found.select(*keys, at["p"].alias(position), at["x"].alias(x), F.col("_f.prominence").alias("prominence"))


def autocorrelation_pitch(frame: np.ndarray, sr: int = SAMPLE_RATE, low: float = 80.0, high: float = 400.0) -> tuple[float, float]:
    """(pitch, strength) by the highest autocorrelation between the lags; 0 where there is no energy."""
    x = np.asarray(frame, dtype=float)
    x = x - x.mean()
    r = np.correlate(x, x, "full")[len(x) - 1 :]
    a, b = int(sr / high), min(int(sr / low), len(r) - 1)
    if r[0] <= 0 or b <= a:
        return 0.0, 0.0
    k = a + int(np.argmax(r[a : b + 1]))
    return sr / k, float(r[k] / r[0])


def butterworth_bandpass(x: np.ndarray, low: float, high: float, sr: int = SAMPLE_RATE, order: int = 4) -> np.ndarray:
    """Zero-phase Butterworth band-pass: the squared magnitude response of a forward-backward pass, in frequency."""
    n = len(x)
    f = np.fft.rfftfreq(2 * n, 1 / sr)
    with np.errstate(divide="ignore", invalid="ignore"):
        warp = np.tan(np.pi * np.minimum(f, sr / 2 * 0.999999) / sr)
        wl, wh = np.tan(np.pi * low / sr), np.tan(np.pi * high / sr)
        u = np.where(warp > 0, (warp**2 - wl * wh) / (warp * (wh - wl)), np.inf)
    gain = 1.0 / (1.0 + u ** (2 * order))
    return np.fft.irfft(np.fft.rfft(x, 2 * n) * gain, 2 * n)[:n]


def peak_normalize(x: np.ndarray) -> np.ndarray:
    top = np.max(np.abs(x)) if len(x) else 0.0
    return x / top if top > 0 else x


def _smoothed(x: np.ndarray, weight: float) -> np.ndarray:
    """Exponential smoothing of the rows, forwards and then backwards, from the first and the last row on."""
    for _ in range(2):
        out = np.empty_like(x)
        last = x[0]
        for i, row in enumerate(x):
            last = last + weight * (row - last)
            out[i] = last
        x = out[::-1]
    return x


def _blurred(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Means with triangular weights over ``reach`` neighbours on each side, of what there is at the ends."""
    if reach < 1:
        return x
    w = 1 - np.abs(np.arange(-reach, reach + 1)) / (reach + 1)
    conv = lambda v: np.convolve(v, w)[reach : reach + len(v)]
    return np.apply_along_axis(conv, axis, x) / np.expand_dims(conv(np.ones(x.shape[axis])), 1 - axis)


def noise_gate(x: np.ndarray, reduction: float = 0.75, size: int = 1024, sr: int = SAMPLE_RATE, floor_s: float = 2.0, over: float = 1.0, slope: float = 10.0, blur_hz: float = 500.0, blur_s: float = 0.05) -> np.ndarray:
    """Spectral gate that follows the noise: each bin's floor is its level smoothed over ``floor_s`` in both directions.

    How far a bin stands above its floor, as a part of it, decides softly (a logistic curve around ``over``) whether it
    is kept or turned down by ``reduction``; the decisions are blurred over frequency and time."""
    x = np.asarray(x, dtype=float)
    hop = size // 4
    if len(x) < size:
        return x
    pad = np.concatenate([np.zeros(size), x, np.zeros(size + -len(x) % hop)])
    frames = np.lib.stride_tricks.sliding_window_view(pad, size)[::hop] * hann(size)
    spec = np.fft.rfft(frames, axis=1)
    level = np.abs(spec)
    t = max(1e-9, floor_s * sr / hop)
    floor = _smoothed(level, (np.sqrt(1 + 4 * t * t) - 1) / (2 * t * t))
    above = np.divide(level - floor, floor, out=np.zeros_like(level), where=floor > 0)
    kept = 1 / (1 + np.exp(np.clip(-slope * (above - over), -60, 60)))
    kept = _blurred(_blurred(kept, int(blur_hz / (2 * sr / size)), 1), int(blur_s * sr / hop), 0)
    spec *= kept * reduction + (1 - reduction)
    back, norm = np.zeros(len(pad)), np.zeros(len(pad))
    for i, part in enumerate(np.fft.irfft(spec, size, axis=1)):
        back[i * hop : i * hop + size] += part * hann(size)
        norm[i * hop : i * hop + size] += hann(size) ** 2
    return (back / np.maximum(norm, 1e-6))[size : size + len(x)]


def preprocess(x: np.ndarray, sr: int = SAMPLE_RATE) -> np.ndarray:
    """Peak normalisation, noise gate, fixed band-pass of 100..7500 Hz, peak normalisation: the same for every call."""
    return peak_normalize(butterworth_bandpass(noise_gate(peak_normalize(np.asarray(x, dtype=float)), sr=sr), 100.0, 7500.0, sr))


def enhance_speech(x: np.ndarray, sr: int = SAMPLE_RATE, formants: bool = True, noise: bool = True) -> np.ndarray:
    """Gate, then 0.7 signal + 0.3 of its 300..3400 Hz band; a quiet result (peak under 0.5) is raised to 0.9."""
    y = noise_gate(x, sr=sr) if noise else np.asarray(x, dtype=float)
    if formants:
        y = 0.7 * y + 0.3 * butterworth_bandpass(y, 300.0, 3400.0, sr)
    top = np.max(np.abs(y)) if len(y) else 0.0
    return y * (0.9 / top) if 0 < top < 0.5 else y


def mel_of(hz):
    """Mels that are linear up to 1000 Hz (15) and logarithmic above (27 to a factor of 6.4)."""
    hz = np.asarray(hz, dtype=float)
    return np.where(hz < 1000, hz * 3 / 200, 15 + 27 * np.log(np.maximum(hz, 1.0) / 1000) / np.log(6.4))


def hz_of(mel):
    mel = np.asarray(mel, dtype=float)
    return np.where(mel < 15, mel * 200 / 3, 1000 * 6.4 ** ((mel - 15) / 27))


def mel_filters(n_fft: int, sr: int = SAMPLE_RATE, mels: int = 128, low: float = 0.0, high: float | None = None) -> np.ndarray:
    """Triangular filters at equal distances in mels from ``low`` to ``high`` (or half the rate), of unit area in Hz."""
    edges = hz_of(np.linspace(mel_of(low), mel_of(high or sr / 2), mels + 2))
    f = np.fft.rfftfreq(n_fft, 1 / sr)[None, :]
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo)


def mel_decibels(frames: DataFrame, by: list[str], t: str, frame: str = "frame", n_fft: int = 2048, sr: int = SAMPLE_RATE, mels: int = 128, low: float = 50.0, high: float = 8000.0, deepest: float = 80.0) -> DataFrame:
    """Frame rows (by, t, frame) -> rows (by, t, bin, db): mel power in dB against the recording's largest, held above
    minus ``deepest``. A silent recording is 0 throughout."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        bank = mel_filters(n_fft, sr, mels, low, high)
        return x.map(lambda f: bank @ magnitudes(f, n_fft) ** 2)

    rows = frames.select(*by, t, F.posexplode(run(frame)).alias("bin", "p"))
    return decibels(rows, by, "p", deepest).select(*by, t, "bin", "db")


def decibels(rows: DataFrame, by: list[str], power: str, deepest: float = 80.0) -> DataFrame:
    """``rows`` with ``db``: ``power`` against the largest of its key, held above minus ``deepest``; 0 where all is nothing."""
    of = lambda c: F.lit(10.0) * F.log10(F.greatest(c, F.lit(1e-10)))
    top = rows.groupBy(*by).agg(F.max(power).alias("_top"))
    db = F.greatest(of(F.col(power)) - of(F.col("_top")), F.lit(-float(deepest)))
    return rows.join(top, by).withColumn("db", db).drop("_top")


def mfcc(power: np.ndarray, sr: int = SAMPLE_RATE, n: int = 13, mels: int = 128) -> np.ndarray:
    """First ``n`` cosine coefficients of the mel spectrum in dB."""
    db = 10 * np.log10(np.maximum(mel_filters(2 * (len(power) - 1), sr, mels) @ power, 1e-10))
    k = np.arange(mels)
    basis = np.cos(np.pi / mels * (k[None, :] + 0.5) * np.arange(n)[:, None]) * np.sqrt(2 / mels)
    basis[0] /= np.sqrt(2)
    return basis @ db


def resample(x: np.ndarray, sr: int, target: int = SAMPLE_RATE) -> np.ndarray:
    """Band-limited resampling in the frequency domain."""
    if sr == target or not len(x):
        return np.asarray(x, dtype=float)
    n = max(1, round(len(x) * target / sr))
    spec = np.fft.rfft(x)
    out = np.zeros(n // 2 + 1, dtype=complex)
    k = min(len(spec), len(out))
    out[:k] = spec[:k]
    return np.fft.irfft(out, n) * n / len(x)


def sinc_bank(filters: int = 64, kernel: int = 1024, sr: int = SAMPLE_RATE, first: float = 50.0, step: float = 100.0) -> np.ndarray:
    """Band-pass kernels at first + step * i Hz, windowed: the fixed front end of the spoofing model."""
    t = (np.arange(kernel) - kernel / 2) / sr
    low = first + step * np.arange(filters)[:, None]
    high = np.minimum(low + step, sr / 2 - 1)
    band = 2 * high * np.sinc(2 * high * t) - 2 * low * np.sinc(2 * low * t)
    return band * windows_of(kernel)["hamming"] / sr


def spectrum(frames: DataFrame, keys: list[str], n_fft: int = 2048, sr: int = SAMPLE_RATE, frame: str = "frame") -> DataFrame:
    """Frame rows -> rows (keys, bin, freq_hz, mag)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def mags(x: pd.Series) -> pd.Series:
        return x.map(lambda f: magnitudes(np.asarray(f), n_fft))

    return frames.select(*keys, F.posexplode(mags(frame)).alias("bin", "mag")).withColumn("freq_hz", F.col("bin") * F.lit(sr / n_fft))


def lpc_formants(frames: DataFrame, keys: list[str], order: int = 16, sr: int = SAMPLE_RATE, frame: str = "frame") -> DataFrame:
    """Frame rows -> candidates (keys, freq_hz, bandwidth_hz, reliability) from the Hamming-windowed LPC polynomial."""

    @F.pandas_udf("array<struct<freq_hz:double,bandwidth_hz:double,reliability:double>>")
    def roots(x: pd.Series) -> pd.Series:
        out: list = [[]] * len(x)
        sizes = x.map(len).to_numpy()
        for size in np.unique(sizes):  # frames of one length go together
            at = np.flatnonzero(sizes == size)
            a = burg(np.stack(x.iloc[at].to_numpy()).astype(float) * windows_of(size)["hamming"], order)
            for i, r in zip(at, roots_of(a), strict=True):
                out[i] = [{"freq_hz": q, "bandwidth_hz": b, "reliability": float(np.clip(1 - b / 500, 0.1, 0.95))} for q, b in formants_from_roots(r, sr)]
        return pd.Series(out)

    return frames.select(*keys, F.explode(roots(frame)).alias("r")).select(*keys, "r.*")


def pitch_frames(frames: DataFrame, keys: list[str], sr: int = SAMPLE_RATE, frame: str = "frame") -> DataFrame:
    """Frame rows -> (keys, pitch_hz, pitch_mag, energy)."""

    @F.pandas_udf("pitch_hz double, pitch_mag double")
    def track(x: pd.Series) -> pd.DataFrame:
        got = [autocorrelation_pitch(np.asarray(f), sr) for f in x]
        return pd.DataFrame(got, columns=["pitch_hz", "pitch_mag"])

    from .series import rms

    return frames.select(*keys, track(frame).alias("p"), rms(F.col(frame)).alias("energy")).select(*keys, "p.*", "energy")


def response_peaks(frame: np.ndarray, order: int = 16, sr: int = SAMPLE_RATE, points: int = 2000) -> list[tuple[float, float, float]]:
    """(frequency, magnitude, half-power bandwidth) of the peaks of a frame's linear-prediction response."""
    x = np.asarray(frame, dtype=float)
    a, _ = lpc(x * windows_of(len(x))["hamming"], order)
    w = np.pi * np.arange(points) / points
    mag = 1.0 / np.maximum(np.abs(np.exp(-1j * np.outer(w, np.arange(order + 1))) @ a), 1e-12)
    freq, out = w * sr / (2 * np.pi), []
    for i in find_peaks(mag, height=0.1, distance=5, prominence=0.1):
        low = np.flatnonzero(mag <= mag[i] / np.sqrt(2))
        left, right = low[low < i], low[low > i]
        out.append((float(freq[i]), float(mag[i]), float(freq[right[0] if len(right) else points - 1] - freq[left[-1] if len(left) else 0])))
    return out


def response_formants(frames: DataFrame, keys: list[str], order: int = 16, sr: int = SAMPLE_RATE, frame: str = "frame") -> DataFrame:
    """Frame rows -> rows (keys, formant, freq_hz, mag, bandwidth_hz): the strongest response peak of each band F1-F4, a
    peak belonging to the first band that holds it."""
    from .ranges import PEAK_BANDS, best_in_band, first_band_key

    @F.pandas_udf("array<struct<freq_hz:double,mag:double,bandwidth_hz:double>>")
    def peaks(x: pd.Series) -> pd.Series:
        return x.map(lambda f: [{"freq_hz": a, "mag": m, "bandwidth_hz": b} for a, m, b in response_peaks(f, order, sr)])

    rows = frames.select(*keys, F.explode(peaks(frame)).alias("p")).select(*keys, "p.*")
    rows = rows.withColumn("formant", first_band_key(F.col("freq_hz"), PEAK_BANDS)).where("formant is not null")
    return best_in_band(rows, keys, "formant", "mag")


def lpc_orders(frames: DataFrame, keys: list[str], peaks: str, frame: str = "frame") -> DataFrame:
    """Frame rows with their number of spectral peaks -> (keys, order, cost) of ``adaptive_order``."""

    @F.pandas_udf("order int, cost double")
    def run(x: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([adaptive_order(np.asarray(f, dtype=float), int(k)) for f, k in zip(x, n, strict=True)], columns=["order", "cost"])

    return frames.select(*keys, run(frame, peaks).alias("o")).select(*keys, "o.*")


def lpc_window_ranks(frames: DataFrame, keys: list[str], order: int = 16, frame: str = "frame") -> DataFrame:
    """Frame rows -> rows (keys, rank, window, quality): the four windows of ``lpc_windows``, best first."""

    @F.pandas_udf("array<struct<window:string,quality:double>>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda f: [{"window": n, "quality": q} for n, _, q in lpc_windows(f, order)])

    return frames.select(*keys, F.posexplode(run(frame)).alias("rank", "w")).select(*keys, "rank", "w.*")


def contrast_of(mag: np.ndarray, freq: np.ndarray, bands: int = 6, lowest: float = 200.0, share: float = 0.02) -> list[float]:
    """Octave bands from ``lowest`` (and what lies below): dB between the means of the highest and lowest ``share``."""
    edges, out = [0.0, *[lowest * 2.0**i for i in range(bands)], np.inf], []
    for lo, hi in zip(edges, edges[1:], strict=False):
        x = np.sort(mag[(freq >= lo) & (freq < hi)])
        k = max(1, round(share * len(x)))
        out.append(float(10 * np.log10(max(x[-k:].mean(), 1e-10) / max(x[:k].mean(), 1e-10))) if len(x) else 0.0)
    return out


def spectral_contrast(frames: DataFrame, keys: list[str], n_fft: int = 2048, sr: int = SAMPLE_RATE, frame: str = "frame") -> DataFrame:
    """Frame rows -> rows (keys, band, contrast)."""
    freq = np.fft.rfftfreq(n_fft, 1 / sr)

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda f: contrast_of(magnitudes(f, n_fft), freq))

    return frames.select(*keys, F.posexplode(run(frame)).alias("band", "contrast"))


def mfccs(frames: DataFrame, keys: list[str], n: int = 13, n_fft: int = 2048, sr: int = SAMPLE_RATE, frame: str = "frame") -> DataFrame:
    """Frame rows -> rows (keys, coefficient, value)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda f: mfcc(magnitudes(f, n_fft) ** 2, sr, n))

    return frames.select(*keys, F.posexplode(run(frame)).alias("coefficient", "value"))
