"""Language identification with string kernels.

Kernel: blended-spectrum presence. A text is the set of its letter n-grams, n = 1..3 (lower case, every other
character is a blank, runs of blanks are one), hashed into fixed buckets; k(s, t) is the mean over n of
|S_n and T_n| / sqrt(|S_n| |T_n|). Landmarks from the labelled sample give the Nystroem map
phi(s) = K(s, L) K(L, L)^-1/2; one-versus-rest kernel ridge regression on phi scores each language. Scoring a
batch is two matrix products, K(S, L) and K(S, L) A.

Cases: a null text or one without a letter gives ``und`` with score 0; so does every text when nothing is
labelled. Texts are read whole, in pieces of bounded size, so a very long one needs no more memory than a
short one. Equal texts get equal results; other columns are carried along,
but columns of the output's names are replaced.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

UND = "und"
#: Buckets for the n-grams of length 1, 2 and 3.
BUCKETS = (512, 4096, 8192)
_EDGE = tuple(int(x) for x in np.cumsum((0, *BUCKETS)))
_PIECE = 1 << 20
#: The bound on known trigrams: this share of what all held-out labelled texts but the tail reach.
_SLACK, _LOW_TAIL, _DOUBT = 0.85, 0.005, 8
#: Odd multipliers of the n-gram hash.
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), dtype=bool, count=0x110000)


def _mark(row: np.ndarray, text: str) -> bool:
    """Set the presence bits of ``text``; whether it has a letter. The n-grams are those of the whole text: from piece
    to piece go the last codes that were kept, and a piece sees the character after it."""
    found, text, last = False, f" {text.lower()} ", np.zeros(0, dtype=np.uint32)
    for at in range(0, len(text), _PIECE):
        final = at + _PIECE >= len(text)
        seen = np.frombuffer(text[at : at + _PIECE + 1].encode("utf-32-le", "replace"), dtype=np.uint32)
        letter = _letters()[seen]
        keep = letter.copy()
        keep[:-1] |= letter[1:]  # the one blank before a word
        keep[-1] = final  # the one after the last word; else the character belongs to the next piece
        found = found or bool(letter[: None if final else -1].any())
        if not found:
            continue
        codes = np.concatenate([last, np.where(letter, seen, np.uint32(32))[keep]])
        last = codes[1 - len(BUCKETS) :]
        h = codes * _MULTIPLIERS[0]
        for n, size in enumerate(BUCKETS):
            if n:
                h = h[:-1] * np.uint32(31) + codes[n:] * _MULTIPLIERS[n]
            if not len(h):
                break
            mixed = h ^ (h >> np.uint32(15))
            row[_EDGE[n] + (mixed * _MULTIPLIERS[1] >> np.uint32(33 - size.bit_length()))] = True
    return found


def presence(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Presence bits (texts x buckets) and whether each text has a letter."""
    bits = np.zeros((len(texts), _EDGE[-1]), dtype=bool)
    return bits, np.fromiter((bool(t) and _mark(bits[i], t) for i, t in enumerate(texts)), dtype=bool, count=len(texts))


def _scaled(bits: np.ndarray) -> np.ndarray:
    """Rows whose dot products are the kernel."""
    out = bits.astype(np.float32)
    for a, b in zip(_EDGE, _EDGE[1:], strict=False):
        part = out[:, a:b]
        part /= np.sqrt(np.maximum(part.sum(1, keepdims=True), 1) * len(BUCKETS))
    return out


@dataclass
class LanguageModel:
    """``landmarks``: packed presence bits; ``weights``: landmarks x languages; ``bias``: one per language;
    ``seen``: the trigrams of each language's labelled texts; ``least_known``: a text below it is in none of them."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    seen: np.ndarray | None = None
    least_known: float = 0.0

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ridge outputs (texts x languages) and whether each text has a letter."""
        bits, has = presence(texts)
        return self.outputs(bits), has

    def outputs(self, bits: np.ndarray) -> np.ndarray:
        """Ridge outputs (texts x languages) for presence bits."""
        if not self.languages:
            return np.zeros((len(bits), 0), dtype=np.float32)
        if not hasattr(self, "_l"):
            self._l = _scaled(np.unpackbits(self.landmarks, axis=1, count=_EDGE[-1]).astype(bool)).T.copy()
        return (_scaled(bits) @ self._l) @ self.weights + self.bias


def _known(bits: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Share of each text's trigrams that the best language has; _DOUBT more count as known, so short texts pass."""
    x = bits[:, _EDGE[2] :].astype(np.float32)
    return ((x @ seen.T.astype(np.float32)).max(1, initial=0) + _DOUBT) / (x.sum(1) + _DOUBT)


def _seen(bits: np.ndarray, y: np.ndarray, languages: int) -> np.ndarray:
    return np.stack([bits[y == c, _EDGE[2] :].any(0) for c in range(languages)])


def fit_arrays(bits: np.ndarray, labels: list[str], landmarks: int = 192, ridge: float = 1e-3) -> LanguageModel:
    """Nystroem landmarks spread over the languages, then one-versus-rest kernel ridge regression."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((0, 1), np.uint8), np.zeros((0, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([languages.index(x) for x in labels])
    turn = np.empty(len(y), dtype=int)
    for c in range(len(languages)):
        turn[y == c] = np.arange((y == c).sum())
    chosen = np.argsort(turn, kind="stable")[:landmarks]
    x = _scaled(bits)
    marks = x[chosen]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = (x @ marks.T).astype(np.float64) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # rows weigh so that each language counts alike
    w = (len(y) / len(languages) / np.bincount(y, minlength=len(languages)))[y][:, None]
    one = np.hstack([phi, np.ones((len(y), 1))])
    penalty = ridge * len(y) * np.eye(one.shape[1])
    penalty[-1, -1] = 1e-9
    beta = np.linalg.solve(one.T @ (w * one) + penalty, one.T @ (w * target))
    # half of each language's texts, held out, tell how much of a clean text the other half knows
    held = turn % 2 == 1
    known = _known(bits[held], _seen(bits[~held], y[~held], len(languages)))
    least = _SLACK * float(np.quantile(known, _LOW_TAIL)) if len(known) else 0.0
    return LanguageModel(languages, np.packbits(bits[chosen], axis=1), (root @ beta[:-1]).astype(np.float32), beta[-1].astype(np.float32), _seen(bits, y, len(languages)), least)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: Column | None = None, per_language: int = 300, at_most: int = 4000, landmarks: int = 192) -> LanguageModel:
    """Learn from the rows of ``docs`` with a label.

    The sample is bounded: about ``per_language`` rows of each language, ``at_most`` in all, chosen by the hash
    ``order``. Only their presence bits (1.6 kB each, whatever the length of the text) come to the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(text) if order is None else order, F.lit(1_000_000)).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(at_most // 2 + 1).collect()}
    if len(counts) > at_most // 2:
        raise ValueError(f"over {at_most // 2} languages: raise at_most, which bounds the sample at two rows a language")
    if not counts:
        return fit_arrays(np.zeros((0, _EDGE[-1]), bool), [])
    most = max(2, min(per_language, at_most // len(counts)))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, 50 + 1_300_000 * most // n))])

    def bits(batches):
        for x in batches:
            for at in range(0, len(x), 128):
                part = x.iloc[at : at + 128]
                got, has = presence(part["text"].tolist())
                yield pd.DataFrame({"lang": part["lang"][has], "h": part["h"][has], "bits": [p.tobytes() for p in np.packbits(got[has], axis=1)]})

    got = rows.where(F.col("h") < F.try_element_at(share, "lang")).mapInPandas(bits, "lang string, h long, bits binary").toPandas()
    got = got.sort_values(["lang", "h", "bits"]).groupby("lang").head(most)
    packed = np.frombuffer(b"".join(got["bits"]), dtype=np.uint8).reshape(len(got), -1)
    return fit_arrays(np.unpackbits(packed, axis=1, count=_EDGE[-1]).astype(bool), got["lang"].tolist(), landmarks)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", out: tuple[str, str] = ("lang_pred", "score"), fits: str | None = None) -> DataFrame:
    """Add the language of every whole text and its score: the best ridge output, moved from -1..1 to 0..1.

    ``fits`` names a column for whether the text is in a learned language at all: the outputs of any text sum to
    2 - languages, so the score never falls below 1 / languages; the share of known trigrams does.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, fits boolean")
    def told(texts: pd.Series) -> pd.DataFrame:
        m, names, scores, fit, values = shared.value, [], [], [], texts.tolist()
        for at in range(0, len(values), 128):
            bits, has = presence(values[at : at + 128])
            got = m.outputs(bits)
            fit += (has & (_known(bits, m.seen) >= m.least_known)).tolist() if fits and m.languages else [False] * len(has)
            if not m.languages:
                names += [UND] * len(has)
                scores += [0.0] * len(has)
                continue
            best = got.argmax(1)
            names += [m.languages[b] if h else UND for b, h in zip(best, has, strict=True)]
            scores += np.where(has, np.clip((got[np.arange(len(best)), best] + 1) / 2, 0, 1), 0.0).astype(float).round(6).tolist()
        return pd.DataFrame({"lang": names, "score": scores, "fits": fit})

    got = docs.withColumn("_told", told(F.col(text)))
    more = {fits: F.col("_told.fits")} if fits else {}
    return got.withColumns({out[0]: F.col("_told.lang"), out[1]: F.col("_told.score")} | more).drop("_told")
