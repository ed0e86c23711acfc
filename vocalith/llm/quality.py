"""Quality classifier: a generalised additive model with pairwise interactions.

A text becomes a few numbers (``FEATURES``). Each number has a table of additions to the log-odds, one entry for each
of its bins; pairs of numbers have tables over two coarser sets of bins. The tables are learned by boosting in cycles:
one feature after the other gets a shallow tree fitted to what the model does not explain yet, and the tree's leaves are
added to the feature's table at a small rate. Then the pairs are ranked by what one cut in each of both explains of the
rest, and the best get their tables the same way. A part of the sample is kept aside and says how many
cycles are kept. Scoring finds bins and adds table entries, for whole batches at a time.

Learning reads a sample of labelled rows (``rows`` for each label at most, the lowest by hash); everything else reads
all documents.

Cases: null texts count as empty, and empty texts have features, so a score; texts are read whole, long ones in
pieces; a document with several labels has the highest; labels other than 0 and 1 do not count; with no labelled row, or
of one label only, the score is the share of that label, and 0.5 where nothing is labelled; equal texts have equal
scores; repeated rows have a row each; an empty table gives no rows; other columns are carried along, but for those of
the output's names, which are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

FEATURES = (
    "log_words", "word_length", "word_length_std", "distinct_words", "top_word", "repeated_words", "distinct_pairs", "wordless",
    "capitals", "digits", "symbols", "points", "blanks", "beyond_ascii", "lines_per_word", "repeated_lines", "entropy",
)
_PIECE = 1 << 22
_ALNUM = np.array([chr(i).isalnum() or i >= 128 for i in range(256)])
#: Classes of bytes, a row each: capitals, small letters, digits, symbols, points, blanks, beyond ASCII.
_CLASSES = np.zeros((7, 256))
for _row, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#$%&*|<>{}[]\\/=+_^~@", b".,;:!?", b" \t\n\r\x0b\x0c", range(128, 256))):
    _CLASSES[_row, list(_bytes)] = 1
_NOT_WORD = bytes(i for i in range(256) if not _ALNUM[i])


def _pieces(data: bytes):
    """The text in pieces that end at a blank."""
    at = 0
    while at < len(data):
        end = data.find(b" ", at + _PIECE) + 1 or len(data)
        yield data[at:end]
        at = end


def features(text: str | None) -> list[float]:
    data = (text or "").encode("utf-8", "replace")
    n, size, squares, again, wordless = 0, 0.0, 0.0, 0, 0
    words: Counter = Counter()
    pairs: set = set()
    codes, last = np.zeros(256), None
    for piece in _pieces(data):
        codes += np.bincount(np.frombuffer(piece, dtype=np.uint8), minlength=256)
        w = piece.split()
        if not w:
            continue
        lengths = np.fromiter(map(len, w), dtype=np.float64, count=len(w))
        n, size, squares = n + len(w), size + lengths.sum(), squares + (lengths**2).sum()
        words.update(w)
        before = w[:-1] if last is None else [last, *w[:-1]]
        after = w[1:] if last is None else w
        again += sum(map(eq, before, after))
        pairs.update(map(hash, zip(before, after, strict=True)))
        last = w[-1]
    wordless = sum(k for x, k in words.items() if not x.translate(None, _NOT_WORD))
    lines = [x for x in data.split(b"\n") if x]
    caps, small, digits, symbols, points, blanks, beyond = _CLASSES @ codes
    total, mean = max(1, len(data)), size / max(1, n)
    p = codes[codes > 0] / total
    return [
        float(np.log1p(n)), mean, float(np.sqrt(max(0.0, squares / max(1, n) - mean * mean))), len(words) / max(1, n),
        max(words.values(), default=0) / max(1, n), again / max(1, n - 1), len(pairs) / max(1, n - 1), wordless / max(1, n),
        caps / max(1, caps + small), digits / total, symbols / total, points / total, blanks / total, beyond / total,
        len(lines) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]


@dataclass
class Additive:
    """Log-odds = intercept + one table entry a feature + one a pair."""

    cuts: list[np.ndarray]
    coarse: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(cuts)], axis=1) if len(cuts) else np.zeros((len(x), 0), dtype=int)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        fine, rough = self.bins(x, self.cuts), self.bins(x, self.coarse)
        for i, t in enumerate(self.tables):
            out += t[fine[:, i]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            out += t[rough[:, i], rough[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.log_odds(x))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


_RIDGE = 1.0


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place (first bin of the right side) of the best cut of summed gradients and curvatures."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(gl):
        return 0.0, 0
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + _RIDGE) + gr**2 / (hr + _RIDGE) - g.sum() ** 2 / (h.sum() + _RIDGE)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(g.sum() / (h.sum() + _RIDGE))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of two levels over the bins: the value of each bin."""
    out = np.empty(len(g))
    gain, k = _best_cut(g, h)
    for side in (slice(0, k), slice(k, None)) if gain > 0 else (slice(None),):
        a, b = g[side], h[side]
        inner, m = _best_cut(a, b)
        part = np.empty(len(a))
        for s in (slice(0, m), slice(m, None)) if inner > 0 else (slice(None),):
            part[s] = _leaf(a[s], b[s])
        out[side] = part
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A cut along one axis, then one along the other in each half; the better of both orders: gain and values."""
    best = (-1.0, np.zeros_like(g))
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(1, a.shape[0]):
            gain, out = -(a.sum() ** 2) / (b.sum() + _RIDGE), np.empty_like(a)
            for rows in (slice(0, k), slice(k, None)):
                ga, hb = a[rows].sum(axis=0), b[rows].sum(axis=0)
                m = _best_cut(ga, hb)[1]
                for s in (slice(0, m), slice(m, None)):
                    gain += ga[s].sum() ** 2 / (hb[s].sum() + _RIDGE)
                    out[rows, s] = _leaf(ga[s], hb[s])
            if gain > best[0]:
                best = (gain, out.T.copy() if turn else out)
    return best


def _cuts(x: np.ndarray, most: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(c, np.arange(1, most) / most)) for c in x.T]


def learn(x: np.ndarray, y: np.ndarray, bins: int = 32, coarse: int = 8, pairs: int = 10, cycles: int = 300, pair_cycles: int = 60, rate: float = 0.1, patience: int = 20) -> Additive:
    """The model of rows ``x`` and labels ``y`` (0, 1). Every fifth row is kept aside to choose the number of cycles."""
    model = Additive(_cuts(x, bins) if len(x) else [], _cuts(x, coarse) if len(x) else [])
    one = float(y.sum())
    if one in (0.0, len(y)):
        share = (one + 0.5) / (len(y) + 1.0)
        model.cuts, model.coarse, model.intercept = [], [], float(np.log(share / (1 - share))) if len(y) else 0.0
        return model
    aside = np.arange(len(x)) % 5 == 4 if len(x) >= 50 else np.zeros(len(x), dtype=bool)
    share = float(y[~aside].mean())
    model.intercept = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    fine, rough = model.bins(x, model.cuts), model.bins(x, model.coarse)
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    z = np.full(len(x), model.intercept)

    def rest() -> tuple[np.ndarray, np.ndarray]:
        p = _sigmoid(z)
        return np.where(aside, 0.0, y - p), np.where(aside, 0.0, p * (1 - p))

    def loss() -> float:
        k = aside if aside.any() else ~aside
        return float(np.mean(np.logaddexp(0, z[k]) - y[k] * z[k]))

    def boost(tables: list[np.ndarray], cells: list[np.ndarray], fit, most: int) -> list[np.ndarray]:
        """Cycles over the tables until the rows aside have not gained for ``patience`` cycles: the tables of the best cycle."""
        best, kept, since = loss(), [t.copy() for t in tables], 0
        for _ in range(most):
            for t, cell in zip(tables, cells, strict=True):
                g, h = rest()
                value = fit(np.bincount(cell, g, t.size).reshape(t.shape), np.bincount(cell, h, t.size).reshape(t.shape))
                t += rate * value
                z[:] += rate * value.ravel()[cell]
            now = loss()
            if now < best - 1e-6:
                best, kept, since = now, [t.copy() for t in tables], 0
            elif (since := since + 1) >= patience:
                break
        for t, k, cell in zip(tables, kept, cells, strict=True):
            z[:] -= (t - k).ravel()[cell]
        return kept

    model.tables = boost(model.tables, list(fine.T), _tree, cycles)
    shape = [len(c) + 1 for c in model.coarse]
    cell_of = lambda i, j: rough[:, i] * shape[j] + rough[:, j]
    g, h = rest()
    gains = []
    for i, j in combinations(range(len(shape)), 2):
        if min(shape[i], shape[j]) > 1:
            size = (shape[i], shape[j])
            a, b = (np.bincount(cell_of(i, j), v, size[0] * size[1]).reshape(size) for v in (g, h))
            gains.append((-_pair_tree(a, b)[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains)[:pairs]]
    blank = [np.zeros((shape[i], shape[j])) for i, j in model.pairs]
    model.pair_tables = boost(blank, [cell_of(i, j) for i, j in model.pairs], lambda a, b: _pair_tree(a, b)[1], pair_cycles)
    # each table's mean over the sample goes to the intercept, so that an entry tells what it adds to the average
    for t, cell in zip([*model.tables, *model.pair_tables], [*fine.T, *[cell_of(i, j) for i, j in model.pairs]], strict=True):
        mean = float(t.ravel()[cell].mean())
        t -= mean
        model.intercept += mean
    return model


def with_features(docs: DataFrame, text: str = "text", out: str = "_features") -> DataFrame:
    @F.pandas_udf("array<double>")
    def run(t: pd.Series) -> pd.Series:
        return t.map(features)

    return docs.withColumn(out, run(text_of(text)))


def fit(rows: DataFrame, labels: DataFrame, doc: str = "doc_id", label: str = "quality", rows_a_label: int = 10_000, own: str | None = None, x: str = "_features") -> Additive:
    """``rows`` (``own`` or doc, features) and ``labels`` (doc, label) -> the model of a bounded sample of the labelled rows."""
    told = labels.where(F.col(doc).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(doc).alias("_d")).agg(F.max(label).cast("int").alias("_y"))
    order = F.xxhash64("_d")
    sampled = [told.where(F.col("_y") == k).orderBy(order, "_d").limit(rows_a_label) for k in (0, 1)]
    # the ids of the sample are bounded by its size; so are its rows, even where many share an id
    got = rows.join(F.broadcast(sampled[0].union(sampled[1])), F.col(own or doc) == F.col("_d")).select(F.col(x).alias("x"), "_y", order.alias("h"))
    got = got.orderBy("h", F.xxhash64("x")).limit(2 * rows_a_label).collect()
    wide = np.array([r["x"] for r in got], dtype=float).reshape(len(got), -1 if got else 0)
    return learn(wide, np.array([r["_y"] for r in got], dtype=float))


def scored(rows: DataFrame, model: Additive, x: str = "_features") -> DataFrame:
    """``rows`` with ``score`` and ``predicted``."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(v.to_numpy())) if len(v) else np.zeros(0))

    got = rows.withColumn("score", run(x))
    return got.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", learn_from=None, label: str = "quality", rows_a_label: int = 10_000, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns those in ``keep``, or all) with ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``. ``learn_from``: a condition on the
    ids of ``labels`` that may be learned from. Texts are read once; their features are written, and what is kept."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    rows = with_features(docs, text).select(F.col(doc).alias("_doc"), *keep, "_features")
    rows = materialise(rows, "quality-features")
    model = fit(rows, labels if learn_from is None else labels.where(learn_from), doc, label, rows_a_label, "_doc")
    return scored(rows, model).select(*keep, "score", "predicted")
