"""A small causal self-attention language model over subword symbols, trained and run in numpy.

A symbol is a subword id with a flag for the last subword of its word, so the symbols of a word are a
prefix-free code and word probabilities are products of symbol probabilities. Attention gives the weights of
COMPONENTS distributions over all symbols, and their mixture is the next symbol's distribution: it sums to 1 over the
whole vocabulary at the price of a softmax over the components. The commonest symbols have a row of their own in the
table of components; the others share four rows, by whether they begin and end a word, and split them by their
corpus counts. Inputs are symbol groups: the most frequent symbols alone, the others by class.

One head, one layer: each group has a query, key, value and residual vector; scores have a bias by distance.
Windows hold 2 * STRIDE inputs and overlap by half: the first half is context, the second half is scored, so
every symbol is scored once, with at least STRIDE earlier symbols where the text has them.

The weights learn by gradient steps (Adam), the components by expectation maximisation on the same windows: a
component counts the symbols it is held responsible for. ``train`` goes once over a stream of texts and works from
any model, so tasks can train on their own texts and have their weights averaged and their counts added.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

import numpy as np

STRIDE = 32
WINDOW = 2 * STRIDE
WIDTH = 16
CLASSES, COMPONENTS = 48, 64
#: Symbols with an input vector of their own, and with a row of their own in the table of components.
ALONE, ROWS = 1000, 8192
#: One dimension of the keys holds the mask of the padding.
_KEYS = WIDTH - 1
_MASK = -1e4
_BATCH, _EVERY, _PRIOR = 256, 10, 20.0
#: So many steps are taken on an eighth of a batch each: few texts are some steps too.
_SLOW = 64
#: Windows whose gradients are taken at a time: what they need stays in the processor's cache.
_AT_ONCE = 64
#: So many rows of one index are added up at a time.
_RUN = 8
_AHEAD = np.arange(WINDOW)[None, :] > np.arange(STRIDE)[:, None] + STRIDE
_DISTANCE = np.clip(np.arange(STRIDE)[:, None] + STRIDE - np.arange(WINDOW)[None, :], 0, WINDOW - 1)
_ONES = np.ones(256, dtype=np.float32)
_BIAS = np.where(_AHEAD, np.float32(_MASK), np.float32(0))

#: What is learned by gradient steps.
WEIGHTS = ("query", "key", "value", "residual", "distance", "out", "out_bias")


@dataclass
class Model:
    """``of_group``, ``of_row``: by symbol; ``share``: ln of the symbol's part of its row; ``prior``: the corpus share of
    each row; ``seen``: how often each component (column) was held responsible for each row; ``judged``: what training leaves for its caller."""

    of_group: np.ndarray
    of_row: np.ndarray
    share: np.ndarray
    prior: np.ndarray
    seen: np.ndarray
    query: np.ndarray
    key: np.ndarray
    value: np.ndarray
    residual: np.ndarray
    distance: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    _safe: bool | None = None
    judged: np.ndarray | None = None

    @property
    def pad(self) -> int:
        return len(self.query) - 1

    @property
    def start(self) -> int:
        return len(self.query) - 2

    def components(self) -> np.ndarray:
        """P(row | component), rows x components."""
        return ((self.seen + _PRIOR * self.prior[:, None]) / (self.seen.sum(0) + _PRIOR)).astype(np.float32)

    def safe(self) -> bool:
        """Whether no exponential can overflow: a bound on all scores and logits, kept until the weights change."""
        if self._safe is None:
            far = lambda x: float(np.sqrt((x**2).sum(-1)).max())
            inside = np.delete(self.key, self.pad, axis=0)
            score = far(self.query) * far(inside) + float(np.abs(self.distance).max())
            logit = (far(self.value) + far(self.residual)) * far(self.out.T) + float(np.abs(self.out_bias).max())
            self._safe = max(score, logit) < 80
        return self._safe

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in (*WEIGHTS, "seen")]).astype(np.float32)

    def with_flat(self, x: np.ndarray) -> Model:
        parts, at = {}, 0
        for k in (*WEIGHTS, "seen"):
            old = getattr(self, k)
            parts[k] = x[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return replace(self, **parts, _safe=None)


def layout(symbols: np.ndarray, lengths: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts' symbols laid out in rows of STRIDE: input groups, the rows that are scored, and each symbol's place.

    A text of n symbols has one row of padding, then ceil(n / STRIDE) rows: the start mark and its symbols but
    the last. Row r and the one before it are a window; place is the symbol's position among the scored rows.
    """
    rows = -(-lengths // STRIDE)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(symbols), dtype=np.int32)
    place += np.repeat(((np.cumsum(rows) - rows) * STRIDE - starts).astype(np.int32), lengths)
    inputs = np.empty(len(symbols), dtype=np.int16)
    inputs[1:] = model.of_group[symbols[:-1]]
    inputs[starts[lengths > 0]] = model.start
    flat = np.full(int((rows + 1).sum()) * STRIDE, model.pad, dtype=np.int16)
    flat[place + np.repeat(((np.arange(len(lengths)) + 1) * STRIDE).astype(np.int32), lengths)] = inputs
    scored = np.ones(len(flat) // STRIDE, dtype=bool)
    scored[np.cumsum(rows + 1) - rows - 1] = False
    return flat.reshape(-1, STRIDE), np.flatnonzero(scored), place


class _Room:
    """Arrays that batches of one size use in turn: memory is touched once, and stays in the processor's cache."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        size = math.prod(shape)
        if name not in self.held or self.held[name].size < size:
            self.held[name] = np.empty(size, dtype=np.float32)
        return self.held[name][:size].reshape(shape)


def _exp(x: np.ndarray, safe: bool) -> np.ndarray:
    """In place, guarded against overflow unless ``safe``."""
    return np.exp(x if safe or not x.size or x.max() <= 60 else np.minimum(x, 60, out=x), out=x)


def _attend(x: np.ndarray, m: Model, room: _Room):
    """Windows of groups (n, WINDOW) -> queries, keys, values, weights (n, STRIDE, WINDOW) not yet divided by their sums, these sums,
    what attention gives, and hidden vectors (n, STRIDE, WIDTH + 1), the last of which is 1."""
    own, n = x[:, STRIDE:], len(x)
    queries, keys, values = m.query.take(own, axis=0), m.key.take(x, axis=0), m.value.take(x, axis=0)
    scores = np.matmul(queries, keys.transpose(0, 2, 1), out=room("scores", n, STRIDE, WINDOW))
    scores += _BIAS + m.distance[_DISTANCE]
    _exp(scores, m.safe())
    sums = (scores @ _ONES[:WINDOW] + np.float32(1e-30))[:, :, None]
    given = np.matmul(scores, values, out=room("given", n, STRIDE, WIDTH))
    given /= sums
    hidden = room("hidden", n, STRIDE, WIDTH + 1)
    np.add(given, m.residual.take(own, axis=0), out=hidden[:, :, :WIDTH])
    hidden[:, :, WIDTH] = 1
    return queries, keys, values, scores, sums, given, hidden


def _mixture(hidden: np.ndarray, out: np.ndarray, m: Model, room: _Room) -> np.ndarray:
    """Weights of the components, not yet divided by their sum; ``out``: the model's, with its bias as the last row."""
    h = hidden.reshape(-1, WIDTH + 1)
    return _exp(np.matmul(h, out, out=room("mixture", len(h), out.shape[1])), m.safe())


def _with_bias(m: Model) -> np.ndarray:
    return np.concatenate([m.out, m.out_bias[None, :]])


def symbol_logs(symbols: np.ndarray, lengths: np.ndarray, m: Model, table: np.ndarray | None = None, block: int = 64) -> np.ndarray:
    """ln P(symbol | earlier symbols of its text in the window) for the symbols of many texts laid end to end."""
    if not len(symbols):
        return np.zeros(0, dtype=np.float32)
    table = m.components() if table is None else table
    flat, rows, place = layout(symbols, lengths, m)
    targets = np.zeros(len(rows) * STRIDE, dtype=np.int32)
    targets[place] = m.of_row[symbols]
    out, room, mixed = np.empty(len(targets), dtype=np.float32), _Room(), _with_bias(m)
    for a in range(0, len(rows), block):
        r = rows[a : a + block]
        *_, h = _attend(np.concatenate([flat[r - 1], flat[r]], axis=1), m, room)
        weights = _mixture(h, mixed, m, room)
        at = slice(a * STRIDE, (a + len(r)) * STRIDE)
        np.divide(np.einsum("ij,ij->i", weights, table.take(targets[at], axis=0)), weights @ _ONES[: weights.shape[1]], out=out[at])
    out += np.float32(1e-37)
    return np.log(out, out=out)[place] + m.share[symbols]


def classes(joint: np.ndarray, top: np.ndarray, counts: np.ndarray, initial: np.ndarray, final: np.ndarray, seed: int = 7) -> np.ndarray:
    """Classes of symbols by the company they keep: k-means on a spectral embedding of neighbour counts.

    ``joint``: for each of the commonest symbols ``top`` how often which symbols stand before and after it. All other
    symbols fall in four classes by whether they begin and end a word.
    """
    rng = np.random.default_rng(seed)
    out = initial.astype(np.int16) + 2 * final
    k = min(CLASSES - 4, len(top))
    if not k:
        return out
    weight = np.sqrt(counts[top])
    expected = joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True) / max(1.0, joint.sum())
    lift = np.log(np.maximum(1.0, (joint + 0.1) / (expected + 0.1)))
    u, s, _ = np.linalg.svd(lift, full_matrices=False)
    x = u[:, :24] * np.sqrt(s[:24])
    x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-9
    centre = x[rng.choice(len(x), k, replace=False, p=weight / weight.sum())]
    for _ in range(15):
        near = (x @ centre.T).argmax(1)
        for c in range(k):
            if (near == c).any():
                centre[c] = np.average(x[near == c], axis=0, weights=weight[near == c])
        centre /= np.linalg.norm(centre, axis=1, keepdims=True) + 1e-9
    out[top] = near + 4
    return out


def fresh(of_class: np.ndarray, counts: np.ndarray, initial: np.ndarray, final: np.ndarray, seed: int = 7) -> Model:
    """An untrained model. ``counts``: of every symbol over the whole training corpus."""
    rng = np.random.default_rng(seed)
    order = np.argsort(-counts, kind="stable")
    some = int((counts > 0).sum())
    alone, own = min(ALONE, some), min(ROWS, some)
    of_group = (alone + of_class).astype(np.int16)
    of_group[order[:alone]] = np.arange(alone)
    of_row = (own + initial + 2 * final).astype(np.int32)
    of_row[order[:own]] = np.arange(own)
    smooth = counts + 0.1
    by_row = np.bincount(of_row, weights=smooth, minlength=own + 4)
    prior = (by_row / by_row.sum()).astype(np.float32)
    seen = np.zeros((own + 4, COMPONENTS), dtype=np.float32)
    for k in range(COMPONENTS):  # each class begins as two components, told apart by chance
        part = np.bincount(of_row, weights=np.where(of_class == k % CLASSES, smooth, 0.0), minlength=own + 4) * np.exp(0.3 * rng.standard_normal(own + 4))
        seen[:, k] = 200 * (0.8 * part / part.sum() + 0.2 * prior) if part.sum() > 0 else 200 * prior
    groups = alone + CLASSES + 2
    init = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    m = Model(of_group, of_row, np.log(smooth / by_row[of_row]).astype(np.float32), prior, seen, init(groups, WIDTH), init(groups, WIDTH), init(groups, WIDTH), init(groups, WIDTH), np.zeros(WINDOW, np.float32), init(WIDTH, COMPONENTS), np.zeros(COMPONENTS, np.float32))
    m.query[:, _KEYS], m.key[:, _KEYS] = 1.0, 0.0
    m.key[m.pad] = 0.0
    m.key[m.pad, _KEYS] = _MASK
    return m


def _add_rows(index: np.ndarray, values: np.ndarray, into: np.ndarray) -> None:
    """Adds the rows of ``values`` to the rows ``index`` of ``into``. The rows of one index are added in runs of up to _RUN, as sums
    of whole arrays, then those of several runs."""
    by = np.argsort(index, kind="stable")
    keys = index[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    many = np.diff(np.append(first, len(keys)))
    runs = -(-many // _RUN)
    at = np.cumsum(runs) - runs  # the first run of each index
    begin = np.arange(int(runs.sum())) * _RUN + np.repeat(first - at * _RUN, runs)
    sizes = np.minimum(np.repeat(first + many, runs) - begin, _RUN).astype(np.int8)
    order = np.argsort(-sizes, kind="stable")
    begin, place = begin[order], np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    total = values.take(by.take(begin), axis=0)
    for i in range(1, _RUN):
        n = np.count_nonzero(sizes > i)
        total[:n] += values.take(by.take(begin[:n] + i), axis=0)
    one = runs == 1
    into[keys[first[one]]] += total.take(place[at[one]], axis=0)
    if not one.all():
        rows, left = place[np.repeat(~one, runs)], runs[~one]
        into[keys[first[~one]]] += np.add.reduceat(total.take(rows, axis=0), np.cumsum(left) - left, axis=0)


class _Sums:
    """Gradients over the batches of a step: by place those of the groups' vectors (value and key of what is seen, residual and query
    of what sees), else summed. What each component was held responsible for as well, by place."""

    def __init__(self, m: Model, windows: int):
        self.sides = np.zeros((windows * (WINDOW + STRIDE), 2 * WIDTH), dtype=np.float32)
        self.post = np.zeros((windows * STRIDE, m.out.shape[1]), dtype=np.float32)
        self.out, self.distance = np.zeros((WIDTH + 1, m.out.shape[1]), dtype=np.float32), np.zeros((STRIDE, WINDOW), dtype=np.float32)
        self.index, self.rows, self.at, self.posts = [], [], 0, 0

    def place(self, x: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of groups put what belongs to the groups' vectors."""
        n = len(x)
        middle, end = self.at + n * WINDOW, self.at + n * (WINDOW + STRIDE)
        self.index += [x.ravel(), x[:, STRIDE:].ravel() + np.int16(len(m.query))]
        out = self.sides[self.at : middle].reshape(n, WINDOW, -1), self.sides[middle:end].reshape(n, STRIDE, -1)
        self.at = end
        return out

    def place_post(self, y: np.ndarray) -> np.ndarray:
        self.rows.append(np.maximum(y, 0).astype(np.int16))
        self.posts += len(y)
        return self.post[self.posts - len(y) : self.posts]

    def taken(self, m: Model, real: int) -> dict[str, np.ndarray]:
        """The gradients of the mean over ``real`` places; what the components saw is added to the model's. The sums are 0 again."""
        groups = np.zeros((2 * len(m.query), 2 * WIDTH), dtype=np.float32)
        _add_rows(np.concatenate(self.index), self.sides[: self.at], groups)
        _add_rows(np.concatenate(self.rows), self.post[: self.posts], m.seen)
        groups /= np.float32(real)
        sides, owns = groups[: len(m.query)], groups[len(m.query) :]
        owns[:, WIDTH + _KEYS] = 0
        sides[:, WIDTH + _KEYS] = 0
        sides[m.pad, WIDTH:] = 0
        out = self.out / np.float32(real)
        by_distance = np.bincount(_DISTANCE.ravel(), weights=self.distance.ravel() / real, minlength=WINDOW).astype(np.float32)
        self.out[...], self.distance[...] = 0, 0
        self.index, self.rows, self.at, self.posts = [], [], 0, 0
        return {"out": out[:WIDTH], "out_bias": out[WIDTH], "residual": owns[:, :WIDTH], "value": sides[:, :WIDTH], "query": owns[:, WIDTH:], "key": sides[:, WIDTH:], "distance": by_distance}


def _add_gradients(x: np.ndarray, y: np.ndarray, m: Model, table: np.ndarray, sums: _Sums, room: _Room) -> np.ndarray:
    """Adds the gradients of the summed loss, and the responsibility of each component at each place (none at those that
    are not real, y < 0), to ``sums``; P(row) at all places."""
    n = len(x)
    queries, keys, values, a, whole, given, h = _attend(x, m, room)
    p = _mixture(h, _with_bias(m), m, room)
    post = np.multiply(p, table.take(y, axis=0, mode="clip"), out=sums.place_post(y))
    weight, chance = p @ _ONES[: p.shape[1]], post @ _ONES[: p.shape[1]]
    chance += np.float32(1e-37) * weight
    real = (y >= 0).astype(np.float32)
    p *= (real / weight)[:, None]
    post *= (real / chance)[:, None]
    p -= post
    sums.out += (p.T @ h.reshape(n * STRIDE, -1)).T
    dh = (p @ m.out.T).reshape(n, STRIDE, WIDTH)
    # weights of attention stay undivided: what they are multiplied with is divided by their sums
    part = dh / whole
    ds = np.matmul(part, values.transpose(0, 2, 1), out=room("ds", n, STRIDE, WINDOW))
    # sum over a row of weights times their gradients: what attention alone gives, times dh
    ds -= np.einsum("nij,nij->ni", part, given)[:, :, None]
    ds *= a
    side, mine = sums.place(x, m)
    np.matmul(a.transpose(0, 2, 1), part, out=side[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), queries, out=side[:, :, WIDTH:])
    mine[:, :, :WIDTH] = dh
    np.matmul(ds, keys, out=mine[:, :, WIDTH:])
    sums.distance += (_ONES[:n] @ ds.reshape(n, -1)).reshape(STRIDE, WINDOW)
    return chance / weight


def _gradients(x: np.ndarray, y: np.ndarray, m: Model, table: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean loss of some windows, what each component saw of each row, and P(row) at all places."""
    sums, m = _Sums(m, len(x)), replace(m, seen=np.zeros_like(m.seen))
    chance = _add_gradients(x, y, m, table, sums, _Room())
    return sums.taken(m, max(1, np.count_nonzero(y >= 0))), m.seen, chance


def train(m: Model, texts: Iterable[tuple[np.ndarray, np.ndarray]], rate: float, keep: float = 0.9, seed: int = 1, heard: Callable[[np.ndarray], None] | None = None) -> Model:
    """One pass over blocks of texts (symbols end to end, lengths): a step for every _BATCH windows (fewer at first), in random order.

    ``keep``: what the components' counts are multiplied with every _EVERY steps, 1 to forget nothing. ``heard`` gets
    ln P of each symbol of a block, as it was before its window was learned from.
    """
    m = m.with_flat(m.flat())
    rng, step, table = np.random.default_rng(seed), 0, m.components()
    mean, square = ({k: np.zeros_like(getattr(m, k)) for k in WEIGHTS} for _ in range(2))
    sums, room = _Sums(m, _BATCH), _Room()
    for symbols, lengths in texts:
        if not len(symbols):
            continue
        flat, rows, place = layout(symbols, lengths, m)
        target = np.full(len(rows) * STRIDE, -1, dtype=np.int32)
        target[place] = m.of_row[symbols]
        target, chances = target.reshape(-1, STRIDE), np.empty((len(rows), STRIDE), dtype=np.float32)
        turns = rng.permutation(len(rows))
        at = 0
        while at < len(turns):
            r, step = turns[at : at + (_BATCH if step >= _SLOW else _BATCH // 8)], step + 1
            at += len(r)
            for q in (r[i : i + _AT_ONCE] for i in range(0, len(r), _AT_ONCE)):
                y = target[q].ravel()
                chances[q] = _add_gradients(np.concatenate([flat[rows[q] - 1], flat[rows[q]]], axis=1), y, m, table, sums, room).reshape(-1, STRIDE)
            grads = sums.taken(m, max(1, np.count_nonzero(target[r] >= 0)))
            if step % _EVERY == 0:
                table = m.components()
                if keep < 1:
                    m.seen *= keep
            now = rate * min(1.0, step / 20)
            for k in WEIGHTS:
                mean[k] += 0.1 * (grads[k] - mean[k])
                square[k] += 0.01 * (grads[k] ** 2 - square[k])
                getattr(m, k)[...] -= now * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            m._safe = False  # weights move: always guarded while training
        if heard:
            heard(np.log(chances.ravel()[place]) + m.share[symbols])
    m._safe = None
    return m
