import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vocalith.llm import quality

from .tables import documents, empty, frame


def plain(text):
    """The features from their definition, letter by letter."""
    data = (text or "").encode()
    words = data.split()
    n, total = len(words), max(1, len(data))
    lengths = [len(w) for w in words] or [0]
    mean = sum(lengths) / max(1, n)
    c = Counter(words)
    count = lambda f: sum(1 for b in data if f(b))
    caps, small = count(lambda b: 65 <= b <= 90), count(lambda b: 97 <= b <= 122)
    lines = [x for x in data.split(b"\n") if x]
    share = [k / total for k in Counter(data).values()]
    alnum = lambda b: b >= 128 or chr(b).isalnum()
    return [
        math.log(1 + n), mean, math.sqrt(sum((x - mean) ** 2 for x in lengths) / max(1, n)) if n else 0, len(c) / max(1, n), max(c.values(), default=0) / max(1, n),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(1, n - 1), len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        sum(not any(alnum(b) for b in w) for w in words) / max(1, n), caps / max(1, caps + small), count(lambda b: 48 <= b <= 57) / total,
        count(lambda b: chr(b) in "#$%&*|<>{}[]\\/=+_^~@") / total, count(lambda b: chr(b) in ".,;:!?") / total, count(lambda b: chr(b) in " \t\n\r\x0b\x0c") / total,
        count(lambda b: b >= 128) / total, len(lines) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), -sum(p * math.log2(p) for p in share),
    ]


@pytest.mark.parametrize("piece", [1 << 22, 40])
def test_features_against_plain_version(monkeypatch, piece):
    monkeypatch.setattr(quality, "_PIECE", piece)
    for r in documents()[:60] + documents()[-12:]:
        t = (r[1] or "")[:4000]
        assert quality.features(t) == pytest.approx(plain(t), abs=1e-9), t
    assert quality.features("Straße | 12 $$ x x\n漢字 ... \n\nA a") == pytest.approx(plain("Straße | 12 $$ x x\n漢字 ... \n\nA a"))
    assert len(quality.features(None)) == len(quality.FEATURES)


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 4))
    model = quality.learn(x, ((x[:, 0] > 0) ^ (x[:, 1] > 0.2)).astype(float), pairs=3)
    more = np.concatenate([x[:50], rng.normal(size=(50, 4)) * 5])
    for row, z in zip(more, model.log_odds(more), strict=True):
        fine = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts, strict=True)]
        rough = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.coarse, strict=True)]
        want = model.intercept + sum(t[b] for t, b in zip(model.tables, fine, strict=True)) + sum(t[rough[i], rough[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert z == pytest.approx(want, abs=1e-9)


def test_pairs_tell_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 5))
    y = ((x[:, 1] > 0) ^ (x[:, 3] > 0)).astype(float)
    right = lambda m: np.mean((m.score(x[2000:]) >= 0.5) == (y[2000:] == 1))
    alone, both = quality.learn(x[:2000], y[:2000], pairs=0), quality.learn(x[:2000], y[:2000], pairs=2)
    assert right(alone) < 0.6 and right(both) > 0.95 and both.pairs[0] == (1, 3)


def test_single_features_follow_a_curve():
    rng = np.random.default_rng(2)
    x = rng.uniform(-3, 3, size=(6000, 3))
    p = 1 / (1 + np.exp(-(2 * np.sin(x[:, 0]) + x[:, 1])))
    y = (rng.uniform(size=6000) < p).astype(float)
    got = quality.learn(x[:4000], y[:4000], pairs=2).score(x[4000:])
    assert np.abs(got - p[4000:]).mean() < 0.06


def test_trees_are_the_best_of_their_kind():
    """Each tree against all trees of its kind."""
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=7), rng.uniform(0.1, 1, size=7)
    gain, k = quality._best_cut(g, h)
    of = lambda a, b: a.sum() ** 2 / (b.sum() + 1)
    every = {k: of(g[:k], h[:k]) + of(g[k:], h[k:]) - of(g, h) for k in range(1, 7)}
    assert gain == pytest.approx(max(every.values())) and every[k] == max(every.values())
    g2, h2 = rng.normal(size=(4, 5)), rng.uniform(0.1, 1, size=(4, 5))
    best = max(
        sum(of(a[r][:, s], b[r][:, s]) for r, m in ((slice(0, i), m1), (slice(i, None), m2)) for s in (slice(0, m), slice(m, None))) - of(g2, h2)
        for a, b in ((g2, h2), (g2.T, h2.T)) for i in range(1, len(a)) for m1 in range(1, a.shape[1]) for m2 in range(1, a.shape[1])
    )
    assert quality._pair_tree(g2, h2)[0] == pytest.approx(best)


def test_awkward_rows(spark):
    rows = documents()
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0)) for i, r in enumerate(rows)] + [(1, 7), (2, None), (None, 0)], "doc_id long, quality int")
    got = quality.classify(frame(spark, rows), labels).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    by_text = {}
    assert all(by_text.setdefault(r["text"] or "", r["score"]) == r["score"] for r in got)
    assert quality.classify(empty(spark), labels).count() == 0


def test_too_few_labels(spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(frame(spark), nothing).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    assert {r["predicted"] for r in quality.classify(frame(spark), ones).collect()} == {1}


def test_held_out_accuracy(spark):
    """On rows that were not learned from, with the query itself."""
    import duckdb

    from vocalith.llm import queries

    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op11_quality(spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet' JOIN (SELECT doc_id FROM '{sf}/documents.parquet') USING (doc_id)").fetchall()
    held = [(q, got[d]) for d, q in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 50 and all(r["held_out"] for _, r in held)
    right = {k: np.mean([r["predicted"] == q for q, r in held if q == k]) for k in (0, 1)}
    assert right[0] >= 0.9 and right[1] >= 0.98, right
