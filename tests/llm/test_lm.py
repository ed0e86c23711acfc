import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from vocalith.llm import attention, lm

from .tables import documents, empty, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


def is_held():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def tiny(seed=1, rows=9, groups=9, components=5, kinds=20):
    rng = np.random.default_rng(seed)
    r = lambda *s: rng.standard_normal(s).astype(np.float32)
    of_row = np.arange(kinds) % rows
    share = np.log(1 / np.bincount(of_row)[of_row]).astype(np.float32)
    prior, seen = np.full(rows, 1 / rows, np.float32), rng.random((rows, components)).astype(np.float32) * 9
    m = attention.Model((np.arange(kinds) % (groups - 2)).astype(np.int16), of_row, share, prior, seen, r(groups, 16), r(groups, 16), r(groups, 16), r(groups, 16), r(attention.WINDOW), r(16, components), r(components))
    m.query[:, 15], m.key[:, 15] = 1, 0
    m.key[m.pad] = 0
    m.key[m.pad, 15] = -1e4
    return m


def plain_logs(symbols, m):
    """Each symbol on its own: softmax over the inputs from the start of its window, no batches, no padding."""
    out = []
    inputs = [m.start] + [int(m.of_group[s]) for s in symbols[:-1]]
    for i, s in enumerate(symbols):
        first = max(0, (i // attention.STRIDE - 1) * attention.STRIDE)
        keys = inputs[first : i + 1]
        score = np.array([m.query[inputs[i]] @ m.key[k] + m.distance[i - first - j] for j, k in enumerate(keys)], dtype=float)
        a = np.exp(score - score.max())
        a /= a.sum()
        h = a @ m.value[keys] + m.residual[inputs[i]]
        weights = np.exp((h @ m.out + m.out_bias).astype(float))
        table = (m.seen + 20 * m.prior[:, None]) / (m.seen.sum(0) + 20)
        out.append(np.log(weights @ table[m.of_row[s]] / weights.sum()) + m.share[s])
    return out


def test_attention_scores_each_symbol_once_and_causally():
    m, rng = tiny(), np.random.default_rng(3)
    texts = [rng.integers(0, 20, n) for n in (1, 31, 32, 33, 64, 65, 150)]
    got = attention.symbol_logs(np.concatenate(texts), np.array([len(t) for t in texts]), m)
    want = np.concatenate([plain_logs(t, m) for t in texts])
    assert np.allclose(got, want, atol=1e-3)


def test_the_distribution_sums_to_one():
    m = tiny()
    for before in ([], [3, 5, 7], list(range(20)) * 4):
        total = sum(np.exp(plain_logs([*before, s], m)[-1]) for s in range(20))
        assert abs(total - 1) < 1e-5


def test_gradients_against_differences():
    m, rng = tiny(), np.random.default_rng(5)
    texts = [rng.integers(0, 20, n) for n in (5, 40, 70)]
    symbols, lengths = np.concatenate(texts), np.array([5, 40, 70])
    flat, rows, place = attention.layout(symbols, lengths, m)
    target = np.full(len(rows) * attention.STRIDE, -1, dtype=np.int32)
    target[place] = m.of_row[symbols]
    grads, _, _ = attention._gradients(np.concatenate([flat[rows - 1], flat[rows]], axis=1), target, m, m.components())
    loss = lambda: -float(attention.symbol_logs(symbols, lengths, m).astype(float).mean())
    for name in attention.WEIGHTS:
        x, g = getattr(m, name).reshape(-1), grads[name].reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            old = x[i]
            x[i] = old + 1e-2
            up = loss()
            x[i] = old - 1e-2
            down = loss()
            x[i] = old
            assert abs((up - down) / 2e-2 - g[i]) < 2e-3 + 0.05 * abs(g[i])


def test_training_learns_what_comes_next():
    rng = np.random.default_rng(0)
    kinds, lengths = 40, np.full(60, 120)
    text = np.concatenate([(rng.integers(0, 40) + np.arange(120) * 7) % 40 for _ in lengths]).astype(np.int32)
    counts, flags = np.bincount(text, minlength=kinds), np.zeros(kinds, dtype=bool)
    joint = np.zeros((kinds, 2 * kinds))
    np.add.at(joint, (text[1:], text[:-1]), 1)
    np.add.at(joint, (text[:-1], kinds + text[1:]), 1)
    m = attention.fresh(attention.classes(joint, np.arange(kinds), counts, flags, flags), counts, flags, flags)
    loss = [-attention.symbol_logs(text, lengths, m).mean()]
    for i in range(3):
        m = attention.train(m, [(text, lengths)] * 40, 0.02, seed=i)
        loss.append(-attention.symbol_logs(text, lengths, m).mean())
    assert loss[-1] < 0.5 * np.log(kinds) and loss[-1] < loss[1] < loss[0]


def test_split_words():
    words, n = lm.split_words(pa.array([" A  b\tÉc\n", None, "", "\x0b x\x0cy "]))
    assert words.to_pylist() == ["a", "b", "Éc", "x", "y"] and n.tolist() == [3, 0, 0, 2]


def test_squeezed_codes():
    for n in (0, 1, 1000):
        x = np.random.default_rng(n).integers(0, 2**31 - 1, n).astype(np.int32)
        assert (lm.unsqueeze(lm.squeeze(x), n) == x).all()


def test_vocabularies_travel_as_one_row_a_bucket(spark):
    """Not as one row a word; the buckets of a chunk tell of each different word once, with its number in training."""
    rows = [(i, " ".join(f"w{40 * i + k} all" for k in range(40)), "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(200)]
    stored = lm.chunk_corpus(frame(spark, rows).coalesce(1), "doc_id", "text", is_held()).where("kind = 0").orderBy("start").collect()
    assert 0 < len(stored) <= 256 and sum(r["k"] for r in stored) == 8001
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(200)]
    got = {w: int(n) for r in stored for w, n in zip(r["words"].split(" "), lm.unsqueeze(r["n"], r["k"]), strict=True)}
    assert got == {f"w{40 * i + k}": int(not held[i]) for i in range(200) for k in range(40)} | {"all": 40 * (200 - sum(held))}


def test_rows_are_added_by_index():
    rng = np.random.default_rng(4)
    for n, kinds in ((1, 1), (7, 1), (500, 3), (900, 400)):
        index, values = rng.integers(0, kinds, n).astype(np.int16), rng.standard_normal((n, 5)).astype(np.float32)
        got, want = np.ones((kinds, 5), np.float32), np.ones((kinds, 5))
        attention._add_rows(index, values, got)
        np.add.at(want, index, values)
        assert np.allclose(got, want, atol=1e-4)


def test_scores_word_by_word_and_cases(spark, monkeypatch):
    rows, made, train, share = documents(), {}, lm._train, lm._mixture_share
    monkeypatch.setattr(lm, "_train", lambda *a: made.setdefault("model", train(*a)))
    monkeypatch.setattr(lm, "_mixture_share", lambda *a: made.setdefault("m", share(*a)))
    got = lm.score(frame(spark, rows), PATH, is_held(), rates=(0.02, 0.01), per_task=40, chunk_bytes=3000, block=500).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    low = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [None]
    c = Counter(w for r in rows if not held(r[0]) for w in low(r[1]))
    n, v, m, s = sum(c.values()), len(c), made["m"], lm.subwords(PATH)
    u = (sum(x == 1 for x in c.values()) + 1) / (n + 2)
    assert 0 < m < 1

    def plain(words):
        spelled = [s([w])[0] if w is not None else np.array([s.end]) for w in words]
        logs = plain_logs(np.concatenate(spelled), made["model"]) if len(words) < 100 else None
        if logs is None:
            return None
        total, at = 0.0, 0
        for w, x in zip(words, spelled, strict=True):
            a, b = np.exp(sum(logs[at : at + len(x)])), (c[w] + 1) / (n + v + 1)
            total += math.log10(m * b + (1 - m) * ((1 - u) * a if c[w] else u))
            at += len(x)
        return total

    want, scores = Counter(), {}
    for r in rows:
        words = low(r[1])
        want[r[0], held(r[0]), len(words), sum(c[w] > 0 for w in words), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), 4)] += 1
        scores[r[0]] = plain(words)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    for r in got:
        assert r["train_tokens"] == n and r["score"] < 0
        assert scores[r["doc_id"]] is None or abs(r["score"] - scores[r["doc_id"]]) < 1e-2
    assert lm.score(empty(spark), PATH, is_held()).count() == 0


def test_several_tasks_are_one_training(spark):
    docs = frame(spark, documents())
    got = lm.score(docs, PATH, is_held(), rates=(0.02, 0.01), per_task=4, part=1.0).collect()
    gain = sum(r["score"] - r["base_score"] for r in got if r["held_out"])
    assert len(got) == docs.count() and gain > 0


def test_the_share_is_judged_on_texts_of_any_length(spark, monkeypatch):
    """Where all texts are longer than what is taken of one, the share is still found, and what is taken has whole words."""
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(400)), "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(60)]
    judged, symbols = [], lm._symbols_of
    monkeypatch.setattr(lm, "_symbols_of", lambda texts, path: (judged.extend(texts.to_pylist()), symbols(texts, path))[1])
    assert len(lm.score(frame(spark, rows), PATH, is_held(), rates=(), longest=100).collect()) == 60
    assert len(judged) > 2 and all(0 < len(t) <= 100 and any(f" {t.strip()} " in f" {r[1]} " for r in rows) for t in judged)


def test_better_than_counts_of_words(spark):
    """On held-out texts the model beats the unigram with the same probability of unknown words, by the tenth of a
    decimal digit a token that the attention alone is worth, not only the base."""
    import duckdb

    from vocalith.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    low = lambda t: [*(t or "").encode().lower().split(), None]
    c = Counter(w for d, t in docs if not held(d) for w in low(t))
    n = sum(c.values())
    new = (sum(x == 1 for x in c.values()) + 1) / (n + 2)
    plain = sum(math.log10((1 - new) * c[w] / n if c[w] else new) for d, t in docs if held(d) for w in low(t))
    got = [r for r in queries.op7_lm_scoring(spark, sf).collect() if r["held_out"]]
    assert (sum(r["score"] for r in got) - plain) / sum(r["n_tokens"] for r in got) > 0.1


def test_every_training_document_is_learned_from(spark, monkeypatch):
    """Rounds share out the whole range of hashes, and words, symbols, neighbours, components and the mixture's share hear of
    each training document, however many there are for a task."""
    for n, n_train in ((4, 10**7), (3, 7001), (2, 5), (6, 123_457)):
        least, parts = lm._rounds(n, n_train, 1500)
        edges = {u % lm._HASHES for a, size in parts for u in (a - 1, a, a + size - 1, a + size)}
        assert all(any((u - a) % lm._HASHES < size for a, size in parts) for u in edges) and sum(size for _, size in parts) >= lm._HASHES
        assert least >= lm._HASHES * min(1, 1400 / n_train)
    rows = [(i, " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(9)), "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(3000)]
    made, train, near = {}, lm._train, lm._neighbours
    monkeypatch.setattr(lm, "_train", lambda *a: made.setdefault("model", train(*a)))
    monkeypatch.setattr(lm, "_neighbours", lambda *a: made.setdefault("near", near(*a)))
    got = lm.score(frame(spark, rows), PATH, is_held(), rates=(0.02, 0.02, 0.01, 0.004), per_task=300, chunk_bytes=20_000).collect()
    learned = [r for r in got if not r["held_out"]]
    tokens = sum(r["n_tokens"] for r in learned)
    assert tokens == got[0]["train_tokens"] and len(learned) > 2500
    assert round(made["model"].judged.sum(), 3) == tokens  # each token once
    s = lm.subwords(PATH)
    words = {w for r in rows for w in r[1].split()}
    spelled = {w: len(s([w])[0]) for w in words}
    held = {r["doc_id"] for r in got if r["held_out"]}
    symbols = sum(1 + sum(spelled[w] for w in r[1].split()) for r in rows if r[0] not in held)
    assert made["near"][1].sum() == 2 * (symbols - len(learned))  # all symbols but one of each text have one before, and one after
    # what the components have seen in the rounds that share the documents out
    assert symbols <= made["model"].seen.sum() < 1.5 * symbols + 200 * attention.COMPONENTS
