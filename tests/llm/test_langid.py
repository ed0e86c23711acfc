import zlib

import numpy as np
import pytest

from vocalith.llm import langid

from .tables import documents, empty, frame


def test_kernel_is_the_share_of_common_ngrams():
    bits, has = langid.presence(["abc", "abd", None, "12", "x"])
    k = langid._scaled(bits) @ langid._scaled(bits).T
    grams = lambda t, n: {f" {t} "[i : i + n] for i in range(len(t) + 3 - n)}
    want = np.mean([len(grams("abc", n) & grams("abd", n)) / np.sqrt(len(grams("abc", n)) * len(grams("abd", n))) for n in (1, 2, 3)])
    assert abs(k[0, 1] - want) < 1e-6 and abs(k[0, 0] - 1) < 1e-6
    assert has.tolist() == [True, True, False, False, True]


def test_pieces_of_a_long_text_agree_with_the_whole(monkeypatch):
    texts = [" ".join(f"wort{i % 91} häuser" for i in range(400)), "12 " * 99 + "é", "a" + " 7" * 80, "x" * 99 + " " + "y" * 120, " " * 250 + "z", "1" * 300, "ab" * 50]
    whole, has = langid.presence(texts)
    for size in (7, 50, 99, 100, 101):
        monkeypatch.setattr(langid, "_PIECE", size)
        parts, found = langid.presence(texts)
        assert (parts == whole).all() and (found == has).all()


def test_letters_of_every_plane():
    assert langid.presence([chr(0x30001), chr(0x2EBF0), chr(0xE0041)])[1].tolist() == [True, True, False]


def test_too_many_languages_are_refused(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i}") for i in range(30)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError):
        langid.fit(docs, at_most=40)


def test_held_out_accuracy_and_edge_cases(spark):
    docs = frame(spark)
    model = langid.fit(docs.where("doc_id is null or crc32(cast(doc_id as string)) % 4 <> 2"))
    got = langid.predict(docs, model).collect()
    assert len(got) == len(documents())
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 120 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and r["lang"]]
    assert len(held) > 15 and all(r["lang"] == r["lang_pred"] for r in held)
    for r in got:
        assert 0 <= r["score"] <= 1
        if not r["text"] or not any(c.isalpha() for c in r["text"]):
            assert r["lang_pred"] == "und" and r["score"] == 0
    by_text = {}
    for r in got:
        by_text.setdefault(r["text"], set()).add((r["lang_pred"], r["score"]))
    assert all(len(v) == 1 for v in by_text.values())


def test_nothing_labelled_and_empty(spark):
    assert langid.fit(empty(spark)).languages == []
    got = langid.predict(frame(spark), langid.fit(empty(spark))).collect()
    assert {r["lang_pred"] for r in got} == {"und"}
    assert langid.predict(empty(spark), langid.fit(frame(spark))).count() == 0


def test_model_is_kernel_ridge_regression():
    """With every text a landmark the map loses nothing, so the outputs are those of the dual solution over the kernel
    itself: (W K + r n I) a + W 1 b = W y and 1' W (K a + b - y) = 0."""
    rng = np.random.default_rng(4)
    letters = {"a": "abcdefg", "b": "fghijkl", "c": "klmnopq"}
    make = lambda g, n: " ".join("".join(rng.choice(list(letters[g]), size=int(rng.integers(2, 7)))) for _ in range(n))
    labels = [g for g in "aaaaaaaabbbbbccc" for _ in range(3)]
    texts = [make(g, 12) for g in labels]
    bits, _ = langid.presence(texts)
    model = langid.fit_arrays(bits, labels, landmarks=len(texts), ridge=1e-2)
    new = [make(g, 5) for g in "abc"]
    sets = [set(np.flatnonzero(b).tolist()) for b in np.concatenate([bits, langid.presence(new)[0]])]

    def kernel(s, t):
        parts = [({x for x in s if lo <= x < hi}, {x for x in t if lo <= x < hi}) for lo, hi in zip(langid._EDGE, langid._EDGE[1:], strict=False)]
        return np.mean([len(a & b) / np.sqrt(len(a) * len(b)) for a, b in parts])

    n = len(texts)
    k = np.array([[kernel(s, t) for t in sets[:n]] for s in sets])
    w = np.array([n / 3 / labels.count(g) for g in labels])
    y = np.array([[1.0 if g == c else -1.0 for c in "abc"] for g in labels])
    system = np.block([[w[:, None] * k[:n] + 1e-2 * n * np.eye(n), w[:, None]], [(w @ k[:n])[None], np.array([[w.sum()]])]])
    solved = np.linalg.solve(system, np.vstack([w[:, None] * y, (w @ y)[None]]))
    want = k @ solved[:-1] + solved[-1]
    assert np.abs(model.scores(texts + new)[0] - want).max() < 2e-3 and want[n:].argmax(axis=1).tolist() == [0, 1, 2]


def test_landmarks_are_spread_over_the_languages():
    bits, _ = langid.presence([f"text {chr(97 + i % 26)}x{chr(97 + i // 26)}" for i in range(60)])
    model = langid.fit_arrays(bits, ["x"] * 50 + ["y"] * 10, landmarks=16)
    rows = [np.packbits(b).tobytes() for b in bits]
    told = [rows.index(m.tobytes()) >= 50 for m in model.landmarks]
    assert len(told) == 16 and sum(told) == 8
