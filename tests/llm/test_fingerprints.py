import hashlib
from collections import Counter

import numpy as np

from vocalith.llm import fingerprints as fp

from .tables import documents, empty, frame


def test_digest_counts_triplets(monkeypatch):
    data = "Straße und Häuser, 123".encode() * 40
    want = np.zeros(256, dtype=int)
    for i in range(len(data) - 2):
        want[((data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 2654435761 % 2**32) >> 24] += 1
    assert (fp._counts(data) == want).all()
    whole = fp.digest(data)
    monkeypatch.setattr(fp, "_PIECE", 37)
    assert fp.digest(data) == whole and len(whole) == 130


def test_likeness_is_bounded_and_symmetric():
    a, b, c = (fp.digest(t.encode()) for t in ("the house of water " * 30, "the house of water " * 30 + "and light", "völlig anderes " * 50))
    assert fp.likeness(a, a) == 1.0
    assert 0 <= fp.likeness(a, c) < fp.likeness(a, b) <= 1 and fp.likeness(a, b) == fp.likeness(b, a)


def plain(spark, rows):
    """Each row with the next one, one by one, in the documented order."""
    keyed = frame(spark, rows).select("doc_id", "text", fp._order("doc_id", "text").alias("k")).collect()
    order = sorted(((r["doc_id"], r["text"] or "", r["k"]) for r in keyed), key=lambda r: r[2])
    assert [r[0] for r in order] == sorted((r[0] for r in rows), key=lambda d: (d is None, -(d or 0)))
    out = Counter()
    for (d, t, _), (_, n, _) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 3
        e = t[: len(t) - k] + n[:k]
        own, de = fp.digest(t.encode()), fp.digest(e.encode())
        out[d, len(t), hashlib.sha256(e.encode()).hexdigest(), own, de, round(fp.likeness(own, de), 6), round(fp.likeness(own, fp.digest(n.encode())), 6)] += 1
    return out


def test_neighbours(spark):
    rows = documents() + [(None, f"no id {i}", "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(40)] + [(8, f"one id {i % 9}", "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(60)]
    rows += [(-(2**63), "the least id", "en", "s", 1, 7, 3, "x", 1, 0.5), (2**63 - 1, "the greatest", "en", "s", 1, 7, 3, "x", 1, 0.5)]
    want = plain(spark, rows)
    for ranges in (1, 3, 40):
        assert Counter(map(tuple, fp.with_neighbours(frame(spark, rows), ranges=ranges).collect())) == want


def test_a_third_of_the_rows_is_one_row(spark):
    rows = documents() + [(50, "the same " * 20, "en", "s", 1, 7, 3, "x", 1, 0.5)] * 70
    assert Counter(map(tuple, fp.with_neighbours(frame(spark, rows), ranges=8).collect())) == plain(spark, rows)


def test_repeated_ids_one_document_and_none(spark):
    rows = [documents()[3]] * 3
    got = fp.with_neighbours(frame(spark, rows)).collect()
    assert len(got) == 3 and {r["near_next"] for r in got} == {1.0}
    assert fp.with_neighbours(frame(spark, rows[:1])).count() == 1
    assert fp.with_neighbours(empty(spark)).count() == 0
