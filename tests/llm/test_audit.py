from collections import Counter, defaultdict

import numpy as np

from vocalith.llm import audit

from .tables import documents, empty, frame


def fails(text):
    """Failure letters A to D of a text, straight from their definition."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(w) < 100 else ""
    out += "B" if 100 * len(set(w)) < 80 * len(w) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text) else ""
    return out + ("D" if set("#$%&*|") & set(text) else "")


def plain(rows, labels):
    """Every order applied filter by filter to the documents themselves."""
    smallest = {}
    for r in rows:
        if r[0] is not None:
            smallest[r[1] or ""] = min(smallest.get(r[1] or "", r[0]), r[0])
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    docs = []
    for d, t, lang, *_ in rows:
        f = fails(t or "")
        if d is not None and smallest[t or ""] < d:
            f += "E"
        docs.append((lang or "", f, d in good, d in toxic))
    out = {}
    for part in {x[0] for x in docs}:
        own = [x for x in docs if x[0] == part]
        total = Counter()
        for order in audit.ORDERS:
            left = own
            for k, x in enumerate(order, 1):
                gone = [y for y in left if x in y[1]]
                before = [y for y in own if x in y[1] and y not in left]
                assert all(set(y[1]) & set(order[: k - 1]) for y in before)
                left = [y for y in left if x not in y[1]]
                total[x] += len(gone)
                redundant = sum(x in y[1] and bool(set(y[1]) & set(order[: k - 1])) for y in own)
                out[part, order, k] = [len(left), len(gone), redundant, sum(y[1] == x for y in own), sum(y[2] for y in gone), sum(y[3] for y in gone)]
        for order in audit.ORDERS:
            for k, x in enumerate(order, 1):
                out[part, order, k].append(total[x])
    return out


def told(got):
    return {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got}


def awkward():
    rng = np.random.default_rng(5)
    rows = documents()
    words = [f"w{i}" for i in range(400)]
    for i in range(60):
        text = " ".join(rng.choice(words, size=int(rng.integers(60, 140)), replace=bool(i % 2)))
        text += " | $" if i % 3 == 0 else ""
        rows.append((1000 + i, text.upper() if i % 5 == 0 else text, ["en", "de", "", None][i % 4], "s", 1, 7, 3, "x", 1, 0.5))
    # exact bounds: 99 and 100 words, 80 of 100 distinct, one capital in ten
    w = [f"x{i}" for i in range(100)]
    for i, t in enumerate([" ".join(w[:99]), " ".join(w), " ".join(w[:80] + w[:20]), " ".join(w[:79] + w[:21]), "Abcdefghij", "Abcdefghi", "\x0b\x0c", " "]):
        rows.append((2000 + i, t, "zz", "s", 1, 7, 3, "x", 1, 0.5))
    rows += [(None, rows[-1][1], "zz", *rows[-1][3:]), (-5, rows[140][1], "en", *rows[140][3:]), rows[141]]
    return rows


def test_against_plain_version(spark):
    rows = awkward()
    labels = [(r[0], i % 2, int(i % 7 == 0)) for i, r in enumerate(rows) if i % 3] + [(1001, 1, 0), (1001, 0, 1), (None, 1, 1), (1002, None, None)]
    got = told(audit.audit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect())
    assert got == plain(rows, [x for x in labels if x[0] is not None])


def test_table_of_first_failures():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for mask in range(32):
        f = [x for i, x in enumerate(audit.FILTERS) if mask >> i & 1]
        assert table[mask].tolist() == [next((k for k, x in enumerate(o) if x in f), 5) for o in audit.ORDERS]


def test_no_rows_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(empty(spark), labels).count() == 0
    got = audit.audit(frame(spark), labels).collect()
    assert len(got) == 600 * len({r["part"] for r in got}) and sum(r["good_lost"] + r["toxic_lost"] for r in got) == 0


def test_more_parts_than_a_task_keeps(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(audit, "_PARTS", 3)
    rng = np.random.default_rng(1)
    part, mask, label = [f"p{i}" for i in rng.integers(0, 9, 500)], rng.integers(0, 32, 500), rng.integers(0, 4, 500)
    batches = [pa.record_batch([pa.array(part[i : i + 50]), pa.array(mask[i : i + 50]), pa.array(label[i : i + 50])], names=["part", "mask", "label"]) for i in range(0, 500, 50)]
    sums = defaultdict(lambda: np.zeros(18, dtype=np.int64))
    for b in audit._count(iter(batches)):
        for p, o, n in zip(*b.to_pydict().values(), strict=True):
            sums[p, o] += n
    table = audit.first_failures()
    for (p, o), n in sums.items():
        want = np.zeros((3, 6), dtype=np.int64)
        for q, m, x in zip(part, mask, label, strict=True):
            if q == p:
                k = table[m, audit.ORDERS.index(o)]
                want[:, k] += [1, x & 1, x >> 1]
        assert n.tolist() == want.ravel().tolist()
