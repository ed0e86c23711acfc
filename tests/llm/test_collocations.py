import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vocalith.llm import collocations as cl

from .tables import documents, empty, frame


def plain(rows, longest=3, least=10, share=50, top=2000):
    """From the definition: all phrases counted one by one, scores in whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            n[lang or "und"] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][w[i : i + k]] += 1
    out = set()
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = defaultdict(int)
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inner[p[i : i + k]] = max(inner[p[i : i + k]], a)
        best = []
        for p, a in found.items():
            if p in inner and 100 * inner[p] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.add((lang, rank, p.decode(), -a, left, right, n[lang], -s))
    return out


def corpus():
    rng = random.Random(4)
    rows = documents()
    words = "a b c d e f g é ß 漢 \U0001f600 the of".split()
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" "] * 6 + ["\t", "  ", ". ", ",", "\r\n", "\x0b", "?!", "  "]) for _ in range(60))
        rows.append((5000 + i, text.upper() if i % 4 == 0 else text, ["en", None, "und", "fr"][i % 4], "s", 1, 7, 3, "x", 1, 0.5))
    rows += [(6000, "of the end " * 50, "fr", "s", 1, 7, 3, "x", 1, 0.5)] * 3
    # the end of a longer phrase that nothing else holds, and one that is held half the time
    rows += [(6001, "qq rr ss. " * 12 + "tt uu vv ww; " * 11 + "yy zz. " * 12 + "xx yy zz! " * 12 + "yy aa. " * 13 + "xx yy aa! " * 12, "de", "s", 1, 7, 3, "x", 1, 0.5)]
    return rows


@pytest.mark.parametrize(("longest", "top"), [(3, 2000), (2, 5), (4, 2000)])
def test_against_plain_version(spark, longest, top):
    rows = corpus()
    got = cl.collocations(frame(spark, rows), longest=longest, top=top).collect()
    assert {tuple(r) for r in got} == plain(rows, longest, top=top) and len(got) == len({tuple(r) for r in got})


def test_long_pieces_in_stretches(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta epsilon".split()) for _ in range(9001)), "en") for i in range(2)]
    got = cl.collocations(spark.createDataFrame(rows, "doc_id long, text string, lang string"), buckets=3)
    assert {tuple(r) for r in got.collect()} == plain(rows)


def test_counts_survive_spilling():
    """More phrases than the memory of a task holds."""
    rng = random.Random(2)
    texts = [" ".join(f"word{rng.randrange(60_000)}x" for _ in range(40)) for _ in range(9000)]
    rows = [pa.record_batch([pa.array(["en"] * 1000), pa.array(texts[i : i + 1000]), pa.array([2] * 1000)], names=["part", "piece", "n"]) for i in range(0, 9000, 1000)]
    want = Counter()
    for t in texts:
        w = t.split(" ")
        want.update({"": 2 * len(w)})
        for k in (1, 2, 3):
            want.update({" ".join(w[i : i + k]): 0 for i in range(len(w) - k + 1)})
            for i in range(len(w) - k + 1):
                want[" ".join(w[i : i + k])] += 2
    blobs = list(cl._all_phrases(3, 5, "100MB")(iter(rows)))
    assert {b.column(0)[0].as_py() for b in blobs} == set(range(5))
    got = Counter()
    for k in range(5):
        own = [pa.record_batch([b.column(1)], names=["blob"]) for b in blobs if b.column(0)[0].as_py() == k]
        for b in cl._summer(1, "100MB")(iter(own)):
            part = dict(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
            assert not set(part) & set(got)
            got.update(part)
    assert got == want


def test_more_phrases_than_duckdb_counts_at_once(spark):
    """A task and a bucket get many times what duckdb can count up in its memory: both are cut."""
    words = "transform(sequence(1, 50), i -> concat('w', hex(pmod(xxhash64(id % 24000, i), 900000))))"
    found = spark.range(0, 36000, 1, 1).selectExpr("if(id % 3 = 0, 'en', 'de') AS part", f"array_join({words}, ' ') AS piece", "id % 2 + 1 AS n")
    got = cl.phrase_counts(found, longest=2, least=3, buckets=1, memory="20MB")
    w = found.selectExpr("part", "n", "split(piece, ' ') AS w")
    every = w.selectExpr("part", "n", "explode(w) AS phrase").union(w.selectExpr("part", "n", "explode(transform(sequence(1, size(w) - 1), i -> concat_ws(' ', w[i - 1], w[i])))"))
    want = every.groupBy("part", "phrase").agg(F.sum("n").alias("n")).where("n >= 3")
    want = want.union(w.groupBy("part").agg(F.sum(F.size("w") * F.col("n")).alias("n")).selectExpr("part", "''", "n"))
    assert want.count() > 100_000 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_full_filter_only_costs_time(spark):
    """With far fewer bits than phrases everything is let through, and the counts are the same."""
    rows = corpus()
    found = cl.pieces(frame(spark, rows))
    small, large = ({tuple(r) for r in cl.phrase_counts(found, 4, 2, filter_bits=n).collect()} for n in (1 << 15, 1 << 26))
    assert small == large and max(len(p.split(" ")) for _, p, _ in small) == 4


def test_filter_holds_every_frequent_phrase(spark):
    counts = spark.createDataFrame([("en", f"word{i} other{i % 7}", 10) for i in range(5000)] + [("en", "word1", 9), ("en", "", 9)], "part string, phrase string, n long")
    bits = cl.frequent_filter(counts, 2, 1 << 20)
    words = pa.array([w for i in range(6000) for w in (f"word{i}", f"other{i % 7}")])
    hit = cl._member(bits, cl._phrase_hashes(cl._hashed(pa.array(["en"] * 12_000)), cl._hashed(words), 2)[::2])
    assert hit[:5000].all() and hit[5000:].sum() < 20 and np.unpackbits(bits).sum() <= 10_000


def test_scores_beyond_64_bits(spark):
    rows = [(10**12, 3 * 10**12, 2 * 10**12 + 1), (999_999_999_989, 999_999_999_990, 999_999_999_991), (10, 10**13, 10**13), (7, 7, 7)]
    df = spark.createDataFrame(rows, "a long, l long, r long").select("a", "l", "r", cl.exact_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert all(r["s"] == 1_000_000 * r["a"] ** 2 // (r["l"] * r["r"]) for r in df.collect())


def test_empty(spark):
    assert cl.collocations(empty(spark)).count() == 0
