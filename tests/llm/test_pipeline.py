import random
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline as cp
from vocalith.llm import langid

from .tables import documents, empty, frame
from .test_linededup import plain


def one_of_each(rows):
    """Ids of the documents that stay: of each group of texts linked by a Jaccard similarity of 0.8 of their five-word
    shingles the one of the smallest id, null last."""
    words = [t.encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    groups = defaultdict(list)
    for (d, _), r in zip(rows, root, strict=True):
        groups[r].append((d is None, d))
    return [min(g, key=lambda x: (x[0], x[1] or 0))[1] for g in groups.values()]


def test_run_is_its_stages(spark, tmp_path):
    docs = frame(spark, [r for r in documents() if r[0] is not None]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path))
    step = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in cp.STAGES:
        step = stage(spark, step, str(tmp_path))
    assert got.columns == step.columns
    plain = lambda df: Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert plain(got) == plain(step) and got.count() > 100


def test_stages_one_after_another(spark):
    rows = documents()
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    columns = docs.columns

    one = cp.language_id(spark, docs, "").cache()
    kept = one.collect()
    assert one.columns == columns
    told = langid.predict(docs, langid.fit(docs)).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in told if r["lang_pred"] != "und")
    assert {r["doc_id"] for r in kept} >= set(range(120))

    two = cp.line_dedup(spark, one, "").cache()
    want = plain([(r["doc_id"], r["text"]) for r in kept])
    got = two.collect()
    assert two.columns == columns and Counter((r["doc_id"], r["text"]) for r in got) == Counter((k["doc_id"], want[k["doc_id"], k["text"]]) for k in kept if want[k["doc_id"], k["text"]] or not k["text"])
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["doc_id"] for r in got} == {d for (d, t), x in want.items() if x or not t}

    three = cp.simhash_near_dedup(spark, two, "").cache()
    assert three.columns == columns and Counter(r["doc_id"] for r in three.collect()) == Counter(one_of_each([(r["doc_id"], r["text"]) for r in got]))

    four = cp.mix_sources(spark, three, "").cache()
    assert four.columns == columns
    words, taken = defaultdict(int), defaultdict(int)
    for r in three.collect():
        words[r["source"]] += len(r["text"].split())
    for r in four.collect():
        taken[r["source"]] += len(r["text"].split())
    from .test_mixing import plain_targets

    longest = max(len(r["text"].split()) for r in three.collect())
    assert all(abs(taken[s] - w) <= longest for s, w in plain_targets(words).items())

    five = cp.pack(spark, four, "").collect()
    assert Counter(r["doc_id"] for r in five if r["piece"] == 0) == Counter(r["doc_id"] for r in four.collect())
    full = defaultdict(int)
    for r in five:
        full[r["sequence_id"]] += r["length"]
    assert max(full.values()) <= 1024 and np.mean(list(full.values())) > 500


def test_texts_of_no_learned_language_go(spark):
    rng = random.Random(4)
    clean = [r for r in documents() if r[0] is not None and r[0] < 120]
    words = [" ".join("".join(rng.choice("bcdfghjklmpqrtvwxyz") for _ in range(7)) for _ in range(40)) for _ in range(5)]
    words.append("все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом")
    rows = clean + [(1000 + i, t, None, "src0", len(t), 7, 3, "x", 1, 0.5) for i, t in enumerate(words)]
    kept = cp.language_id(spark, frame(spark, rows), "").collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in clean}


def test_empty(spark):
    docs = empty(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
