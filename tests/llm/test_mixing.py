from collections import Counter, defaultdict

import numpy as np

from vocalith.llm import mixing

from .tables import documents, empty, frame


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, target, stopped = share * sum(sizes.values()), {}, set()
    while True:
        rest = budget - sum(passes * sizes[s] for s in stopped)
        open_ = [s for s in names if s not in stopped]
        target = {s: passes * sizes[s] if s in stopped else rest * w[s] / sum(w[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > passes * sizes[s]}
        if not over:
            return target
        stopped |= over


def test_targets_and_taken(spark):
    rows = documents()
    docs = frame(spark, rows)
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").encode().split())
    want = plain_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-3
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert all(0 <= p <= 1 for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 1 for s in want)
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], r["start"], tuple(r["positions"]))
    again = mixing.mix(frame(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_positions_follow_the_schedule(spark):
    # one source falls from weight 3 to 1 in a straight line, so half of its words come at t with (3t - t^2) / 2 = 1/2
    rows = [(i, "a b c d", "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(2000)]
    got = mixing.mix(frame(spark, rows), share=1.0, passes=2, schedules=((3.0, 1.0),)).collect()
    p = np.sort([r["positions"][0] for r in got])
    t = (3 - np.sqrt(9 - 4)) / 2
    assert abs(p[1000] - t) < 1e-3 and p[0] < 1e-3 and p[-1] > 0.999


def test_apply_mix_takes_whole_documents(spark):
    rows = documents()
    docs = frame(spark, rows)
    out = mixing.apply_mix(docs).collect()
    assert {r["text"] for r in out} <= {r[1] for r in rows} and len(out) > 0
    assert out[0].asDict().keys() == docs.first().asDict().keys()


def test_rows_that_differ_in_other_columns_only_stay_apart(spark):
    """The same id and text from two sources, and with a null that moves from column to column."""
    text = "one two three four five six seven eight"
    rows = [(1, text, "x", None, "u"), (1, text, "y", "u", None), (1, text, "y", "v", None), (2, ". .", "x", None, None), (3, ". .", "y", None, None)]
    schema = "doc_id long, text string, source string, lang string, note string"
    got = Counter(tuple(r) for r in mixing.apply_mix(spark.createDataFrame(rows, schema)).collect())
    mixed = mixing.mix(spark.createDataFrame(rows, schema), keep=["lang", "note"]).collect()
    want = Counter()
    for r in mixed:
        text_of = text if r["doc_id"] == 1 else ". ."
        want[r["doc_id"], text_of, r["source"], r["lang"], r["note"]] += sum(2 * p["n"] >= r["size"] for p in r["parts"])
    assert got == Counter({k: n for k, n in want.items() if n}) and {k[2] for k in got} == {"x", "y"} and all(got[r] for r in rows[1:3])


def test_rows_of_one_id_and_size_come_in_the_same_order_again(spark):
    """However they lie: what the mix takes of each is the same for any order and number of partitions."""
    rows = [(1, "one two three four", "x", f"l{i}") for i in range(40)]
    schema = "doc_id long, text string, source string, lang string"
    got = [{r["lang"]: (r["start"], r["taken"]) for r in mixing.mix(spark.createDataFrame(x, schema).repartition(n), keep=["lang"]).collect()} for x, n in ((rows, 1), (rows[::-1], 3))]
    assert got[0] == got[1] and len(got[0]) == 40


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.apply_mix(empty(spark)).count() == 0
