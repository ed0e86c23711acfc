import zlib
from bisect import bisect_right
from collections import Counter, defaultdict

import pytest

from vocalith.llm import sharding

from .tables import documents, empty, frame


def check(rows, got, shards, slack):
    assert len(got) == len(rows)
    size = Counter()
    slots = defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total = sum(size.values())
    assert max(size.values()) <= total / shards + slack
    return size


def test_sizes_slots_and_checksums(spark):
    rows = documents()
    got = sharding.shard(frame(spark, rows), shards=4).collect()
    biggest = max(len((r[1] or "").encode()) for r in rows) + 16
    check(rows, got, 4, biggest)
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_even_sizes_and_small_groups_stay_whole(spark):
    rows = [(i, f"text number {i // 3}", "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(6000)]
    got = sharding.shard(frame(spark, rows), shards=8).collect()
    size = check(rows, got, 8, 0.08 * sum(r["size"] for r in got) / 8)
    assert min(size.values()) > 0.9 * sum(size.values()) / 8
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"]].add(r["shard"])
    assert all(len(v) == 1 for v in of.values())


def test_hot_group_is_spread(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i}", "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(6000)]
    got = sharding.shard(frame(spark, rows), shards=8).collect()
    check(rows, got, 8, 0.1 * sum(r["size"] for r in got) / 8)
    again = sharding.shard(frame(spark, rows[::-1]).repartition(3), shards=8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_rows_equal_in_id_and_text_are_spread_and_large_groups_stay_whole(spark):
    rows = [(5, "the same text", "en", "s", 1, 7, 3, "x", 1, 0.5)] * 2000 + [(i, f"text {i}", "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(4000)]
    got = sharding.shard(frame(spark, rows), shards=8)
    ranges = Counter(r["range"] for r in got.where("doc_id = 5").collect())
    assert max(ranges.values()) < 200
    check(rows, got.collect(), 8, 0.1 * sum(r["size"] for r in got.collect()) / 8)
    rows = [(i, f"large group {i // 300}" if i < 2400 else f"text {i}", "en", "s", 1, 7, 3, "x", 1, 0.5) for i in range(6000)]
    got = sharding.shard(frame(spark, rows), shards=8).collect()
    check(rows, got, 8, 0.05 * sum(r["size"] for r in got) / 8)
    of = defaultdict(set)
    for r in got:
        of[r["text_crc32"]].add(r["shard"])
    assert all(len(v) == 1 for v in of.values())


def test_placement_against_a_plain_version(spark):
    """Ranges by bisection and shards by the plan, row by row in plain Python, from the operator's own splitters."""
    rows = list(dict.fromkeys(documents()))
    made = {}
    plain = sharding._assign
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sharding, "_assign", lambda counted, shards, splitters: made.update(home=plain(counted, shards, splitters), splitters=splitters) or made["home"])
        got = sharding.shard(frame(spark, rows), shards=4)
    keyed = frame(spark, rows).select("doc_id", sharding.text_of("text").alias("t"), sharding._key("text", "doc_id").alias("k")).collect()
    want, ranks = [], Counter()
    for r in sorted(keyed, key=lambda r: r["k"]):
        k = bisect_right(made["splitters"], r["k"])
        s, base = made["home"][k]
        want.append((r["doc_id"], zlib.crc32(r["t"].encode()), s, base + ranks[k]))
        ranks[k] += 1
    assert Counter(want) == Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in got.collect())


def test_empty(spark):
    assert sharding.shard(empty(spark)).count() == 0
