import random

import numpy as np
import xxhash

from vocalith.llm import simhash
from vocalith.llm.components import components

SCHEMA = "doc_id long, text string, fp string"  # an extra column whose name clashes with the operator's own


def plain_fingerprint(text, words=4, seed=42):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    h = [xxhash.xxh64_intdigest(x, seed) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, ids, bits=4):
    views = np.array(fps, dtype=np.uint64).reshape(-1, len(ids))
    near = (np.bitwise_count(views[:, :, None] ^ views[:, None, :]) <= bits).any(0)
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return label
        label = new


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 5, 40, 700):
        t = " ".join(rng.choice(["Aé", "b", "THE", "x y", "zz"]) for _ in range(n))
        assert simhash.fingerprint(t) == plain_fingerprint(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\t") == 0


def _flip(rng, x, k):
    for b in rng.sample(range(64), k):
        x ^= 1 << b
    return x


def _clusters(seed, centres, size, spread=3):
    rng = random.Random(seed)
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        out |= {_flip(rng, c, rng.randint(0, spread)) for _ in range(size)}
    return sorted(out)


def test_links_find_all_components_small_and_large_cells(spark):
    # block 8: most cells of a cluster are searched in pairs of blocks
    for block, fps in ((4096, _clusters(2, 30, 6)), (8, _clusters(3, 3, 60)), (4096, _clusters(4, 2, 90, 8))):
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block)
        got = {r["u"]: r["root"] for r in components(links).collect()}
        want = plain_components(fps, signed)
        assert [got.get(x, x) for x in signed] == want.tolist()


def test_several_seeds_link_where_any_does(spark):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghij") + rng.choice("klmnop") for _ in range(90)] for _ in range(12)]
    texts = [" ".join(x if rng.random() > p else "zz" for x in b) for b in base for p in (0, 0, 0.01, 0.02, 0.04)]
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=5, seeds=(42, 43, 44)).collect()}
    want = plain_components([[plain_fingerprint(t, 5, s) for t in texts] for s in (42, 43, 44)], list(range(len(texts))))
    assert [got[i] for i in range(len(texts))] == want.tolist()


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(5, "a b c d e", "x"), (3, "A  B c\nd E", "x"), (9, None, None), (7, "", "x"), (8, " ", None), (None, "q", "x"), (11, long, "x"), (5, "a b c d e", "x")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert len(got) == len(rows)
    assert by[5] == by[3] == {3} and by[7] == by[8] == by[9] == {7} and by[None] == {None} and by[11] == {11}
    kept = simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == [(False, 3), (False, 7), (False, 11), (True, 0)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_finds_every_pair_from_a_similarity_of_80_percent(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(base))
        for edits in (2, 3, 4, 9):  # one edit changes five shingles: 0.90, 0.86, 0.82 and 0.63
            copy = list(base)
            for k in range(edits):
                copy[10 + 20 * k] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(copy))
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root = [root[b] if r == root[a] else r for r in root]
    want = {root.index(r) for r in root}
    assert len(want) == 60
    kept = simhash.one_of_each(spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)).collect()
    assert {r["doc_id"] for r in kept} == want


def test_similar_groups_do_not_rest_on_the_least_node(spark):
    """A chain: its ends are too far apart, and a cell's least node may be an end."""
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join([f"y{i}" if i < 9 * k else w for i, w in enumerate(words)]) for k in range(8)]
    got = simhash.similar_groups(spark.createDataFrame([(i, t, "x") for i, t in enumerate(chain)], SCHEMA), block=3).collect()
    assert len(got) == 8 and len({r["root"] for r in got}) == 1


def test_one_of_each_does_not_mix_rows(spark):
    """Rows of one id and text but of different columns: always the same whole row stays."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, f"s{i}", i) for i in range(8)] + [(2, text, "s0", 9)]
    schema = "doc_id long, text string, source string, n int"
    kept = {tuple(simhash.one_of_each(spark.createDataFrame(x, schema).repartition(p)).first()) for x, p in ((rows, 3), (rows[::-1], 5))}
    assert len(kept) == 1 and kept <= set(rows)


def test_cells_of_many_nodes_are_dealt_in_blocks(spark):
    """The same links whether a cell is searched whole or in pairs of blocks."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        own = np.unique(np.concatenate([np.arange(50) + 1000 * (i % 6), rng.integers(10**6, 10**7, size=int(rng.integers(1, 20)))])).astype(np.uint64)
        rows.append((7 if i < 50 else 8, i, len(own), i, bytearray(own.tobytes())))
    cells = spark.createDataFrame(rows, "key long, node long, size long, root long, data binary").repartition(4)
    sets = {r[1]: set(np.frombuffer(bytes(r[4]), dtype=np.uint64).tolist()) for r in rows}

    def groups(block):
        found = simhash._searched(cells, simhash._joins, "test", 80, block).collect()
        nodes, least = simhash.roots(np.array([r["u"] for r in found]), np.array([r["v"] for r in found]))
        return dict(zip(nodes.tolist(), least.tolist(), strict=True))

    whole = groups(4096)
    assert whole == groups(8) and len(whole) > 5
    for a in range(50):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                assert whole[a] == whole[b]
