"""Each registered query on the driver's small tables: its columns, its SQL where there is some, plain versions else."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from tests.oracle import differences
from vocalith.llm import packing, queries

from .test_simhash import plain_components, plain_fingerprint

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language_id": "doc_id held_out lang_pred score",
    "op3_sharding": "doc_id size text_crc32 law shard slot grown_shard range",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_secret_scan": "doc_id finding start length key sha256 probability is_secret",
    "op7_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op8_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature width height",
    "op9_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op10_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op11_quality": "doc_id held_out score predicted",
}


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def run(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns == COLUMNS[name].split()
    return df.collect()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert differences(spark, name, queries.QUERIES[name], queries.ORACLE_SQL[name], SF) == ""


def test_op1(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op1_language_id")}
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    assert all(got[d]["held_out"] == held(d) for d, _, _ in docs) and len(got) == len(docs)
    told = [got[d]["lang_pred"] == g for d, t, g in docs if held(d) and g and t and any(c.isalpha() for c in t)]
    assert np.mean(told) > 0.98


def test_op3(spark, docs):
    got = run(spark, "op3_sharding")
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, of = defaultdict(list), defaultdict(set)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        of[r["text_crc32"]].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(40))
    share = sum(r["size"] for r in got) / 40
    size = {r["text_crc32"]: 0 for r in got}
    for r in got:
        size[r["text_crc32"]] += r["size"]
    assert all(len(of[c]) == 1 for c in of if size[c] <= share)


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op4_simhash")}
    ids = [d for d, _, _ in docs]
    fps = [plain_fingerprint(t or "", 4, 42) for _, t, _ in docs]
    assert all(got[d]["fingerprint"] == f"{f:016x}" for d, f in zip(ids, fps, strict=True))
    assert [got[d]["component_id"] for d in ids] == plain_components([fps], ids).tolist()


def test_op5(spark, docs):
    """Every finding is a candidate of its text, and every candidate a finding."""
    from vocalith.llm import secrets

    got = Counter((r["doc_id"], r["start"], r["length"], r["key"], r["sha256"]) for r in run(spark, "op5_secret_scan"))
    assert got == Counter((d, a, b - a, k, hashlib.sha256(t[a:b].encode()).hexdigest()) for d, t, _ in docs if t for a, b, k in secrets.candidates(t))


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op7_lm_scoring")}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 7 == 2) and got[d]["n_tokens"] == len((t or "").encode().lower().split()) + 1 for d, t, _ in docs)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op8_media")}
    for d, t, _ in docs:
        data = (t or "").encode()
        full = data + b"\xff" * ((-len(data)) % 576 or (0 if data else 576))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert r["width"] * r["height"] == len(full)


def test_op9(spark, docs):
    """Ids by the tokenizer itself, offsets without gaps, and hardly more sequences than plain best fit needs."""
    from tokenizers import Tokenizer

    tokenizer, want = Tokenizer.from_file(queries.tokenizer_path()), Counter()
    for d, t, _ in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) % 1024 or 1024
        for k, a in enumerate([0, *range(first, len(ids), 1024)]):
            b = first if k == 0 else a + 1024
            want[d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    got = run(spark, "op9_packing")
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    full = defaultdict(list)
    for r in got:
        full[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in full.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    gaps: list[int] = []
    for length in sorted((r["length"] for r in got), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= length]
        if fits:
            gaps[min(fits, key=lambda i: gaps[i])] -= length
        else:
            gaps.append(packing.CAPACITY - length)
    assert len(full) <= 1.01 * len(gaps) + 1


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op10_fingerprints")}
    down = sorted(docs, key=lambda r: -r[0])
    for (d, t, _), (_, n, _) in zip(down, down[1:] + down[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 3
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()


def test_op11(spark, docs):
    got = {r["doc_id"]: r for r in run(spark, "op11_quality")}
    assert set(got) == {d for d, _, _ in docs}
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, _, _ in docs)


def test_every_query_is_here():
    assert set(COLUMNS) | set(queries.ORACLE_SQL) == set(queries.QUERIES)


def test_op3_shards_are_near_equal(spark):
    """Bytes of each shard against an equal share, on a table in which no document is larger than a tenth of one."""
    rows = queries.op3_sharding(spark, "/root/testdata/sf0.01").groupBy("shard").agg({"size": "sum", "slot": "max", "doc_id": "count"}).collect()
    mean = sum(r["sum(size)"] for r in rows) / 40
    assert len(rows) == 40 and all(0.93 * mean < r["sum(size)"] < 1.07 * mean and r["max(slot)"] == r["count(doc_id)"] - 1 for r in rows)
