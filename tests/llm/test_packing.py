import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vocalith.llm import packing

from .tables import documents, empty, frame

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_encoder_agrees_with_the_tokenizer(tokenizer):
    texts = ["a  b \n c", " x", "x ", "  ", "", "\n\n a", "<|endoftext|> q", "a b", "it's 12 o'clock, isn't\tit?", "né à l'été 😀 x", "a b  c", "word.\nNext line word", "a \x1c b \x85c", "  x"]
    texts += [r[1] or "" for r in documents()[:60]]
    encode = packing.Encoder(PATH)
    for _ in range(2):  # the second time from memory
        want = [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert encode(texts) == want


def test_encoder_agrees_on_every_character(tokenizer):
    encode = packing.Encoder(PATH)
    assert encode.fast is not None
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{c}a {c} 1{c}1{c}{c}\n{c}'s {c}\t" for c in chars[a : a + 512]) for a in range(0, len(chars), 512)]
    assert all(encode([t])[0] == np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts)


def test_encoder_of_long_runs(tokenizer):
    encode = packing.Encoder(PATH)
    texts = [c * 300_000 for c in ("a", " ", "\n", "é", "!", "漢", "1")] + [" \n" * 100_000 + "x", "ab" * 150_000]
    assert encode(texts) == [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_other_tokenizers_are_left_to_their_library(tmp_path, tokenizer):
    """One whose merges are not in the order of ids, and one that adds a blank in front."""
    import json

    for change in ("order", "prefix"):
        told = json.loads(tokenizer.to_str())
        if change == "order":
            told["model"]["merges"][5:7] = told["model"]["merges"][6:4:-1]
        else:
            told["pre_tokenizer"]["add_prefix_space"] = True
        path = tmp_path / f"{change}.json"
        path.write_text(json.dumps(told))
        encode = packing.Encoder(str(path))
        assert encode.fast is None
        other, texts = Tokenizer.from_file(str(path)), ["the other one", "in the end"]
        assert encode(texts) == [np.array(other.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_each_piece_once(seed):
    rng = random.Random(seed)
    lengths = [min(1024, max(1, int(rng.choice([rng.random() * 1024, rng.expovariate(1 / 150), 1024, 342, 341])))) for _ in range(rng.choice([0, 1, 7, 200, 900]))]
    counts = defaultdict(int)
    for n in lengths:
        counts[n] += 1
    runs, sequences = packing.plan(dict(counts))
    bins, ranks = defaultdict(list), defaultdict(list)
    for a, rank, n, first, offset in runs:
        ranks[a] += range(rank, rank + n)
        for i in range(n):
            bins[first + i].append((offset, a))
    assert {a: sorted(v) for a, v in ranks.items()} == {a: list(range(n)) for a, n in counts.items()}
    for b in bins.values():
        at = 0
        for offset, a in sorted(b):
            assert offset == at
            at += a
        assert at <= 1024
    assert len(bins) == sequences >= -(-sum(lengths) // 1024)
    large = sum(n for a, n in counts.items() if 3 * a > 1024)
    assert sequences <= max(large, -(-sum(lengths) // 1024) * 1.25 + 1)


def test_pieces_and_places(spark, tokenizer):
    rows = documents()
    got = packing.pack(packing.pieces(frame(spark, rows), PATH)).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = {r[0]: r[1] for r in rows}
    for d, pieces in by.items():
        ids = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        copies = sum(r[0] == d for r in rows)
        assert sum(p["length"] for p in pieces) == copies * len(ids)
        for p in pieces:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"] and (p["length"] == 1024 or p["piece"] == 0)
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:i]) for i in range(len(b))] and sum(n for _, n in b) <= 1024
    assert set(by) == set(texts)


def test_empty(spark):
    assert packing.pack(packing.pieces(empty(spark), PATH)).count() == 0
