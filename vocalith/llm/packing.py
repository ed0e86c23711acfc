"""Best-fit packing of tokenized documents into fixed-length sequences, by large-item matching.

Documents longer than the capacity are cut into full pieces (the first may be shorter). Pieces above one third
of the capacity can share a sequence with at most one other such piece, so they are matched greedily, each of
the longest with the longest that still fits; smaller pieces then go, longest first, to the sequence with the
smallest gap that holds them, or open a new one.

Packing needs the lengths only, and there are at most ``capacity`` different ones: the plan is made on the
driver from the histogram of lengths, over groups of like sequences rather than single ones, so its size does
not depend on the number of documents and the packing is that of one global greedy run. Pieces find their
place in the plan by their rank among the pieces of equal length; ranks come from running counts over ranges,
so neither a length that a third of all pieces have nor an id that a third of them share stays on one task.

Cases: a null text counts as empty and has the end token alone; an empty table packs into nothing; equal rows
get separate places; very long texts are tokenized whole.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, prefix

CAPACITY = 1024
END = 2


class Encoder:
    """Ids of a tokenizer as little-endian 32-bit integers.

    Byte-level BPE whose merges are in the order of their ids, which most are, is also what tiktoken computes, in half the time, so
    texts are encoded by it, from the tokenizer's own vocabulary. Other tokenizers, and texts that hold a special
    token or that it refuses, are left to the tokenizers library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = _as_tiktoken(json.loads(self.tokenizer.to_str()), set(self.special))

    def _ids(self, text: str) -> bytes:
        if self.fast and not any(s in text for s in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except BaseException as e:  # its regular expressions give up on some texts, by a panic that is no Exception
                if type(e).__name__ != "PanicException" and not isinstance(e, ValueError):
                    raise
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [self._ids(t) for t in texts]


#: Fixed value: the pattern by which byte-level BPE breaks texts before merging.
_BREAKS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for: printable ones themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def _as_tiktoken(told: dict, special: set[str]):
    """The same encoding for tiktoken, or None where it would not be the same."""
    model, breaks = told["model"], told.get("pre_tokenizer") or {}
    plain = breaks.get("type") == "ByteLevel" and breaks.get("use_regex", True) and not breaks.get("add_prefix_space")
    odd = told.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
    if model.get("type") != "BPE" or not plain or odd:
        return None
    vocab, of = model["vocab"], _byte_of()
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    singles = [vocab.get(c) for c in of]
    tokens = {t: i for t, i in vocab.items() if t not in special}
    in_order = None not in merged and all(a < b for a, b in pairwise(merged)) and len(tokens) == len(merged) + 256
    if not in_order or None in singles or (merged and max(singles) > merged[0]):
        return None
    import tiktoken

    return tiktoken.Encoding("packing", pat_str=_BREAKS, mergeable_ranks={bytes(map(of.__getitem__, t)): i for t, i in tokens.items()}, special_tokens={})


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Tokenize: one row (doc, piece, start, length, ids_crc32) for each piece of each document."""
    bounded_batches(docs.sparkSession)

    def cut(batches):
        encode = encoder(path)
        last = np.array([end], dtype="<u4").tobytes()
        for x in batches:
            out: list[tuple] = []
            for d, ids in zip(x["d"], encode([t or "" for t in x["t"]]), strict=True):
                ids += last
                n = len(ids) // 4
                first = n % capacity or capacity
                view = memoryview(ids)
                for k, a in enumerate([0, *range(first, n, capacity)]):
                    b = first if k == 0 else a + capacity
                    out.append((d, k, a, b - a, zlib.crc32(view[4 * a : 4 * b])))
            yield pd.DataFrame(out, columns=["d", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc].dataType.simpleString()
    # ids as text: pandas has no long with nulls
    got = docs.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).mapInPandas(cut, "d string, piece int, start long, length long, ids_crc32 long")
    return got.select(F.col("d").cast(kind).alias(doc), "piece", "start", "length", "ids_crc32")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Histogram of lengths -> runs (length, first rank, sequences, first sequence, offset), and all sequences.

    The pieces of that length with ranks first..first + sequences - 1 go to consecutive sequences, one each, at
    that offset.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    groups: list[tuple[int, list[int]]] = []  # (how many sequences, the lengths in each)
    large = sorted((k for k in left if 3 * k > capacity), reverse=True)
    for a in large:
        while left.get(a, 0):
            fits = [b for b in large if a + b <= capacity and left.get(b, 0) > (b == a)]
            if not fits:
                groups.append((left.pop(a), [a]))
                break
            b = fits[0]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            groups.append((n, [a, b]))
            for k in (a, b):
                left[k] -= n
    gaps: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for n, g in groups:
        gaps[capacity - sum(g)].append((n, g))
    open_gaps = sorted(gaps)
    for a in sorted((k for k in left if left[k] and 3 * k <= capacity), reverse=True):
        n = left[a]
        while n:
            at = bisect_left(open_gaps, a)
            if at == len(open_gaps):
                fit = capacity // a
                whole, rest = divmod(n, fit)
                for m, k in ((whole, fit), (1, rest)):
                    if m and k:
                        gap = capacity - a * k
                        if not gaps[gap]:
                            insort(open_gaps, gap)
                        gaps[gap].append((m, [a] * k))
                break
            gap = open_gaps[at]
            m, g = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(at)
            fit = min(gap // a, n) if m > n else min(gap // a, max(1, n // m))
            use = min(m, n // fit)
            if use < m:
                if not gaps[gap]:
                    insort(open_gaps, gap)
                gaps[gap].append((m - use, g))
            n -= use * fit
            rest = gap - a * fit
            if not gaps[rest]:
                insort(open_gaps, rest)
            gaps[rest].append((use, g + [a] * fit))
    runs, rank, sequence = [], defaultdict(int), 0
    for _, made in sorted(gaps.items()):
        for n, g in made:
            offset = 0
            for a in g:
                runs.append((a, rank[a], n, sequence, offset))
                rank[a] += n
                offset += a
            sequence += n
    return sorted(runs), sequence


def pack(rows: DataFrame, capacity: int = CAPACITY, doc: str = "doc_id") -> DataFrame:
    """Pieces (doc, piece, length, ...) -> with ``sequence_id`` and ``offset``."""
    rows = materialise(rows, "pack-pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    shared = rows.sparkSession.sparkContext.broadcast(np.array(runs, dtype=np.int64).reshape(-1, 5))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r = shared.value
        key = (r[:, 0] << 44) | r[:, 1]
        at = np.searchsorted(key, (length.to_numpy() << 44) | rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": r[at, 3] + rank.to_numpy() - r[at, 1], "offset": r[at, 4]})

    ranked = prefix(rows, ["length"], [F.col(doc), F.col("piece")], F.lit(1).cast("long"), "_rank")
    got = ranked.withColumn("_place", place("length", "_rank"))
    return got.select(*rows.columns, "_place.sequence_id", "_place.offset")
