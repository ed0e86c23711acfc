"""SimHash near-duplicates through a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits; its embedding is the vector of bit counts of the
segments (each 0, 1 or 2). The Manhattan distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so fingerprints within ``bits`` of each other lie within ``bits`` in the embedding.

Range join on a grid: the 32 dimensions form eight blocks of four; if the Manhattan distance is at most four,
at least four whole blocks agree, so both vectors share a cell of at least one of the 70 grids made of four
blocks. A cell's members are compared by the Manhattan bound, then exactly. In cells of one nothing is
compared; in small cells all members are; in larger ones a search over the not yet reached members finds a
spanning forest of the links, as all pairs of a group of copies are never needed for its components. Cells of
more than ``block`` distinct fingerprints are cut into blocks and each pair of blocks is searched apart, so no
task holds a whole hot cell and none is dropped.

Cases: a null text, an empty one and one without words have fingerprint zero and link like any other; equal
texts and repeated rows share a fingerprint and so a component; a component's id is its smallest doc_id (null
only where no member has one); extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import batch_rows, bounded_batches, materialise, row_hash
from .components import components, roots

SEED = 42
_PIECE = 1 << 18
#: Documents of the pipeline are near copies from this similarity of their shingles on, in per cent.
ALIKE = 80
BANDS, ROWS = 20, 6
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _votes(hashes: list[int]) -> np.ndarray:
    h = np.array(hashes, dtype=np.uint64)
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: str | None, words: int = 4, seed: int = SEED) -> int:
    """Bit b is set if it is in over half of the shingles' XXH64 (unsigned)."""
    return fingerprints(text, words, (seed,))[0]


def _cuts(w: list[bytes], words: int) -> tuple[bytes, np.ndarray, np.ndarray, int]:
    """The words joined, the starts and ends of their shingles in that, and how many there are."""
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return joined, starts, ends[min(words, len(w)) - 1 :], max(1, len(w) - words + 1)


def fingerprints(text: str | None, words: int, seeds: tuple[int, ...]) -> list[int]:
    """One fingerprint for each seed of the hash."""
    w = (text or "").encode().lower().split()
    if not w:
        return [0] * len(seeds)
    joined, starts, last, n = _cuts(w, words)
    h64, votes = xxhash.xxh64_intdigest, np.zeros((len(seeds), 64), dtype=np.int64)
    for at in range(0, n, _PIECE):
        to = min(n, at + _PIECE)
        shingles = [joined[a:b] for a, b in zip(starts[at:to].tolist(), last[at:to].tolist(), strict=True)]
        for k, seed in enumerate(seeds):
            votes[k] += _votes([h64(x, seed) for x in shingles])
    return [int(np.packbits(v * 2 > n, bitorder="little").view(np.uint64)[0]) for v in votes]


def fingerprint_udf(words: int = 4, seeds: tuple[int, ...] = (SEED,)):
    """The fingerprints of a text as an array of (signed) longs."""

    @F.pandas_udf(ArrayType(LongType()))
    def prints(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: np.array(fingerprints(t, words, seeds), dtype=np.uint64).view(np.int64))

    return prints


#: One bit in each segment of two.
_LOW = 0x5555555555555555
_BLOCKS = [0xFF << (8 * i) for i in range(8)]
_GRIDS = [sum(x) for x in combinations(_BLOCKS, 4)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _unary():
    """The embedding in one long: a segment's count 0, 1, 2 as bits 00, 01, 11; xor counts the Manhattan distance."""
    fp, low = F.col("fp"), F.lit(_signed(_LOW))
    over = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(over).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(over).bitwiseAND(low), 1))


def _near(a: np.ndarray, b: np.ndarray, ea: np.ndarray, eb: np.ndarray, bits: int) -> np.ndarray:
    """The Manhattan bound first, then the exact distance of what is left."""
    out = np.bitwise_count(ea ^ eb) <= bits
    at = np.flatnonzero(out)
    out[at] = np.bitwise_count((a[at] if np.ndim(a) else a) ^ b[at]) <= bits
    return out


def _forest(fp: np.ndarray, emb: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join all linked members: each member met is compared with those not reached yet."""
    out, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(fp[x], fp[left], emb[x], emb[left], bits)
            if hit.any():
                got = left[hit]
                out.append((np.full(len(got), fp[x]), fp[got]))
                queue.extend(got.tolist())
                left = left[~hit]
    return out


def _embed(fp: np.ndarray) -> np.ndarray:
    """The embedding as in ``_unary``."""
    low = np.uint64(_LOW)
    over = fp >> np.uint64(1)
    return ((fp | over) & low) | ((fp & over & low) << np.uint64(1))


def _links(key: np.ndarray, fp: np.ndarray, bits: int, few: int = 48) -> tuple[np.ndarray, np.ndarray]:
    """Over rows sorted by key: links inside the runs of equal keys, thinned to a spanning forest."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    alone = new & np.concatenate([new[1:], [True]])
    key, fp = key[~alone], fp[~alone]
    if not len(key):
        return fp.view(np.int64), fp.view(np.int64)
    emb = _embed(fp)
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(key)]]))
    run = np.repeat(np.arange(len(starts)), sizes)
    small = (sizes <= few)[run]
    a, b = [fp[:0]], [fp[:0]]
    for lag in range(1, sizes[sizes <= few].max(initial=0)):
        at = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:])
        at = at[_near(fp[at], fp[at + lag], emb[at], emb[at + lag], bits)]
        a.append(fp[at])
        b.append(fp[at + lag])
    for s, n in zip(starts[sizes > few], sizes[sizes > few], strict=True):
        for x, y in _forest(fp[s : s + n], emb[s : s + n], bits):
            a.append(x)
            b.append(y)
    u, v = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
    if not len(u):
        return u, v
    nodes, root = roots(u, v)
    return nodes[nodes != root], root[nodes != root]


def _search(bits: int, most: int | None):
    """Batches sorted by key -> links (u, v, over false). The last run waits for the next batch; one of more than
    ``most`` rows is dropped as it comes and its key given back (over true), to be searched in blocks."""

    def run(batches):
        key, fp, over = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        out = lambda u, v, flag: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), flag))], names=["u", "v", "over"])
        for x in batches:
            k, f = x.column("key").to_numpy(), x.column("fp").to_numpy().view(np.uint64)
            if over is not None:
                k, f = k[(n := np.searchsorted(k, over, side="right")) :], f[n:]
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if not len(key):
                continue
            cut = int(np.searchsorted(key, key[-1]))
            u, v = _links(key[:cut], fp[:cut], bits)
            yield out(u, v, False)
            key, fp = key[cut:], fp[cut:]
            if most is not None and len(key) > most:
                over = key[-1]
                yield out(key[-1:], key[-1:], True)
                key, fp = key[:0], fp[:0]
        yield out(*_links(key, fp, bits), False)

    return run


def fingerprint_links(fps: DataFrame, bits: int = 4, block: int = 4096) -> DataFrame:
    """Distinct fingerprints ``fp`` -> links (u, v) that connect all that are within ``bits`` (at most 4).

    One shuffle deals (cell, fingerprint) rows by cell; a task streams over them in order, so its memory is a batch
    and ``block`` rows. The cells with more come back by key alone and are dealt again in pairs of blocks.
    """
    if not 0 <= bits <= 4:
        raise ValueError("eight blocks of the embedding serve distances up to 4")
    spark = fps.sparkSession
    keys = [F.xxhash64(F.lit(i), F.col("emb").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(_GRIDS)]
    cells = fps.select("fp", _unary().alias("emb")).select(F.explode(F.array(*keys)).alias("key"), "fp")
    schema = "u long, v long, over boolean"
    with batch_rows(spark, 1 << 16):
        got = materialise(cells.repartition("key").sortWithinPartitions("key").mapInArrow(_search(bits, block), schema), "simhash-links")
        links = got.where("not over").select("u", "v")
        large = got.where("over").select(F.col("u").alias("key")).distinct()
        counts = materialise(cells.join(large, "key").groupBy("key").agg(F.count("*").alias("n")), "simhash-large") if not large.isEmpty() else None
        if counts is None:
            return links
        parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
        own = F.pmod(F.xxhash64("fp"), parts).cast("int")
        dealt = cells.join(counts, "key").select("key", "fp", own.alias("b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("o"))
        pair = dealt.select(F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o")).alias("key"), "fp")
        more = materialise(pair.repartition("key").sortWithinPartitions("key").mapInArrow(_search(bits, None), schema), "simhash-blocks")
    return links.union(more.select("u", "v"))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4, block: int = 4096, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """One row per row of ``docs``: its id, fingerprint (long ``fp``, of the first seed), text hash ``text_hash``,
    component ``root`` (its least node) and component_id.

    With several seeds, documents link if any of their fingerprints do: the chance that a near copy falls beyond
    ``bits`` shrinks with each. A node is then the whole list of fingerprints, and each seed's links join the least
    nodes of their fingerprints, to which the other nodes of the same fingerprint are tied.
    """
    bounded_batches(docs.sparkSession)
    marked = docs.select(F.col(doc).alias(doc), row_hash(docs, 5).alias("_r"), F.xxhash64(text).alias("text_hash"), fingerprint_udf(words, seeds)(F.coalesce(F.col(text), F.lit(""))).alias("fps"))
    node = F.col("fps")[0] if len(seeds) == 1 else F.xxhash64("fps")
    marked = materialise(marked.withColumn("node", node), "simhash-fp")
    nodes = materialise(marked.groupBy("node").agg(F.min(doc).alias("rep"), F.first("fps").alias("fps")), "simhash-distinct")
    links = None
    for k in range(len(seeds)):
        if len(seeds) == 1:
            found = fingerprint_links(nodes.select(F.col("node").alias("fp")), bits, block)
        else:
            view = nodes.select("node", F.col("fps")[k].alias("fp"))
            least = materialise(view.groupBy("fp").agg(F.min("node").alias("m")), "simhash-view")
            found = fingerprint_links(least.select("fp"), bits, block)
            found = found.join(least.select(F.col("fp").alias("u"), F.col("m").alias("mu")), "u").join(least.select(F.col("fp").alias("v"), F.col("m").alias("mv")), "v").select("mu", "mv")
            found = found.union(view.join(least, "fp").where("node <> m").select("node", "m")).toDF("u", "v")
        links = found if links is None else links.union(found)
    stars = components(links)
    named = nodes.join(stars.withColumnRenamed("u", "node"), "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    named = materialise(named, "simhash-named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = materialise(named.join(least, "root").select("node", "root", "component_id"), "simhash-components")
    return marked.join(ids, "node").select(doc, "text_hash", F.col("fps")[0].alias("fp"), "root", "component_id")


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """XXH64 of the different shingles of a text, in order; one of fewer words has one shingle, without words none."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    joined, starts, last, n = _cuts(w, words)
    parts, h64 = [], xxhash.xxh64_intdigest
    for at in range(0, n, _PIECE):
        to = min(n, at + _PIECE)
        parts.append(np.unique(np.array([h64(joined[a:b]) for a, b in zip(starts[at:to].tolist(), last[at:to].tolist(), strict=True)], dtype=np.uint64)))
    return np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def alike(a: np.ndarray, b: np.ndarray, percent: int = ALIKE) -> bool:
    """Whether two sets of shingles have a Jaccard similarity of ``percent`` or more; two empty ones are equal."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def minima(x: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minima of the shingles, each under another mixing of their hashes."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(x), 1024):
        h = x[at : at + 1024, None] * _FACTORS
        h ^= h >> np.uint64(29)
        h *= _FACTORS[::-1]
        np.minimum(least, h.min(0), out=least)
    return least


def bands(least: np.ndarray) -> np.ndarray:
    """One key for each of BANDS groups of ROWS minima; sets of similarity s share a key with chance s^ROWS."""
    return np.array([xxhash.xxh64_intdigest(least[i : i + ROWS].tobytes(), i) for i in range(0, BANDS * ROWS, ROWS)], dtype=np.uint64)


def _band_udf(words: int):
    """Of a text: hash of its words, number of different shingles, band keys and the minima in 16 bits each."""

    @F.pandas_udf("node long, size long, keys array<long>, sketch binary")
    def told(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            x = shingles(t, words)
            node = xxhash.xxh64_intdigest(b" ".join((t or "").encode().lower().split()))
            least = minima(x)
            rows.append((_signed(node), len(x), bands(least).view(np.int64) if len(x) else np.zeros(0, np.int64), (least >> np.uint64(48)).astype("<u2").tobytes()))
        return pd.DataFrame(rows, columns=["node", "size", "keys", "sketch"])

    return told


#: Sketches tell a similarity with a deviation of 0.037; pairs this far below the bound are not looked at.
_DOUBT = 0.1


class _Cell:
    """Nodes of a cell: ``size`` and ``sketch`` (nodes x minima)."""

    def __init__(self, size, sketch, percent: int):
        self.size, self.sketch, self.percent = size, sketch, percent

    def alike(self, i, others: np.ndarray) -> np.ndarray:
        """Equal minima of node i and others, -1 where that or the sizes rule out the similarity."""
        n = np.count_nonzero(self.sketch[others] == self.sketch[i], axis=1)
        a, b = np.minimum(self.size[others], self.size[i]), np.maximum(self.size[others], self.size[i])
        return np.where((n >= (self.percent / 100 - _DOUBT) * self.sketch.shape[1]) & (100 * a >= self.percent * b), n, -1)

    def forest(self) -> list[tuple[int, int, int]]:
        """A spanning forest of the greatest likeness (Prim): (i, j, equal minima)."""
        out, left = [], np.arange(1, len(self.size))
        best, by = self.alike(0, left), np.zeros(len(left), dtype=np.int64)
        while len(left):
            k = int(best.argmax())
            if best[k] >= 0:
                out.append((int(by[k]), int(left[k]), int(best[k])))
            tree = int(left[k])
            keep = np.arange(len(left)) != k
            left, best, by = left[keep], best[keep], by[keep]
            n = self.alike(tree, left)
            by[n > best] = tree
            best = np.maximum(best, n)
        return out


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return starts, np.diff(np.concatenate([starts, [len(key)]])).astype(np.int64)


def _forests(x: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Rows (key, node, size, data: sketch) sorted by key -> pairs (u, v, equal) of the runs of equal keys."""
    node, size = x["node"].to_numpy(), x["size"].to_numpy()
    sketch = np.frombuffer(b"".join(x["data"]), dtype="<u2").reshape(len(x), -1) if len(x) else np.zeros((0, 1), "<u2")
    starts, sizes = _runs(x["key"].to_numpy())
    two = starts[sizes == 2]  # most cells have two nodes: those at once
    equal = _Cell(size, sketch, percent).alike(two, two + 1)
    out = [(two[equal >= 0], two[equal >= 0] + 1, equal[equal >= 0])]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
        got = np.array(_Cell(size[s : s + n], sketch[s : s + n], percent).forest(), dtype=np.int64).reshape(-1, 3)
        out.append((got[:, 0] + s, got[:, 1] + s, got[:, 2]))
    i, j, equal = (np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True))
    u, v = np.minimum(node[i], node[j]), np.maximum(node[i], node[j])
    return pd.DataFrame({"u": u, "v": v, "equal": equal.astype(np.int32)})[u != v]


def _common(sets: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many shingles any two of the sets have in common: products of incidence matrices, some columns at a time."""
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    order = order[n[at[order]] > 1]
    _, at = np.unique(at[order], return_inverse=True)
    of, out = of[order], np.zeros((len(sets), len(sets)), dtype=np.float32)
    for c in range(0, int(at.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(at, [c, c + columns])
        x = np.zeros((len(sets), columns), dtype=np.float32)
        x[of[a:b], at[a:b] - c] = 1
        for r in range(0, len(sets), 1024):  # a product of all rows at once would be as large as the result
            out[r : r + 1024] += x[r : r + 1024] @ x.T
    return out


def _joins(x: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Rows (key, node, size, root, data: shingles) sorted by key -> links (u, v) between roots of a cell that have
    similar sets, thinned to stars: every pair of the cell is compared, at most a link for each root comes out."""
    root, size, data = x["root"].to_numpy(), x["size"].to_numpy(), x["data"].tolist()
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, n in zip(*_runs(x["key"].to_numpy()), strict=True):
        r = root[s : s + n]
        if (r == r[0]).all():
            continue
        common, own, found = _common([np.frombuffer(d, dtype=np.uint64) for d in data[s : s + n]]), size[s : s + n], []
        for a in range(0, n, 512):
            some = common[a : a + 512].astype(np.int64)
            hit = (100 * some >= percent * (own[a : a + 512, None] + own[None] - some)) & (r[a : a + 512, None] != r[None])
            found.append(np.nonzero(hit) + np.array([[a], [0]]))
        i, j = np.concatenate(found, axis=1)
        if len(i):
            nodes, least = roots(r[i], r[j])
            u.append(nodes[nodes != least])
            v.append(least[nodes != least])
    u, v = np.concatenate(u), np.concatenate(v)
    return pd.DataFrame({"u": u, "v": v, "equal": np.zeros(len(u), np.int32)})


def _cell_search(pairs, percent: int):
    """Batches sorted by key -> ``pairs`` of each cell."""

    def run(batches):
        held = None
        for x in batches:
            x = x if held is None else pd.concat([held, x], ignore_index=True)
            if not len(x):
                continue
            last = x["key"].iloc[-1]
            held = x[x["key"] == last]
            yield pairs(x[x["key"] != last], percent)
        if held is not None:
            yield pairs(held, percent)

    return run


def _searched(cells: DataFrame, pairs, name: str, percent: int, block: int, heavy: int = 1 << 22) -> DataFrame:
    """Cells (key, node, size, root, data) -> (u, v, equal) of ``pairs`` in each.

    Cells are counted first, by an aggregation with map-side combining. One of more than ``block`` nodes, or more than
    ``heavy`` shingles, is dealt as pairs of its blocks from the start, so it never passes through one task.
    """
    parts = F.greatest(F.ceil(F.count("*") / F.lit(block)), F.ceil(F.sum("size") * 2 / F.lit(heavy))).cast("int")
    counts = cells.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("s"), parts.alias("parts"))
    large = materialise(counts.where(((F.col("n") > block) | (F.col("s") > heavy)) & (F.col("n") > 2)).select("key", "parts"), f"simhash-{name}-large")
    spread = cells.join(large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    spread = spread.withColumns({"b": F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), "o": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    of_blocks = F.xxhash64("key", F.least("b", "o"), F.greatest("b", "o"))
    spread = spread.withColumn("key", F.when(F.col("parts") > 1, of_blocks).otherwise(F.col("key"))).drop("parts", "b", "o")
    dealt = spread.repartition("key").sortWithinPartitions("key")
    got = materialise(dealt.mapInPandas(_cell_search(pairs, percent), "u long, v long, equal int"), f"simhash-{name}")
    return got.groupBy("u", "v").agg(F.max("equal").alias("equal"))


def _thinned(edges: DataFrame) -> DataFrame:
    """Edges (u, v, equal) without those that a chain of edges of no less likeness spares: batches of whole components
    come out as spanning forests of the greatest likeness, parts of larger ones as forests of those parts."""
    edges = materialise(edges, "simhash-edges")
    named = edges.join(components(edges.select("u", "v")).withColumnRenamed("u", "_n"), F.col("u") == F.col("_n"), "left")
    named = named.select("u", "v", "equal", F.coalesce("root", "u").alias("root"))

    def run(batches):
        for b in batches:
            up: dict[int, int] = {}
            keep = []
            for u, v in zip(*(b.sort_values(["equal", "u", "v"], ascending=[False, True, True])[c].tolist() for c in ("u", "v")), strict=True):
                a, c = u, v
                while up.get(a, a) != a:
                    up[a] = a = up.get(up[a], up[a])
                while up.get(c, c) != c:
                    up[c] = c = up.get(up[c], up[c])
                if a != c:
                    up[a] = c
                    keep.append((u, v))
            yield pd.DataFrame(keep, columns=["u", "v"])

    with batch_rows(edges.sparkSession, 1 << 16):
        dealt = named.repartitionByRange("root", "u").sortWithinPartitions("root", "u")
        return materialise(dealt.mapInPandas(run, "u long, v long"), "simhash-thinned")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) of nodes whose texts (node, t) have that similarity, by their whole sets of shingles."""

    def run(batches):
        held, x = None, None
        for b in batches:
            keep = []
            for u, tu, tv in zip(b["u"], b["tu"], b["tv"], strict=True):
                if u != held:
                    held, x = u, shingles(tu, words)
                keep.append(alike(x, shingles(tv, words), percent))
            yield b.loc[keep, ["u", "v"]]

    got = pairs.join(texts.toDF("v", "tv"), "v").join(texts.toDF("u", "tu"), "u").select("u", "v", "tu", "tv")
    return materialise(got.mapInPandas(run, "u long, v long"), "simhash-verified")


def _identity(doc: str, text: str) -> dict:
    """Two hashes that tell rows of different id or text apart, never null."""
    return {"_d": F.xxhash64(F.lit(3), F.col(doc)), "_h": F.xxhash64(F.lit(4), F.col(text))}


def _shingles_udf(words: int):
    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingles(t, words).tobytes())

    return run


def similar_groups(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, bits: int = 4, seeds: tuple[int, ...] = (SEED,), percent: int = ALIKE, block: int = 4096) -> DataFrame:
    """One row (doc, _d, _h, _r, root) per row of ``docs``: documents link if their shingles are ``percent`` similar.

    Two documents are compared where they share a cell: a SimHash component, or one of the band keys, which find
    what lies beyond ``bits``. Texts of the same words are one node. In a cell, sketches of the sets give a spanning
    forest of the greatest likeness; what is left of all cells' forests after thinning is verified on the whole
    texts. Then, in each cell that still has several components, all pairs across them are compared by their whole
    sets of shingles, and the links come out as stars. Cells of over ``block`` nodes are searched in pairs of
    blocks; none is dropped, and no task emits all pairs of a group.
    """
    groups = near_duplicates(docs, doc, text, words, bits, seeds=seeds).select("text_hash", "root").dropDuplicates(["text_hash"])
    marked = docs.select(F.col(doc).alias(doc), row_hash(docs, 5).alias("_r"), F.xxhash64(text).alias("text_hash"), *[v.alias(k) for k, v in _identity(doc, text).items()], _band_udf(words)(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    marked = materialise(marked.select(doc, "text_hash", "_d", "_h", "_r", "s.*"), "simhash-bands")
    one = F.min(F.struct("_d", "_h", "text_hash")).alias("one")
    nodes = materialise(marked.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), one), "simhash-nodes")
    near = nodes.join(groups.withColumnRenamed("text_hash", "h"), nodes["one.text_hash"] == F.col("h")).select(F.xxhash64(F.lit("root"), "root").alias("key"), "node")
    cells = materialise(nodes.select(F.explode("keys").alias("key"), "node").union(near), "simhash-cells")
    shared = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    shared = materialise(cells.join(shared, "key"), "simhash-shared")
    first = shared.join(nodes.select("node", "size", F.col("sketch").alias("data")), "node")
    stars = _thinned(_searched(first, _forests, "forest", percent, block))
    wanted = shared.select("node").distinct().join(nodes.select("node", "one._d", "one._h"), "node")
    keyed = docs.select(*[v.alias(k) for k, v in _identity(doc, text).items()], F.col(text).alias("t"))
    texts = materialise(keyed.join(wanted, ["_d", "_h"]).select("node", "t").dropDuplicates(["node"]), "simhash-texts")
    links = _verified(stars, texts, words, percent)
    placed = shared.join(components(links).withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialise(placed, "simhash-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
    open_ = materialise(placed.join(mixed, "key"), "simhash-open")
    sets = open_.select("node").distinct().join(texts, "node").select("node", _shingles_udf(words)(F.coalesce("t", F.lit(""))).alias("data"))
    rest = open_.join(sets, "node").withColumn("size", (F.octet_length("data") / 8).cast("long"))
    rest = _searched(rest, _joins, "joins", percent, block).select("u", "v")
    found = components(links.union(materialise(rest, "simhash-rest")))
    return marked.join(found.withColumnRenamed("u", "node"), "node", "left").select(doc, "_d", "_h", "_r", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = 5, bits: int = 4, seeds: tuple[int, ...] = (SEED,), percent: int = ALIKE) -> DataFrame:
    """``docs`` with one document of each group of ``similar_groups``: the one of the smallest id, then text hash, then hash of the whole
    row, so that rows of the same id and text, but of different source, do not take turns."""
    groups = similar_groups(docs, doc, text, words, bits, seeds, percent)
    first = F.min(F.struct(F.col(doc).isNull(), F.col(doc).alias("k"), F.col("_h").alias("_h"), F.col("_d").alias("_d"), F.col("_r").alias("_r"))).alias("m")
    kept = materialise(groups.groupBy("root").agg(first).select("m._d", "m._h", "m._r"), "simhash-kept")
    # dropping repeats deals the texts by the same keys as the join: one shuffle of them
    own = _identity(doc, text) | {"_r": row_hash(docs, 5)}
    return docs.withColumns(own).dropDuplicates(list(own)).join(kept, list(own), "left_semi").select(*docs.columns)


def hex_fingerprint(fp="fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
