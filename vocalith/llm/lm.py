"""LM scoring: word counts over the corpus, and a numpy self-attention model over subword ids.

The documents are split into words once. A chunk (the words of some megabytes of text) keeps each different
word once, with its number in training documents, and its texts as numbers of words; only chunk vocabularies are
shuffled, not tokens, each as one row a bucket of words. One shuffle by bucket sums the counts and gives each different
word its subword ids, one by chunk brings both back. A chunk then has all that learning and scoring need: each is one pass
over the chunks with batched matrix products; no vocabulary is ever broadcast or collected.

Base score: smoothed unigram over words. Model: a distribution over the same events, the words known from training
and one event for all others. A known word has m b + (1 - m) (1 - u) a, with b the base's probability and a the
attention model's probability of the word's subwords in context (see attention.py); the unknown event has
m b + (1 - m) u, with u the share of words that occur once in training (Good and Turing's estimate). As the
spellings of the known words have at most 1 together, so have all events. The end of a text is a symbol like any
other, and known.

Training: all training documents. Word, symbol and neighbour counts are sums over all of them; the attention weights and
components learn from each of them once at least: the rounds after the first share them out by hash, ``per_task`` a
round at least (so few documents are all learned from in each). In a round each task goes over the documents of its
chunks, then the tasks' weights are averaged and the components' counts added. The first round is one
task's on about ``per_task`` documents from all chunks: it tells the components apart. The mixture's share m is fitted to
all training tokens: before a text is learned from, each of its tokens is judged (the words of its own text not
counted), and what settles m, the proportion of both models' probabilities, is counted in narrow bins.

Cases: a null text is empty: the end token alone is scored; ids may be null or repeated, each row is scored; an
empty training side gives log10(1 / 1) for each unknown token in the base, and m is 0; very long texts are split and
scored whole; other columns are not read.
"""

from __future__ import annotations

import io
import uuid
from itertools import chain
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import bounded_batches, give_back, materialise, shared_dir

_CHUNK = 10 << 20
#: Symbols that are scored, or trained on, at a time.
_SYMBOLS = 1 << 18
#: Bins of ln(base's probability / model's), and how many make up 1.
_BINS, _FINE, _LONG = 8192, 64, 64
#: Documents that a round takes at least, whatever ``per_task``: few tell no components apart.
_LEAST = 256
#: Learning rates of the rounds.
RATES = (0.02, 0.02, 0.01, 0.004)
#: Training documents are told apart by a hash.
_HASHES = 1 << 30


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """A-Z lower-cased; the words of all texts end to end, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = parts.flatten(), np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))])
    real = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return flat.filter(real), np.diff(kept[offsets])


def squeeze(codes: np.ndarray) -> bytes:
    """32-bit numbers, compressed plane by plane of their bytes."""
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(codes) else b""


def unsqueeze(data, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, dtype=np.int32)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


@dataclass
class Base:
    """Training tokens, different ones, the model's probability of an unknown word, training documents."""

    total: int
    distinct: int
    new: float
    end: int


_CHUNK_ROWS = "chunk long, kind int, bucket int, start int, k int, words string, n binary, train long, texts binary, codes binary"


def chunk_corpus(docs: DataFrame, doc: str, text: str, held_out: Column, chunk_bytes: int = _CHUNK) -> DataFrame:
    """kind 0: the different words of a chunk in a bucket (``k`` from index ``start`` on, with blanks between them) and their
    numbers in training; kind 1: the chunk's texts (ids, flags, hashes, lengths as an Arrow stream), how many are for
    training, and their words as indexes."""
    bounded_batches(docs.sparkSession, rows=8192, size="2m")
    i32, i64, raw = pa.int32(), pa.int64(), pa.binary()
    schema = pa.schema([("chunk", i64), ("kind", i32), ("bucket", i32), ("start", i32), ("k", i32), ("words", pa.string()), ("n", raw), ("train", i64), ("texts", raw), ("codes", raw)])
    # so many that a bucket's words fit in memory, and so few that a chunk has hundreds of words for each
    parts = docs.rdd.getNumPartitions()
    buckets = min(max(16, 4 * parts), max(256, parts // 8))

    def run(batches):
        from pyspark import TaskContext

        held, size, name = [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= chunk_bytes:
                yield from chunk(pa.Table.from_batches(held), name)
                held, size, name = [], 0, name + 1
                give_back()
        if held:
            yield from chunk(pa.Table.from_batches(held), name)
            held = []
        give_back()

    def chunk(t: pa.Table, name: int):
        t = t.combine_chunks()
        if not len(t):
            return
        words, lengths = split_words(t["t"].chunk(0))
        coded = words.dictionary_encode()
        # words are numbered bucket by bucket
        of = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False) % buckets
        by = np.argsort(of, kind="stable")
        place = np.empty(len(by), dtype=np.int32)
        place[by] = np.arange(len(by))
        codes = place[coded.indices.to_numpy(zero_copy_only=False)]
        out = t["h"].to_numpy().astype(bool)
        n = np.bincount(codes[~np.repeat(out, lengths)], minlength=len(by))
        sink = io.BytesIO()
        about = pa.table({"d": t["d"], "h": t["h"], "x": t["x"], "n": pa.array(lengths.astype(np.int64))})
        with pa.ipc.new_stream(sink, about.schema) as w:
            w.write_table(about)
        yield rows({"chunk": [name], "kind": [1], "train": [int((~out).sum())], "texts": [sink.getvalue()], "codes": [squeeze(codes)]})
        if len(by):
            many = np.bincount(of.astype(np.int64), minlength=buckets)
            start, some = np.cumsum(many) - many, np.flatnonzero(many)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start[some], len(by)), i32), coded.dictionary.cast(pa.string()).take(pa.array(by)))
            yield rows({"chunk": np.full(len(some), name), "kind": np.zeros(len(some), np.int32), "bucket": some, "start": start[some], "k": many[some], "words": pc.binary_join(lists, " "), "n": [squeeze(n[i : i + k]) for i, k in zip(start[some], many[some], strict=True)]})

    def rows(columns: dict) -> pa.RecordBatch:
        size = len(columns["chunk"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    return docs.select(F.col(doc).alias("d"), F.col(text).alias("t"), held_out.alias("h"), _hash(doc, text).alias("x")).mapInArrow(run, _CHUNK_ROWS)


class Subwords:
    """Symbols of words: subword ids of " word", with the number of ids added for the last one of a word."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ids = self.tokenizer.get_vocab_size()
        self.initial = np.zeros(2 * self.ids + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.initial[[i, i + self.ids]] = token.startswith("Ġ")
        self.final = np.arange(2 * self.ids + 1) >= self.ids
        #: The end of a text.
        self.end = 2 * self.ids

    def together(self, words: list[str], at_once: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words end to end, and how many each word has."""
        parts = [np.zeros(0, dtype=np.int32)], [np.zeros(0, dtype=np.int64)]
        for i in range(0, len(words), at_once):
            ids = [e.ids or [0] for e in self.tokenizer.encode_batch_fast([" " + w for w in words[i : i + at_once]], add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
            flat[np.cumsum(sizes) - 1] += self.ids
            parts[0].append(flat)
            parts[1].append(sizes)
        return np.concatenate(parts[0]), np.concatenate(parts[1])

    def __call__(self, words: list[str]) -> list[np.ndarray]:
        flat, sizes = self.together(words)
        return np.split(flat, np.cumsum(sizes)[:-1]) if words else []


_SUBWORDS: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _SUBWORDS:
        _SUBWORDS[path] = Subwords(path)
    return _SUBWORDS[path]


def _spelled(path: str):
    """All rows of a bucket of words -> a row for each: counts and symbols of its words; counted is 2 c, plus 1 where no
    other row tells of the word."""

    def run(t: pa.Table) -> pa.Table:
        s, t = subwords(path), t.combine_chunks()
        k = t["k"].to_numpy().astype(np.int64)
        coded = pc.split_pattern(t["words"].chunk(0), " ").flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        n = np.concatenate([unsqueeze(x, i) for x, i in zip(t["n"].to_pylist(), k, strict=True)])
        c = np.bincount(codes, weights=n).astype(np.int64)
        latest = np.maximum.accumulate(codes)  # words are numbered as they come
        counted = 2 * c[codes] + np.concatenate([[True], latest[1:] > latest[:-1]])
        flat, sizes = s.together(coded.dictionary.to_pylist())
        starts, ends = np.cumsum(sizes) - sizes, np.cumsum(k)
        out = []
        for i, j in zip(ends - k, ends, strict=True):
            of = codes[i:j]
            mine = flat[_ranges(starts[of], sizes[of])]
            out.append((pa.compress(counted[i:j].astype("<i8").tobytes(), codec="zstd", asbytes=True), squeeze(sizes[of]), len(mine), squeeze(mine)))
        give_back()
        return pa.table({"chunk": t["chunk"], "start": t["start"], "k": t["k"]} | {name: pa.array(x, kind) for name, x, kind in zip(("counted", "sizes", "n", "flat"), zip(*out, strict=True), (pa.binary(), pa.binary(), pa.int64(), pa.binary()), strict=True)})

    return run


_VOCABULARY = "k long, counted binary, sizes binary, n long, flat binary"
_READY_ROWS = f"chunk long, train long, texts binary, codes binary, {_VOCABULARY}"


def _vocabulary(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By word: count in training, whether no other row tells of it, number of symbols; the symbols."""
    k = row["k"]
    counted = np.frombuffer(pa.decompress(row["counted"], decompressed_size=8 * k, codec="zstd"), dtype="<i8") if k else np.zeros(0, dtype=np.int64)
    return counted >> 1, (counted & 1).astype(bool), unsqueeze(row["sizes"], k).astype(np.int64), unsqueeze(row["flat"], row["n"])


def _ready(stored: DataFrame, path: str) -> DataFrame:
    """One row a chunk: its texts and codes, and by index of its ``k`` different words their counts in training and
    their symbols (``n`` in all)."""
    words = stored.where("kind = 0").select("chunk", "bucket", "start", "k", "words", "n")
    spelled = words.groupBy("bucket").applyInArrow(_spelled(path), "chunk long, start int, k int, counted binary, sizes binary, n long, flat binary")
    texts = stored.where("kind = 1").select(F.col("chunk").alias("of"), "train", "texts", "codes")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [_vocabulary(x) for x in sorted(left.to_pylist(), key=lambda x: x["start"])]
        row = {"k": [0], "counted": [b""], "sizes": [b""], "n": [0], "flat": [b""]}
        if parts:
            c, first, sizes, flat = (np.concatenate(x) for x in zip(*parts, strict=True))
            counted = pa.compress((2 * c + first).astype("<i8").tobytes(), codec="zstd", asbytes=True)
            row = {"k": [len(c)], "counted": [counted], "sizes": [squeeze(sizes)], "n": [len(flat)], "flat": [squeeze(flat)]}
        give_back()
        return pa.table({"chunk": right["of"], "train": right["train"], "texts": right["texts"], "codes": right["codes"]} | row)

    chunks = texts.count()  # small ones are many tasks' too
    return spelled.repartition(max(1, chunks), "chunk").groupBy("chunk").cogroup(texts.groupBy("of")).applyInArrow(run, _READY_ROWS)


class Chunk:
    """A chunk opened: ``about`` its texts, ``codes`` their words, and by word ``c`` (count in training), ``first`` (no
    other chunk tells of it), ``sizes`` and ``flat`` (symbols)."""

    def __init__(self, row: dict):
        self.about = pa.ipc.open_stream(row["texts"]).read_all()
        self.lengths = self.about["n"].to_numpy()
        self.codes = unsqueeze(row["codes"], int(self.lengths.sum()))
        self.c, self.first, self.sizes, self.flat = _vocabulary(row)
        self.training, self.hash = ~self.about["h"].to_numpy().astype(bool), self.about["x"].to_numpy()

    def tokens(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of some texts end to end, an end (number len(c)) after each; how many tokens each has."""
        lengths = self.lengths[which]
        of, tokens = np.full(int(lengths.sum()) + len(which), len(self.c), dtype=np.int32), lengths + 1
        words = np.ones(len(of), dtype=bool)
        words[np.cumsum(tokens) - 1] = False
        of[words] = self.codes[_ranges((np.cumsum(self.lengths) - self.lengths)[which], lengths)]
        return of, tokens

    def blocks(self, chosen: np.ndarray, end: int, block: int = _SYMBOLS):
        """The chosen texts, about ``block`` symbols at a time: which texts, codes (the end is the last), the number of
        tokens of each text, symbols, symbols of each token and of each text."""
        which = np.flatnonzero(chosen)
        if not len(which):
            return
        sizes, flat = np.append(self.sizes, 1), np.append(self.flat, np.int32(end))
        starts = np.cumsum(sizes) - sizes
        of, tokens = self.tokens(which)
        ends = np.cumsum(tokens)
        firsts, size = ends - tokens, sizes[of]
        per = np.add.reduceat(size, firsts)
        cuts = np.flatnonzero(np.diff(np.concatenate([[-1], (np.cumsum(per) - per) // block])))
        for i, j in zip(cuts, [*cuts[1:], len(which)], strict=True):
            at = slice(firsts[i], ends[j - 1])
            yield which[i:j], of[at], tokens[i:j], flat[_ranges(starts[of[at]], size[at])], size[at], per[i:j]


def _chunks(batches):
    for b in batches:
        for row in b.to_pylist():
            yield Chunk(row)
            give_back()


def _symbol_counts(ready: DataFrame, kinds: int) -> tuple[np.ndarray, int, int]:
    """Occurrences of each symbol in the training corpus (not of the end), its different words and those that occur once."""

    def run(batches):
        total = np.zeros(kinds + 2, dtype=np.int64)
        for row in (row for b in batches for row in b.to_pylist()):
            c, first, sizes, flat = _vocabulary(row)
            c = c * first  # each word once
            total[:kinds] += np.bincount(flat, weights=np.repeat(c, sizes), minlength=kinds).astype(np.int64)
            total[kinds:] += [np.count_nonzero(c), np.count_nonzero(c == 1)]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["s", "n"])

    got = ready.select("k", "counted", "sizes", "n", "flat").mapInArrow(run, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(kinds + 2, dtype=np.int64)
    out[got["s"].to_numpy(dtype=np.int64)] = got["n"]
    return out[:kinds], int(out[kinds]), int(out[kinds + 1])


def _hash(doc: str, text: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(5), F.col(doc), F.col(text)), F.lit(_HASHES))


def _symbols_of(texts: pa.Array, path: str) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts end to end, words in each text, symbols end to end (with the end of each text), symbols of
    each word or end."""
    s = subwords(path)
    words, lengths = split_words(texts)
    coded = words.dictionary_encode()
    spelled = s(coded.dictionary.to_pylist()) + [np.array([s.end], dtype=np.int32)]
    ends = np.cumsum(lengths)
    codes = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), ends, len(spelled) - 1) if len(words) else np.full(len(lengths), len(spelled) - 1)
    sizes = np.array([len(x) for x in spelled], dtype=np.int64)
    flat = np.concatenate(spelled)
    return words, lengths, flat[_ranges((np.cumsum(sizes) - sizes)[codes], sizes[codes])], sizes[codes]


def _neighbours(ready: DataFrame, counts: np.ndarray, end: int, tasks: int, top: int = 3000, context: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """The commonest symbols and how often the commonest of all stand before and after each in the training corpus:
    summed on the executors, ``top`` x 2 ``context`` numbers come back."""
    order = np.argsort(-counts, kind="stable")[: min(top, int((counts > 0).sum()))]
    context = min(context, len(order))
    place = np.full(len(counts), -1, dtype=np.int32)
    place[order] = np.arange(len(order))
    shared = ready.sparkSession.sparkContext.broadcast(place)

    def count(total, now, before, n):
        for a, c, shift in ((now, before, 0), (before, now, context)):
            known = np.flatnonzero((a >= 0) & (c >= 0) & (c < context))
            total += np.bincount(a[known] * 2 * context + shift + c[known], weights=None if n is None else n[known], minlength=len(total))

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(len(order) * 2 * context)
        for x in _chunks(batches):
            at, ends = shared.value[x.flat].astype(np.int64), np.cumsum(x.sizes)
            # inside words, as often as each word stands in training texts
            n = np.repeat(np.bincount(x.codes[np.repeat(x.training, x.lengths)], minlength=len(x.c)), x.sizes)
            inside = np.ones(len(at), dtype=bool)
            inside[ends - x.sizes] = False
            later = np.flatnonzero(inside)
            count(total, at[later], at[later - 1], n[later])
            # from word to word; a text's first one has none before it
            of, tokens = x.tokens(np.flatnonzero(x.training))
            inside = np.ones(len(of), dtype=bool)
            inside[np.cumsum(tokens) - tokens] = False
            first, last = (np.append(at[i], shared.value[end])[of] for i in (ends - x.sizes, ends - 1))
            later = np.flatnonzero(inside)
            count(total, first[later], last[later - 1], None)
        yield pd.DataFrame({"task": [TaskContext.get().partitionId()], "model": [total.astype(np.float32).tobytes()]})

    joint = _added(ready.mapInArrow(_as_arrow(run), "task long, model binary"), tasks)
    joint = joint if len(joint) else np.zeros(len(order) * 2 * context)
    return order, joint.reshape(len(order), 2 * context).astype(np.float64)


def _as_arrow(run):
    def inner(batches):
        for x in run(batches):
            yield pa.RecordBatch.from_pandas(x, preserve_index=False)
        give_back()

    return inner


def _added(blobs: DataFrame, tasks: int, at_once: int = 16) -> np.ndarray:
    """Sum of the models (task, model), ``at_once`` at a time, so neither a task nor the driver holds more."""

    def add(x: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(x["model"].iloc[0]) // 4, dtype=np.float64)
        for m in x["model"]:
            total += np.frombuffer(m, dtype=np.float32)
        return pd.DataFrame({"task": x["task"].iloc[:1] // at_once, "model": [total.astype(np.float32).tobytes()]})

    while tasks > 1:
        blobs = blobs.groupBy(F.floor(F.col("task") / at_once)).applyInPandas(add, "task long, model binary")
        tasks = -(-tasks // at_once)
    rows = blobs.collect()
    return np.frombuffer(rows[0]["model"], dtype=np.float32) if rows else np.zeros(0, np.float32)


def _first_round(ready: DataFrame, end: int, least: int) -> DataFrame:
    """Symbols of the training documents with the ``least`` hashes, of all chunks, on one task."""

    def run(batches):
        for x in _chunks(batches):
            for _, _, _, flat, _, per in x.blocks(x.training & (x.hash < least), end):
                ends = np.cumsum(per)
                got = [flat[i:j].astype("<i4").tobytes() for i, j in zip(ends - per, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary())], names=["symbols"])

    return ready.mapInArrow(run, "symbols binary").repartition(1)


def _blocks(batches):
    """Binary symbols of texts -> blocks of about _SYMBOLS symbols: (symbols, lengths)."""
    held, size = [], 0
    for b in batches:
        for x in b.column("symbols").to_pylist():
            held.append(np.frombuffer(x, dtype="<i4"))
            size += len(held[-1])
            if size >= _SYMBOLS:
                yield np.concatenate(held), np.array([len(h) for h in held], dtype=np.int64)
                held, size = [], 0
    if held:
        yield np.concatenate(held), np.array([len(h) for h in held], dtype=np.int64)


def _rounds(n: int, n_train: int, per_task: int) -> tuple[int, list[tuple[int, int]]]:
    """How many of the hashes the first of ``n`` rounds takes, and from which on and how many each of the others takes,
    on a circle: all of them together."""
    least = min(_HASHES, max(per_task, _LEAST) * _HASHES // max(1, n_train))
    cuts = [i * _HASHES // max(1, n - 1) for i in range(n)]
    return (least, [(i, max(j - i, least)) for i, j in zip(cuts, cuts[1:], strict=False)]) if n > 1 else (_HASHES, [])


def _ratios(x: Chunk, w: np.ndarray, of: np.ndarray, tokens: np.ndarray, sizes: np.ndarray, logs: np.ndarray, base: Base) -> np.ndarray:
    """How often ln(base's probability / model's) falls in each bin, for the tokens ``of`` the texts ``w``, whose own
    words don't count; ``logs``: ln P of their symbols. All tokens of a text weigh as _LONG together if there are more: texts
    count alike, and no long one settles the share."""
    text = np.repeat(np.arange(len(w)), tokens)
    _, back, own = np.unique(text * (len(x.c) + 1) + of, return_inverse=True, return_counts=True)
    c = np.append(x.c, base.end)[of] - own[back]
    a = np.maximum(np.add.reduceat(logs.astype(np.float64), np.cumsum(sizes) - sizes), -700.0)
    a = np.where(c > 0, a + np.log(1 - base.new), np.log(base.new))
    ratio = np.log((c + 1) / (base.total + base.distinct + 1)) - a
    return np.bincount(np.clip(np.floor(ratio * _FINE).astype(np.int64) + _BINS // 2, 0, _BINS - 1), weights=np.repeat(np.minimum(1.0, _LONG / tokens), tokens), minlength=_BINS)


def _train(ready: DataFrame, tasks: int, model: attention.Model, rates: tuple[float, ...], base: Base, n_train: int, per_task: int, end: int) -> attention.Model:
    """Rounds of training on the executors, over all training documents; ``judged`` of the model settles the mixture's share."""
    spark = ready.sparkSession
    least, parts = _rounds(len(rates), n_train, per_task)
    size = model.flat().size
    many = model.seen.size

    def packed(m: attention.Model, since: np.ndarray, judged: np.ndarray) -> pd.DataFrame:
        x = m.flat()
        x[-many:] -= since.ravel()
        from pyspark import TaskContext

        return pd.DataFrame({"task": [TaskContext.get().partitionId()], "model": [np.concatenate([x, judged, [1.0]]).astype(np.float32).tobytes()]})

    for i, rate in enumerate(rates):
        shared, last = spark.sparkContext.broadcast(model), i == len(rates) - 1
        part, before = (parts[i - 1], parts[: i - 1]) if i else (None, [])
        # counts of documents that no other round learns from are kept
        keep = 1.0 if last or (i and part[1] < _HASHES) else 0.9

        def first(batches, shared=shared, rate=rate, keep=keep):
            learned = [0]

            def texts():
                for symbols, lengths in _blocks(batches):
                    learned[0] += len(symbols)
                    yield symbols, lengths

            got = attention.train(shared.value, texts(), rate, keep, seed=0)
            if learned[0]:
                yield packed(got, shared.value.seen, np.zeros(_BINS))

        def later(batches, shared=shared, rate=rate, keep=keep, i=i, part=part, before=before):
            from pyspark import TaskContext

            judged, learned, now = np.zeros(_BINS), [0], []

            def inside(u, at):
                return (u - at[0]) % _HASHES < at[1]

            def texts():
                for x in _chunks(batches):
                    u = x.hash
                    fresh = ~np.any([inside(u, p) for p in before], axis=0) if before else np.ones(len(u), dtype=bool)
                    for w, of, tokens, symbols, sizes, per in x.blocks(x.training & inside(u, part), end):
                        now[:] = [x, w, of, tokens, sizes, fresh[w]]
                        learned[0] += len(symbols)
                        yield symbols, per

            def heard(logs):
                x, w, of, tokens, sizes, fresh = now
                if fresh.any():
                    t = np.repeat(fresh, tokens)
                    judged[:] += _ratios(x, w[fresh], of[t], tokens[fresh], sizes[t], logs[np.repeat(t, sizes)], base)

            got = attention.train(shared.value, texts(), rate, keep, seed=100 * i + TaskContext.get().partitionId() % 97, heard=heard)
            if learned[0]:
                yield packed(got, shared.value.seen, judged)

        if i:
            got = _added(ready.mapInArrow(_as_arrow(later), "task long, model binary"), tasks)
        else:
            got = _added(_first_round(ready, end, least).mapInArrow(_as_arrow(first), "task long, model binary"), 1)
        if len(got):
            x, k = got[:size].copy(), got[-1]
            x[:-many] /= k
            # counts of tasks that forget are averaged, else each adds its own
            x[-many:] = np.maximum(0, model.seen.ravel() + x[-many:] / (1 if keep == 1 else k))
            judged = model.judged if model.judged is not None else 0
            model = replace(model.with_flat(x), judged=judged + got[size:-1].astype(np.float64))
    return model


def _mixture_share(model: attention.Model, docs: DataFrame, doc: str, text: str, training: Column, path: str, base: Base, judged: int, longest: int) -> float:
    """m by expectation maximisation over what the rounds of training judged: all training tokens. Without any such round, over
    ``judged`` texts by hash. Of one of more than ``longest`` characters that many from a place by hash on are taken,
    without words cut in two."""
    if model.judged is not None and model.judged.any():
        seen = np.flatnonzero(model.judged)
        return _likeliest(np.exp((seen - _BINS // 2 + 0.5) / _FINE), model.judged[seen])
    h, n = _hash(doc, text), F.length(text)
    whole = r"^[^\x20\x09-\x0D]+|[^\x20\x09-\x0D]+$"
    stretch = F.regexp_replace(F.substring(F.col(text), (F.pmod(h, F.greatest(n - longest, F.lit(1))) + 1).cast("int"), F.lit(longest)), whole, "")
    t = F.when(n > longest, stretch).otherwise(F.col(text))
    rows = docs.where(training & F.col(text).isNotNull()).select(h.alias("h"), t.alias("t")).orderBy("h", "t").limit(judged).collect()
    if not rows:
        return 0.5
    flat, lengths, symbols, per = _symbols_of(pa.array([r["t"] for r in rows], pa.string()), path)
    own = pc.value_counts(flat)
    own = dict(zip(own.field("values").to_pylist(), own.field("counts").to_pylist(), strict=True))
    words = _words_of(docs, text, training, list(own)) if own else {}
    c = {k: words.get(k, 0) - n for k, n in own.items()}
    ends = np.cumsum(lengths)
    counts = np.insert(np.array([c.get(w, 0) for w in flat.to_pylist()], dtype=np.int64), ends, base.end)
    tokens = lengths + 1
    logs = attention.symbol_logs(symbols, np.add.reduceat(per, np.cumsum(tokens) - tokens), model)
    a = np.exp(np.maximum(np.add.reduceat(logs.astype(np.float64), np.cumsum(per) - per), -700.0))
    a, b = np.where(counts > 0, (1 - base.new) * a, base.new), (counts + 1) / (base.total + base.distinct + 1)
    return _likeliest(b / a, np.ones(len(b)))


def _likeliest(ratio: np.ndarray, n: np.ndarray) -> float:
    """The share of the base that makes ``n`` tokens likeliest, by base's probability / model's."""
    m = 0.5
    for _ in range(50):
        m = float((np.sum(n * m * ratio / (m * ratio + 1 - m)) + 10) / (n.sum() + 20))  # few texts settle little
    return m


def _words_of(docs: DataFrame, text: str, training: Column, words: list[str]) -> dict[str, int]:
    """Occurrences of some words in the training documents."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = docs.where(training).select(F.explode(F.split(low, r"[\x20\x09-\x0D]+")).alias("word"))
    some = docs.sparkSession.createDataFrame([(w,) for w in words], "word string")
    return {r["word"]: r["count"] for r in each.join(F.broadcast(some), "word").groupBy("word").count().collect()}


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (lengths[i] of them), end to end."""
    ends = np.cumsum(lengths)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)
    out += np.repeat((starts - ends + lengths).astype(np.int32), lengths)
    return out


def score_chunk(about: pa.Table, codes: np.ndarray, c: np.ndarray, flat: np.ndarray, sizes: np.ndarray, model: attention.Model, end: int, c_end: int, total: int, distinct: int, share: float, new: float, block: int = _SYMBOLS) -> dict[str, np.ndarray]:
    """All scores of a chunk. c, flat, sizes: counts and symbols of its different words, by index; ``share``: of the
    base; ``new``: the model's probability of an unknown word; ``block``: about how many symbols are scored at a time, whole texts."""
    lengths = about["n"].to_numpy()
    ends = np.cumsum(lengths)
    codes = np.insert(codes, ends, len(c)) if len(codes) else np.full(len(lengths), len(c), dtype=np.int32)
    c, sizes, flat = np.append(c, c_end), np.append(sizes, 1), np.append(flat, np.int32(end))
    tokens = lengths + 1
    firsts = np.cumsum(tokens) - tokens
    base = (c + 1) / (total + distinct + 1)
    starts = np.cumsum(sizes) - sizes
    per = np.add.reduceat(sizes[codes], firsts) if len(firsts) else firsts
    table, score = model.components(), np.zeros(len(lengths))
    cuts = np.flatnonzero(np.diff(np.concatenate([[-1], (np.cumsum(per) - per) // block]))) if len(per) else np.zeros(0, dtype=np.int64)
    for i, j in zip(cuts, [*cuts[1:], len(per)], strict=True):
        of = codes[firsts[i] : firsts[j - 1] + tokens[j - 1]]
        of_size = sizes[of]
        logs = attention.symbol_logs(flat[_ranges(starts[of], of_size)], per[i:j], model, table)
        a = np.exp(np.maximum(np.add.reduceat(logs.astype(np.float64), np.cumsum(of_size) - of_size), -700.0))
        mixed = share * base[of] + (1 - share) * np.where(c[of] > 0, (1 - new) * a, new)
        score[i:j] = np.add.reduceat(np.log10(mixed), firsts[i:j] - firsts[i])
    return {"n_tokens": tokens, "n_known": np.add.reduceat((c > 0).astype(np.int64)[codes], firsts), "base_score": np.add.reduceat(np.log10(base)[codes], firsts), "score": score}


def score(docs: DataFrame, path: str, held_out: Column, doc: str = "doc_id", text: str = "text", part: float = 1.0, per_task: int = 1500, rates: tuple[float, ...] = RATES, judged: int = 256, longest: int = 100_000, chunk_bytes: int = _CHUNK, block: int = _SYMBOLS) -> DataFrame:
    """Rows (doc, held_out, n_tokens, n_known, train_tokens, base_score, score) for all of ``docs``."""
    if part != 1.0:
        raise ValueError("all training documents are learned from: part can only be 1")
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/lm-chunks-{uuid.uuid4().hex}"
    rows = chunk_corpus(docs, doc, text, held_out, chunk_bytes)
    rows.write.partitionBy("kind").option("compression", "zstd").parquet(folder)
    ready = materialise(_ready(spark.read.schema(rows.schema).parquet(folder), path), "lm-ready")
    tasks = ready.rdd.getNumPartitions()
    n_train, s = ready.agg(F.sum("train")).first()[0] or 0, subwords(path)
    counts, distinct, once = _symbol_counts(ready, 2 * s.ids)
    # each word has one last symbol
    total = int(counts[s.ids :].sum()) + n_train
    base = Base(total, distinct + (n_train > 0), (once + 1) / (total + 2), n_train)
    counts = np.append(counts, n_train)
    of_class = attention.classes(*reversed(_neighbours(ready, counts, s.end, tasks)), counts, s.initial, s.final)
    model = _train(ready, tasks, attention.fresh(of_class, counts, s.initial, s.final), rates, base, n_train, per_task, s.end)
    mix = _mixture_share(model, docs, doc, text, ~held_out, path, base, judged, longest) if total else 0.0
    shared, end, kind = spark.sparkContext.broadcast(model), s.end, docs.schema[doc].dataType.simpleString()

    def run(batches):
        for x in _chunks(batches):
            got = score_chunk(x.about, x.codes, x.c, x.flat, x.sizes, shared.value, end, base.end, base.total, base.distinct, mix, base.new, block)
            columns = {doc: x.about["d"], "held_out": x.about["h"], "n_tokens": got["n_tokens"], "n_known": got["n_known"], "train_tokens": np.full(len(x.about), base.total), "base_score": got["base_score"], "score": got["score"]}
            yield from pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v) for k, v in columns.items()}).to_batches()
        give_back()

    return ready.mapInArrow(run, f"{doc} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
