"""Phrase collocation mining: exact counts of all phrases, and those that hold together best.

Texts are lower-cased (A-Z), split at punctuation and line ends into pieces, and pieces into words. Equal pieces of
a part become one, with its multiplicity (an aggregation with map-side combining). Each task then counts the
weighted n-grams of its pieces in duckdb, out of core, and hands them out in blobs by hash bucket; each bucket is
counted up in duckdb again. Duckdb spills, but fails on some ten times its memory, so a task counts its pieces in runs of
bounded size, and there are as many buckets as the words of all pieces ask for. A phrase, however frequent, has no more
than one row of each run in its bucket. Words and
pairs are counted first. A longer phrase cannot occur more often than the two that are one word shorter, so those of k
words are counted only where both of these are frequent, as far as a filter of a fixed number of bits can tell: it
never misses a frequent one, and what it lets through in vain is counted and found rare. The counts
of a candidate's parts are asked for by request rows, which are dealt by the part they ask for, answered in a join
whose large partitions can be split, and aggregated by candidate.

The number of words of a part is counted as the empty phrase. Scores are exact: decimals of 38 digits.

Cases: null text: no piece; null part: ``und``; pieces without words do not count; a very long piece is counted in
stretches that overlap, so a task needs no more memory; repeated rows count each time; an empty table gives no rows;
ids and other columns are not read. Task scratch space of duckdb is removed with the task.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, text_of
from .fingerprints import _tickets

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENDS = r"[.,;:!?\x0A-\x0D]"
_STRETCH = 20_000  # code points of a piece above which it is counted in stretches
_ROWS = 1 << 18  # rows of a batch that is dealt to buckets
_ROW_BYTES = 64  # what duckdb keeps of a row besides its phrase
_GRAMS = pa.schema([("part", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
_PIECES = pa.schema([("part", pa.string()), ("piece", pa.string()), ("starts", pa.int64()), ("n", pa.int64())])
_BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])


def pieces(docs: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """Rows (part, piece, n): different pieces, words joined by one blank, and how often each occurs."""
    clean = F.regexp_replace(F.translate(text_of(text), UPPER, LOWER), r"[\x20\x09]+", " ")
    rows = docs.select(F.coalesce(F.col(part).cast("string"), F.lit("und")).alias("part"), F.explode(F.split(clean, ENDS)).alias("piece"))
    rows = rows.select("part", F.trim("piece").alias("piece")).where("piece <> ''")
    return rows.groupBy("part", "piece").agg(F.count("*").alias("n"))


def _stretches(batches, longest: int) -> Iterator[pa.RecordBatch]:
    """Batches (part, piece, n) -> (part, piece, starts, n): phrases start at the first ``starts`` words (0: all)."""
    for b in batches:
        part, piece, n = b.columns
        long = np.flatnonzero(pa.compute.greater(pa.compute.utf8_length(piece), _STRETCH).to_numpy(zero_copy_only=False))
        if not len(long):
            yield pa.record_batch([part, piece, pa.array(np.zeros(len(b), dtype=np.int64)), n], schema=_PIECES)
            continue
        out = []
        for p, x, k in zip(part.to_pylist(), piece.to_pylist(), n.to_pylist(), strict=True):
            if len(x) <= _STRETCH:
                out.append((p, x, 0, k))
                continue
            w = x.split(" ")
            out += [(p, " ".join(w[a : a + 2000 + longest - 1]), 2000, k) for a in range(0, len(w), 2000)]
        for a in range(0, len(out), 200):
            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out[a : a + 200], strict=True), _PIECES, strict=True)], schema=_PIECES)


def _grams_sql(longest: int, buckets: int) -> str:
    def starting(k: int) -> str:
        words = " || ' ' || ".join(f"w[i + {j}]" if j else "w[i]" for j in range(k))
        return f"list_transform(range(1, least(s, len(w) - {k - 1}) + 1), lambda i: {words})"

    # the empty phrase at each word, so that one pass over the pieces is enough
    grams = ", ".join(["list_transform(range(s), lambda i: '')", *[starting(k) for k in range(1, longest + 1)]])
    return f"""
        WITH w AS (SELECT part, string_split(piece, ' ') AS w, starts, n FROM pieces),
        s AS (SELECT part, w, n, CASE WHEN starts = 0 THEN len(w) ELSE least(starts, len(w)) END AS s FROM w),
        g AS (SELECT part, unnest(flatten([{grams}])) AS phrase, n FROM s),
        c AS (SELECT part, phrase, sum(n)::BIGINT AS n FROM g GROUP BY part, phrase)
        SELECT (hash(part, phrase) % {buckets})::INT AS bucket, part, phrase, n FROM c"""


@contextmanager
def _duckdb(memory: str):
    """A connection of one thread that spills to a folder of the task's own."""
    import duckdb

    with tempfile.TemporaryDirectory(prefix="grams-") as spill:
        settings = {"threads": 1, "memory_limit": memory, "temp_directory": spill, "preserve_insertion_order": False}
        with duckdb.connect(":memory:", config=settings) as c:
            yield c


def _most(memory: str) -> int:
    """Bytes of rows that one aggregation in duckdb gets: a third of what was seen to fail."""
    return 3_000_000 * int(memory.removesuffix("MB"))


def _letters(column: pa.Array) -> int:
    return pa.compute.sum(pa.compute.binary_length(column)).as_py() or 0


def _phrases_size(longest: int):
    """Bytes of the rows that a batch of pieces gives, with phrases of up to ``longest`` words."""

    def size(b: pa.RecordBatch) -> int:
        words = len(b) + (pa.compute.sum(pa.compute.count_substring(b.column(1), " ")).as_py() or 0)
        return _letters(b.column(1)) * longest * (longest + 1) // 2 + words * longest * _ROW_BYTES

    return size


def _grams_size(b: pa.RecordBatch) -> int:
    return _letters(b.column(1)) + len(b) * _ROW_BYTES


def _in_runs(batches, size, most: int) -> Iterator[Iterator[pa.RecordBatch]]:
    """Runs of the batches, to be read one after the other; each ends where their sizes reach ``most``."""
    batches = iter(batches)

    def run(b):
        read = 0
        while b is not None:
            yield b
            read += size(b)
            b = next(batches, None) if read < most else None

    for first in batches:
        yield run(first)


def _blob(batch: pa.RecordBatch) -> bytes:
    raw = batch.serialize()
    return struct.pack("<q", raw.size) + pa.compress(raw, codec="zstd", asbytes=True)


def _unblob(data: bytes) -> pa.RecordBatch:
    return pa.ipc.read_record_batch(pa.decompress(data[8:], struct.unpack("<q", data[:8])[0], codec="zstd"), _GRAMS)


def _counter(table: str, source, size, sql: str, buckets: int, memory: str, tickets: list[int] | None = None):
    """A task's pieces -> blobs of phrase counts by bucket, or by the bucket's ticket. ``source`` makes of the batches those
    of the table that ``sql`` reads, in runs by ``size``."""
    batch_rows = min(max(_ROWS, 512 * buckets), 4 * _ROWS)  # blobs of many buckets would get small

    def counted(schema, rows):
        with _duckdb(memory) as c:
            c.register(table, pa.RecordBatchReader.from_batches(schema, rows))
            for got in c.sql(sql).to_arrow_reader(batch_rows):
                at = got.column(0).to_numpy()
                order = np.argsort(at, kind="stable")
                rows = got.select(["part", "phrase", "n"]).take(pa.array(order)).cast(_GRAMS)
                found, starts = np.unique(at[order], return_index=True)
                ends = [*starts[1:].tolist(), len(order)]
                dealt = found.tolist() if tickets is None else [tickets[k] for k in found]
                for k, a, b in zip(dealt, starts.tolist(), ends, strict=True):
                    yield pa.record_batch([pa.array([k], pa.int32()), pa.array([_blob(_own(rows, a, b))], pa.binary())], schema=_BLOBS)

    def run(batches):
        schema, rows = source(batches)
        for part in _in_runs(rows, size, _most(memory)):
            yield from counted(schema, part)

    return run


def _all_phrases(longest: int, buckets: int, memory: str, tickets: list[int] | None = None):
    """Counts every phrase of up to ``longest`` words, and the words."""
    source = lambda batches: (_PIECES, _stretches(batches, longest))
    return _counter("pieces", source, _phrases_size(longest), _grams_sql(longest, buckets), buckets, memory, tickets)


def _likely_phrases(k: int, bits: np.ndarray, buckets: int, memory: str, tickets: list[int] | None = None):
    """Counts the phrases of ``k`` words whose two phrases of one word less the filter takes for frequent."""
    source = lambda batches: (_GRAMS, _likely(_stretches(batches, k), k, bits))
    sql = f"SELECT (hash(part, phrase) % {buckets})::INT AS bucket, part, phrase, sum(n)::BIGINT AS n FROM grams GROUP BY part, phrase"
    return _counter("grams", source, _grams_size, sql, buckets, memory, tickets)


def _hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, computed once for each different one."""
    d = words.dictionary_encode()
    return pd.util.hash_array(np.array(d.dictionary.to_pylist(), dtype=object), categorize=False)[d.indices.to_numpy()]


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _phrase_hashes(part: np.ndarray, word: np.ndarray, k: int) -> np.ndarray:
    """The hash of the ``k`` words from each position on; ``part``: that of the position's part."""
    h = part[: len(word) - k + 1].copy()
    for j in range(k):
        h = (h ^ word[j : len(word) - k + 1 + j]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
    return h


def _positions(h: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter for each hash; ``n_bits`` is a power of two."""
    last = np.uint64(n_bits - 1)
    return (h & last).astype(np.int64), (h >> np.uint64(32) & last).astype(np.int64)


def _member(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), dtype=bool)
    for at in _positions(h, 8 * len(bits)):
        found &= (bits[at >> 3] >> (at & 7) & 1).astype(bool)
    return found


def _likely(batches, k: int, bits: np.ndarray):
    for b in batches:
        lists = pa.compute.split_pattern(b.column(1), " ")
        words, length = lists.flatten(), lists.value_lengths().to_numpy()
        if len(words) < k:
            continue
        of = np.repeat(np.arange(len(b)), length)  # the piece of each word
        ahead = np.concatenate([[0], np.cumsum(length)[:-1]])
        starts = b.column(2).to_numpy()
        inside = np.minimum(np.where(starts == 0, length, starts), length - k + 1)
        shorter = _member(bits, _phrase_hashes(_hashed(b.column(0))[of], _hashed(words), k - 1))
        m = len(words) - k + 1
        at = np.flatnonzero(shorter[:m] & shorter[1 : m + 1] & (np.arange(m) - ahead[of[:m]] < inside[of[:m]]))
        for a in range(0, len(at), 100_000):
            part = at[a : a + 100_000]
            phrase = pa.compute.binary_join_element_wise(*[words.take(pa.array(part + j)) for j in range(k)], " ")
            own = pa.array(of[part])
            yield pa.record_batch([b.column(0).take(own), phrase, b.column(3).take(own)], schema=_GRAMS)


def frequent_filter(counts: DataFrame, k: int, n_bits: int) -> np.ndarray:
    """The filter (bytes) of the phrases of ``k`` words in ``counts``: pages of bits are put together by aggregation,
    and the driver gets ``n_bits`` bits, however many phrases there are."""

    @F.pandas_udf("array<long>")
    def bits_of(part: pd.Series, phrase: pd.Series) -> pd.Series:
        words = _hashed(pa.array(" ".join(phrase).split(" "), pa.string()))
        h = _phrase_hashes(np.repeat(_hashed(pa.array(part, pa.string())), k), words, k)[::k] if len(phrase) else np.zeros(0, dtype=np.uint64)
        return pd.Series(list(np.stack(_positions(h, n_bits), axis=1)))

    page = 1 << 15
    own = counts.where(F.col("phrase") != "").where(F.size(F.split("phrase", " ")) == k)
    at = own.select(F.explode(bits_of("part", "phrase")).alias("at"))
    pages = at.groupBy((F.col("at") / page).cast("int").alias("page")).agg(F.call_function("bitmap_construct_agg", F.col("at") % page).alias("bits"))
    out = np.zeros(n_bits // 8, dtype=np.uint8)
    for r in pages.collect():
        a = r["page"] * page // 8
        out[a : a + page // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _own(rows: pa.RecordBatch, a: int, b: int) -> pa.RecordBatch:
    """Rows a to b with buffers of their own: a slice would be written with all that it is a slice of."""
    return rows.take(pa.array(np.arange(a, b)))


def _summer(least: int, memory: str):
    """The blobs of a bucket -> its phrases with counts of ``least`` and more, and the empty ones."""

    def run(batches):
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        blobs = (_unblob(x) for b in chain([first], batches) for x in b.column(0).to_pylist())
        sql = f"SELECT part, phrase, sum(n)::BIGINT AS n FROM grams GROUP BY part, phrase HAVING sum(n) >= {least} OR phrase = ''"
        with _duckdb(memory) as c:
            c.register("grams", pa.RecordBatchReader.from_batches(_GRAMS, blobs))
            for got in c.sql(sql).to_arrow_reader(100_000):
                yield got.cast(_GRAMS)

    return run


def _buckets(found: DataFrame, longest: int, memory: str) -> int:
    """So many that none gets more rows than duckdb can count up, were all phrases different."""
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    letters, words = found.agg(F.sum(F.octet_length("piece")), F.sum(words)).first()
    return -(-((letters or 0) * max(3, longest) + (words or 0) * 2 * _ROW_BYTES) // _most(memory))


def phrase_counts(found: DataFrame, longest: int = 3, least: int = 10, buckets: int | None = None, memory: str = "300MB", filter_bits: int = 1 << 26) -> DataFrame:
    """Rows of ``pieces`` -> (part, phrase, n): phrases of up to ``longest`` words that occur ``least`` times or more, and as
    the empty phrase the number of words of each part. ``buckets``: the least number of them. ``filter_bits``: a power of
    two, from 2^15 up."""
    spark = found.sparkSession
    bounded_batches(spark, rows=10_000)
    found = materialise(found, "phrase-pieces")
    buckets = max(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), _buckets(found, longest, memory))
    tickets = _tickets(spark, buckets)

    def counted(counter) -> DataFrame:
        blobs = found.mapInArrow(counter, "bucket int, blob binary")
        got = blobs.repartition(buckets, "bucket").select("blob").mapInArrow(_summer(least, memory), "part string, phrase string, n long")
        return materialise(got, "phrase-counts")

    out = last = counted(_all_phrases(min(longest, 2), buckets, memory, tickets))
    for k in range(3, longest + 1):
        last = counted(_likely_phrases(k, frequent_filter(last, k - 1, filter_bits), buckets, memory, tickets))
        out = out.union(last)
    return out


def exact_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (left right)) without a loss of digits."""
    a, left, right = (x.cast("decimal(38,0)") for x in (a, left, right))
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * a * a, left * right)


def collocations(docs: DataFrame, text: str = "text", part: str = "lang", longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, buckets: int | None = None) -> DataFrame:
    """Each part's ``top`` phrases (part, rank, phrase, a, l, r, n, score).

    A phrase is dropped if ``share`` in a hundred of its occurrences, or more, are inside one longer candidate."""
    counts = phrase_counts(pieces(docs, text, part), longest, least, buckets)
    words = F.split("phrase", " ")
    candidates = counts.select("part", "phrase", F.col("n").alias("a"), words.alias("w")).where((F.size("w") > 1) & (F.size("w") <= longest))
    joined = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    asked, inside = [], []
    for k in range(1, longest):
        here = F.size("w") > k
        asked += [F.when(here, F.struct(joined(F.lit(1), F.lit(k)).alias("asked"), F.lit(f"l{k}").alias("slot")))]
        asked += [F.when(here, F.struct(joined(F.lit(k + 1), F.size("w") - k).alias("asked"), F.lit(f"r{k}").alias("slot")))]
        inside += [F.when(F.size("w") > k + max(0, at - 1), joined(F.lit(1 + at), F.lit(k))) for at in range(longest - k + 1) if k > 1]
    requests = candidates.select("part", "phrase", F.explode(F.array_compact(F.array(*asked))).alias("r")).select("part", "phrase", "r.*")
    held = counts.select(F.col("part").alias("_part"), F.col("phrase").alias("_phrase"), "n")
    answers = requests.join(held, (F.col("part") == F.col("_part")) & (F.col("asked") == F.col("_phrase"))).select("part", "phrase", "slot", "n")
    told = answers.union(candidates.select("part", "phrase", F.lit("a"), "a"))
    if inside:
        shorter = candidates.select("part", F.explode(F.array_compact(F.array(*inside))).alias("phrase"), F.lit("in"), "a")
        told = told.union(shorter)
    slots = ["a", "in", *[f"{s}{k}" for k in range(1, longest) for s in "lr"]]
    got = told.groupBy("part", "phrase").agg(*[F.max(F.when(F.col("slot") == s, F.col("n"))).alias(s) for s in slots])
    # a shorter phrase occurs as often as a longer one that holds it, so each row here is a candidate
    got = got.where(~F.coalesce(F.col("in") * 100 >= F.col("a") * share, F.lit(False)))
    cuts = [F.when(F.col(f"l{k}").isNotNull(), F.struct(exact_score(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, longest)]
    got = got.withColumn("c", F.array_min(F.array_compact(F.array(*cuts)))).select("part", "phrase", "a", "c.l", "c.r", "c.score")
    order = Window.partitionBy("part").orderBy(F.desc("score"), F.desc("a"), "phrase")
    got = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select(F.col("part").alias("_part"), F.col("n"))
    got = got.join(totals, F.col("part") == F.col("_part"))
    return got.select(F.col("part").alias(part), F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
                  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, unnest(w) AS g, 1 AS k FROM w
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 FROM w
      UNION ALL SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 FROM w),
f AS (SELECT lang, g, k, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, g, k, n AS a, string_split(g, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
x AS (SELECT lang, g, k, a, 1 AS cut, w[1] AS h, array_to_string(w[2:], ' ') AS u FROM c
      UNION ALL SELECT lang, g, k, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (SELECT x.lang, x.g, x.k, x.a, x.cut, l.n AS l, r.n AS r, (1000000::HUGEINT * x.a * x.a) // (l.n::HUGEINT * r.n) AS score
      FROM x JOIN f AS l ON l.lang = x.lang AND l.g = x.h JOIN f AS r ON r.lang = x.lang AND r.g = x.u),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT lang, g, max(a) AS a FROM (SELECT lang, w[1] || ' ' || w[2] AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
d AS (SELECT b.* FROM b LEFT JOIN i ON b.lang = i.lang AND b.g = i.g WHERE NOT coalesce(100 * i.a >= 50 * b.a, false)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM d)
SELECT o.lang, o.rank, o.g AS phrase, o.a, o.l, o.r, CAST(t.n AS BIGINT) AS n, CAST(o.score AS BIGINT) AS score
FROM o JOIN t ON o.lang = t.lang WHERE o.rank <= 2000
"""
