"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every triplet of consecutive UTF-8 bytes is hashed into one of 256 buckets. The three quartiles of the bucket
counts split the buckets into four classes, two bits each; with the length on a logarithmic scale in front they
are the digest, a hex string of 2 + 128 digits. Two digests differ by the sum of their class differences (an
opposite class counts double) plus a part for the lengths; unrelated digests differ by a known mean. Likeness
is 1 - difference / that mean, held to 0..1.

Cases: a null text counts as empty; texts of fewer than three bytes have all buckets in the lowest class and
are told apart by length only; whole texts are counted, long ones in pieces; repeated rows have a row each, with
neighbours in the order below; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialise

BUCKETS = 256
_PIECE = 1 << 20
#: Mean class difference of unrelated digests per bucket: 6/16 by one, 4/16 by two, 2/16 by three, counted 1, 2, 6.
_UNRELATED = BUCKETS * (6 / 16 * 1 + 4 / 16 * 2 + 2 / 16 * 6)
_LENGTH_STEP = 4.0
_COST = np.array([0, 1, 2, 6])


def _counts(data: bytes) -> np.ndarray:
    out = np.zeros(BUCKETS, dtype=np.int64)
    for at in range(0, max(0, len(data) - 2), _PIECE):
        b = np.frombuffer(data, dtype=np.uint8, count=min(_PIECE + 2, len(data) - at), offset=at).astype(np.uint32)
        h = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
        out += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return out


def _length(n: int) -> int:
    return min(255, round(8 * float(np.log2(n + 1))))


def digest(data: bytes) -> str:
    c = _counts(data)
    cuts = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    classes = (c > cuts[0]).astype(np.uint8) + (c > cuts[1]) + (c > cuts[2])
    packed = classes[0::4] | classes[1::4] << 2 | classes[2::4] << 4 | classes[3::4] << 6
    return f"{_length(len(data)):02x}" + packed.astype(np.uint8).tobytes().hex()


def _classes(d: str) -> np.ndarray:
    p = np.frombuffer(bytes.fromhex(d[2:]), dtype=np.uint8)
    return np.stack([p & 3, p >> 2 & 3, p >> 4 & 3, p >> 6], axis=1).ravel()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for those as far apart as unrelated ones or further."""
    if a == b:
        return 1.0
    d = int(_COST[np.abs(_classes(a).astype(np.int8) - _classes(b))].sum())
    d += _LENGTH_STEP * abs(int(a[:2], 16) - int(b[:2], 16))
    return max(0.0, 1.0 - d / _UNRELATED)


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many of the start of ``following`` (or all of it)."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _compared(text: str, own: str, following: str, next_: str) -> tuple:
    e = edited(text, following).encode()
    de = digest(e)
    return len(text), hashlib.sha256(e).hexdigest(), own, de, round(likeness(own, de), 6), round(likeness(own, next_), 6)


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _order(doc: str, text: str):
    """A string that sorts by id from the highest down, null last, then by the text's hash."""
    part = lambda c: F.lpad(F.hex(c), 16, "0")
    down = F.coalesce(F.bitwise_not(F.col(doc).cast("long")).bitwiseXOR(F.lit(-(2**63))), F.lit(0).cast("long"))
    return F.concat(F.when(F.col(doc).isNull(), "1").otherwise("0"), part(down), part(F.xxhash64(F.coalesce(F.col(text), F.lit("")))))


def _splitters(counts: DataFrame, total: int, ranges: int, each: int = 32) -> list[str]:
    """Lower bounds of ranges of equal rows: weighted quantiles of about ``each`` sampled keys a range."""
    rate = min(1.0, ranges * each / max(1, total))
    drawn = counts.where(F.pmod(F.xxhash64(F.lit(17), "key"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).orderBy("key").collect()
    upto = np.cumsum([r["n"] for r in drawn]) if drawn else np.zeros(0)
    at = np.searchsorted(upto, [upto[-1] * i / ranges for i in range(1, ranges)]) if drawn else []
    return sorted({drawn[i]["key"] for i in at})


def _tickets(spark: SparkSession, n: int) -> list[int]:
    """A number for each of ``n`` partitions that Spark's hash deals to it."""
    number = F.col("id").cast("int")
    rows = spark.range(50 * n).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("at")).agg(F.min(number).alias("p")).collect()
    found = {r["at"]: r["p"] for r in rows}
    return [found.get(i, i) for i in range(n)]


def with_neighbours(docs: DataFrame, doc: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """One row (doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) a document.

    The order is by id from the highest down, null ids last, equal ids by their texts' hashes. It is cut into
    ``ranges`` of equal numbers of rows by sampled keys; the first document of each range is sent to the range before
    as well, so one shuffle of the texts is enough and a task streams over its sorted rows. Repeated rows (equal in id
    and text) follow each other. One that has more copies than a range has rows is dealt once: its copies are each
    other's next documents and get that result, without their texts being dealt.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc).cast("string").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"), _order(doc, text).alias("key"))
    counts = materialise(rows.groupBy("key").agg(F.count("*").alias("n")), "fingerprint-keys")
    total = counts.agg(F.sum("n")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], f"`{doc}` {kind}, {_RESULT}")
    hot = [r["key"] for r in counts.where(F.col("n") > max(1, total // ranges)).collect()]  # at most ``ranges``
    bounds = spark.sparkContext.broadcast(np.array(_splitters(counts.where(~F.col("key").isin(hot)) if hot else counts, total, ranges), dtype=object))

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(dtype=object), side="right").astype(np.int32))

    heads = {x["r"]: x["m"] for x in counts.groupBy(range_of("key").alias("r")).agg(F.min("key").alias("m")).collect()}
    used = sorted(heads)
    before = dict(zip(used, [used[-1], *used[:-1]], strict=True))  # the first follows the last
    once = rows
    if hot:
        many = rows.where(F.col("key").isin(hot))
        once = rows.where(~F.col("key").isin(hot)).union(many.groupBy("key").agg(F.first("d").alias("d"), F.first("t").alias("t")).select("d", "t", "key"))
    # by range: its first key, the range before it, its ticket
    ticket = dict(zip(used, _tickets(spark, len(used)), strict=True))
    every = range(used[-1] + 1)
    guide = spark.sparkContext.broadcast((np.array([heads.get(r, "") for r in every], dtype=object), np.array([before.get(r, 0) for r in every]), np.array([ticket.get(r, 0) for r in every])))

    @F.pandas_udf("r int, p int, first boolean, before_r int, before_p int")
    def placed(keys: pd.Series) -> pd.DataFrame:
        first_key, previous, tickets = guide.value
        r = np.searchsorted(bounds.value, keys.to_numpy(dtype=object), side="right")
        return pd.DataFrame({"r": r, "p": tickets[r], "first": first_key[r] == keys.to_numpy(dtype=object), "before_r": previous[r], "before_p": tickets[previous[r]]})

    once = once.withColumn("w", placed("key"))
    own = F.struct(F.col("w.r").alias("r"), F.col("w.p").alias("p"), F.lit(0).alias("extra"))
    ahead = F.struct(F.col("w.before_r").alias("r"), F.col("w.before_p").alias("p"), F.lit(1).alias("extra"))
    dealt = once.withColumn("s", F.explode(F.when(F.col("w.first"), F.array(own, ahead)).otherwise(F.array(own)))).select("d", "t", "key", "s.*")
    dealt = dealt.repartition(len(used), "p").sortWithinPartitions("r", "extra", "key")
    repeated = frozenset(hot)

    def stream(batches):
        held = None  # the document whose next one has not come yet: (r, d, text, digest)
        for x in batches:
            out = []
            for r, extra, d, t, key in zip(x["r"], x["extra"], x["d"], x["t"], x["key"], strict=True):
                own = held[3] if held is not None and held[2] == t else digest(t.encode())
                if held is not None and held[0] == r:
                    out.append(("", held[1], *_compared(held[2], held[3], t, own)))
                if key in repeated and not extra:
                    out.append((key, d, *_compared(t, own, t, own)))
                held = None if extra else (r, d, t, own)
            yield pd.DataFrame(out, columns=["key", "d", *_NAMES])

    got = dealt.select("d", "t", "key", "r", "extra").mapInPandas(stream, f"key string, d string, {_RESULT}")
    if hot:  # all copies but one
        got = materialise(got, "fingerprint-pairs")
        copies = materialise(many.select("key", F.monotonically_increasing_id().alias("i")), "fingerprint-copies")
        first = copies.groupBy("key").agg(F.min("i").alias("i"))  # a row for each of ``hot``
        rest = copies.join(F.broadcast(first), ["key", "i"], "left_anti")
        got = got.where("key = ''").union(rest.select("key").join(F.broadcast(got.where("key <> ''")), "key").select(*got.columns))
    return got.select(F.col("d").cast(kind).alias(doc), *_NAMES)
