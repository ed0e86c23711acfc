"""Sharding by sampled splitters.

Every record has a sort key: the hash of its text, then the hash of its id. A size-weighted sample of keys
(each record is drawn with probability proportional to its bytes) gives quantile boundaries of many narrow
ranges; records are range-partitioned, exact sizes per range are counted, and ranges that are still overfull
are subdivided by a second, denser sample of those alone. Shards are runs of neighbouring ranges whose exact
bytes come nearest to equal shares, so the law is ``bytes``.

Equal texts share the first part of the key. A boundary never cuts such a group unless the group alone fills a
range; then it is split by the other part, so a group of copies with a third of all rows spreads over many
ranges and tasks. Keys that alone fill a range, as copies with one id do, get a third part. The ranges of one group go to one shard, unless the group has more
than a whole share. Only splitters and per-range counts (``shards * ranges`` rows) come to the driver.

Cases: a null text counts as empty; an empty table gives an empty result; rows that agree in every column
get places next to each other, in an order that does not matter; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of


def _key(text: str, doc: str):
    part = lambda c: F.lpad(F.hex(c), 16, "0")
    return F.concat(part(F.xxhash64(text_of(text))), part(F.xxhash64(F.lit(7), F.col(doc))))


def _told_apart(slim: DataFrame, ranges: int) -> DataFrame:
    """Keys of more rows than one of ``ranges`` equal parts has, at most ``ranges`` of them, get the row's own number."""
    most = slim.count() // ranges
    hot = [r[0] for r in slim.groupBy("_key").agg(F.count("*").alias("n")).where(F.col("n") > max(1, most)).select("_key").collect()]
    own = F.when(F.col("_key").isin(hot), F.lpad(F.hex(F.xxhash64(F.lit(13), "_own")), 16, "0")).otherwise("") if hot else F.lit("")
    return slim.withColumn("_key", F.concat("_key", own)).drop("_own")


def _sample(df: DataFrame, total: int, wanted: int) -> list[str]:
    """Keys of a sample weighted by size; drawn by a hash of the key, so reruns agree."""
    rate = F.lit(float(wanted)) * F.col("size") / F.lit(float(max(1, total)))
    u = (F.pmod(F.xxhash64(F.lit(11), "_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))).cast("double")
    return [r[0] for r in df.where(u < rate).select("_key").orderBy("_key").collect()]


def _quantiles(keys: list[str], ranges: int) -> list[str]:
    """Lower bounds of ranges. A group of equal texts is cut only where it alone spans a whole range."""
    picked = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    heads = pd.Series([k[:16] for k in picked], dtype=object)
    heavy = set(heads[heads.duplicated()])
    out = {k if k[:16] in heavy else k[:16] for k in picked}
    for h in heavy:  # the group's own edges
        out |= {h, f"{int(h, 16) + 1:016x}".upper() if int(h, 16) < 2**64 - 1 else h}
    return sorted(out)


def _with_range(df: DataFrame, splitters: list[str]) -> DataFrame:
    bounds = df.sparkSession.sparkContext.broadcast(np.array(splitters, dtype=object))

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds.value, keys.to_numpy(dtype=object), side="right").astype(np.int32))

    return df.withColumn("_range", place("_key"))


def shard(docs: DataFrame, shards: int = 40, doc: str = "doc_id", text: str = "text", size=None, ranges: int = 48, sample: int = 24) -> DataFrame:
    """Add ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard) to the slim rows.

    ``ranges``: ranges a shard is made of; ``sample``: sampled keys for each range. Returns doc, size,
    text_crc32, shard, slot, range.
    """
    size = (F.octet_length(text_of(text)) + 16).cast("long") if size is None else size
    slim = materialise(docs.select(F.col(doc).alias("_doc"), size.alias("size"), F.crc32(text_of(text)).alias("text_crc32"), _key(text, doc).alias("_key"), F.monotonically_increasing_id().alias("_own")), "shard-keys")
    slim = _told_apart(slim, shards * ranges)
    total = slim.agg(F.sum("size")).first()[0] or 0
    splitters = _quantiles(_sample(slim, total, shards * ranges * sample), shards * ranges)
    placed = _with_range(slim, splitters)
    counted = {r["_range"]: (r["b"], r["n"]) for r in placed.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    full = [k for k, (b, n) in counted.items() if n > 1 and b > 2 * total / (shards * ranges)]
    if full:  # subdivide the overfull ranges from a sample of theirs alone
        inside = placed.where(F.col("_range").isin(full))
        within = sum(counted[k][0] for k in full)
        parts = max(2, round(within * shards * ranges / total))
        splitters = sorted({*splitters, *_quantiles(_sample(inside, within, parts * sample * 2), 2 * parts)})
        placed = _with_range(slim, splitters)
        counted = {r["_range"]: (r["b"], r["n"]) for r in placed.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    home = _assign(counted, shards, splitters)
    base = docs.sparkSession.createDataFrame([(k, s, n) for k, (s, n) in sorted(home.items())] or [(0, 0, 0)], "_r int, shard int, _base long")
    order = Window.partitionBy("_range").orderBy("_key", "_doc", "size")
    got = placed.withColumn("_n", F.row_number().over(order)).join(F.broadcast(base), F.col("_range") == F.col("_r"))
    return got.select(F.col("_doc").alias(doc), "size", "text_crc32", "shard", (F.col("_base") + F.col("_n") - 1).alias("slot"), F.col("_range").alias("range"))


def _assign(counted: dict[int, tuple[int, int]], shards: int, splitters: list[str], large: float = 0.1) -> dict[int, tuple[int, int]]:
    """Shard and first slot of every range: cut where the exact running bytes come nearest to equal shares.

    The ranges of one group of equal texts move together unless the group has over a shard's share. Groups of more
    than ``large`` of a share are placed first, the largest on the emptiest shard; all other ranges fill, in order of
    their keys, what the shards have left.
    """
    total, home, slots = sum(b for b, _ in counted.values()), {}, [0] * shards
    share = total / shards
    units: list[list[int]] = []
    for k in sorted(counted):
        head = splitters[k - 1][:16] if k else ""
        if units and (splitters[units[-1][0] - 1][:16] if units[-1][0] else "") == head:
            units[-1].append(k)
        else:
            units.append([k])
    weight = lambda part: sum(counted[k][0] for k in part)
    load, chosen, small = np.zeros(shards), {}, []
    for unit in sorted(units, key=lambda u: (-weight(u), u)):
        size, s = weight(unit), int(load.argmin())
        if large * share < size <= share and load[s] + size <= 1.02 * share:
            load[s] += size
            chosen |= dict.fromkeys(unit, s)
        else:
            small += [unit] if size <= share else [[k] for k in unit]
    room = np.cumsum(np.maximum(share - load, 0.0))
    done, scale = 0.0, room[-1] / max(1, sum(map(weight, small)))
    for part in sorted(small):
        size = weight(part) * scale
        chosen |= dict.fromkeys(part, min(shards - 1, int(np.searchsorted(room, done + size / 2, side="right"))))
        done += size
    for k in sorted(counted):
        home[k] = (chosen[k], slots[chosen[k]])
        slots[chosen[k]] += counted[k][1]
    return home
