"""Filter interaction audit: what each of five quality filters removes, for every order in which they may be applied.

Each document becomes a mask of five bits (bit i: it fails filter i). Under a given order it is removed by the first
filter of that order that it fails, so a table of 32 masks by 120 orders holds every answer; a task looks its masks
up there and counts (part, label, order, step) with ``np.bincount``. A task gives out one array of counts for each part
and order, and the arrays are summed. All other columns follow from the sums: a filter that comes first removes all
that fail it, one that comes last removes those that fail nothing else.

The filters: A under 100 words; B fewer than 80 distinct words in 100; C more than 10 capitals A-Z in 100 code points;
D holds one of # $ % & * |; E equal to the text of a smaller id anywhere in the table.

Cases: a null text counts as empty (and fails A only, or A and E); a null part is the empty string, with those whose part
is empty; a null id is not smaller or greater than any, so such a row neither fails E nor makes others fail; rows
equal in id and text do not make each other fail; a document with several labels has each label that one of them gives;
without labels all losses are 0; an empty table gives no rows; other columns are not read. Copies meet as hashes of
texts in an aggregation with map-side combining and in a join whose large partitions can be split.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, text_of

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
_STEPS = len(FILTERS) + 1  # the last is for what no filter removes
#: Parts that a task keeps counts of at a time; with more it hands out what it has and goes on.
_PARTS = 256
_SPACE = r"[\x20\x09-\x0D]+"


def first_failures() -> np.ndarray:
    """(mask, order) -> step of the first filter that fails, from 0; 5 if none does."""
    at = np.array([[FILTERS.index(x) for x in o] for o in ORDERS])
    fails = (np.arange(1 << len(FILTERS))[:, None, None] >> at[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), len(FILTERS))


def failures(text: Column) -> list[Column]:
    """Whether a text fails A, B, C, D."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n = F.size(words)
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [n < 100, F.size(F.array_distinct(words)) * 100 < n * 80, capitals * 100 > F.length(text) * 10, text.rlike(r"[#$%&*|]")]


def masks(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row (part, mask, label) a document; label: 1 if good, plus 2 if toxic."""
    t = text_of(text)
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failures(F.col("_t")))), F.lit(0))
    rows = docs.select(F.col(doc).alias("_d"), t.alias("_t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    rows = materialise(rows.select("_d", "part", F.unhex(F.sha2("_t", 256)).alias("_h"), bits.cast("int").alias("_bits")), "audit-masks")
    first = rows.groupBy("_h").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last")).where("_first < _last").select("_h", "_first")
    told = labels.where(F.col(doc).isNotNull()).groupBy(F.col(doc).alias("_d"))
    told = told.agg(F.max((F.col("quality") == 1).cast("int")).alias("_good"), F.max((F.col("toxic") == 1).cast("int")).alias("_toxic"))
    # both are written, so that the joins deal both of their sides and can split a hot one
    got = rows.join(materialise(first, "audit-copies"), "_h", "left").join(materialise(told, "audit-labels"), "_d", "left")
    copy = F.when(F.col("_first") < F.col("_d"), 1 << 4).otherwise(0)
    label = F.coalesce(F.col("_good"), F.lit(0)) + F.coalesce(F.col("_toxic"), F.lit(0)) * 2
    return got.select("part", (F.col("_bits") + copy).alias("mask"), label.alias("label"))


_COUNTED = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("n", pa.list_(pa.int64()))])


def _count(batches):
    """Batches (part, mask, label) -> a row (part, order, counts) for each part and order: 6 steps of all, then of good, then of toxic."""
    table, n_orders = first_failures(), len(ORDERS)
    cell = np.arange(n_orders) * _STEPS
    held: dict[str, np.ndarray] = {}

    def given():
        for part, c in held.items():
            # label -> all, good (bit 0), toxic (bit 1)
            sums = np.stack([c.sum(axis=0), c[1] + c[3], c[2] + c[3]], axis=1).reshape(n_orders, -1)
            yield pa.record_batch([pa.array([part] * n_orders), pa.array(ORDERS), pa.array(sums.tolist(), pa.list_(pa.int64()))], schema=_COUNTED)
        held.clear()

    for batch in batches:
        codes = batch.column(0).dictionary_encode()
        names = codes.dictionary.to_pylist()
        mask, label = (batch.column(i).to_numpy() for i in (1, 2))
        # the different (part, label, mask) of the batch, with their numbers, are looked up once each
        key, times = np.unique((codes.indices.to_numpy().astype(np.int64) * 4 + label) * 32 + mask, return_counts=True)
        for i, name in enumerate(names):
            own = key // 128 == i
            at, weight = key[own] % 128, times[own]
            cells = (at // 32)[:, None] * (n_orders * _STEPS) + cell + table[at % 32]
            found = np.bincount(cells.ravel(), np.repeat(weight, n_orders), 4 * n_orders * _STEPS).astype(np.int64)
            if name not in held and len(held) >= _PARTS:
                yield from given()
            held[name] = held.get(name, 0) + found.reshape(4, n_orders, _STEPS)
    yield from given()


def audit(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order and step."""
    counted = masks(docs, labels, doc, text, part).mapInArrow(_count, "part string, filter_order string, n array<long>")
    n = [F.sum(F.get("n", i)).alias(f"n{i}") for i in range(3 * _STEPS)]
    summed = materialise(counted.groupBy("part", "filter_order").agg(*n), "audit-counts")
    every = F.array(*[F.col(f"n{i}") for i in range(_STEPS)])
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    steps = [
        F.struct(
            F.lit(k + 1).alias("step"), (total(every) - total(F.slice(every, 1, k + 1))).alias("kept"),
            F.col(f"n{k}").alias("removed"), F.col(f"n{_STEPS + k}").alias("good_lost"), F.col(f"n{2 * _STEPS + k}").alias("toxic_lost"),
        )
        for k in range(len(FILTERS))
    ]
    rows = summed.select("part", "filter_order", F.explode(F.array(*steps)).alias("s")).select("part", "filter_order", "s.*")
    rows = rows.withColumn("_f", F.substring("filter_order", F.col("step"), F.lit(1)))
    # of each part and filter: what fails it, what fails nothing else, the sum over all orders
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("removed")))
    own = rows.groupBy("part", "_f").agg(at(1).alias("_fails"), at(len(FILTERS)).alias("unique_fails"), F.sum("removed").alias("shapley"))
    got = rows.join(own, ["part", "_f"]).withColumn("redundant", F.col("_fails") - F.col("removed"))
    return got.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
             100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
             coalesce(min(d.doc_id) OVER (PARTITION BY t) < d.doc_id, false) AS e, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
      FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
g AS (SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
             || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS f,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x)
      JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT part, o AS filter_order, k AS step, o[k] AS x,
             coalesce(sum(n) FILTER (WHERE translate(o[1:k], f, '') = o[1:k]), 0) AS kept,
             coalesce(sum(n) FILTER (WHERE contains(f, o[k]) AND translate(o[1:k - 1], f, '') = o[1:k - 1]), 0) AS removed,
             coalesce(sum(n) FILTER (WHERE contains(f, o[k]) AND translate(o[1:k - 1], f, '') <> o[1:k - 1]), 0) AS redundant,
             coalesce(sum(n) FILTER (WHERE f = o[k]), 0) AS unique_fails,
             coalesce(sum(good) FILTER (WHERE contains(f, o[k]) AND translate(o[1:k - 1], f, '') = o[1:k - 1]), 0) AS good_lost,
             coalesce(sum(toxic) FILTER (WHERE contains(f, o[k]) AND translate(o[1:k - 1], f, '') = o[1:k - 1]), 0) AS toxic_lost
      FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS k) GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley FROM s
"""
