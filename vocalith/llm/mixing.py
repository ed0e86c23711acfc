"""Mixing sources to target weights along a time-varying curriculum.

Targets: each source's share of the budget by weight, stopped at ``passes`` times its own size; the excess is
shared anew by weight until no source is above its stop (the water level is found by one ordered pass over the
table of sources). A source's documents are read in hash order, again from the start for a second pass, until
the target is met: the last document is taken in part.

Curriculum: a source's weight over training time t in 0..1 is its schedule, piecewise linear between equally
spaced knots. Its integral, scaled to the target, is the source's cumulative token demand D(t); the document
whose tokens reach from a to b of the source's stream is trained at D^-1((a + b) / 2). Sorting all documents
by that position (range partitions) gives the training order. Column names that begin with _ are reserved.

Cases: null source is a source of its own, after all others; null and empty texts have size 0, are never
taken, and have no position; a source of size 0 has target 0; equal rows get places next to each other in
an order that does not matter. A source with a third of all rows, or an id that many rows share, is spread over ranges
with running sums in each. Sources are ordered in one task: a row per source, not per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, n_words, prefix, row_hash

#: Schedules dealt to the sources in turn: level, falling, rising, early peak (weights at equally spaced knots).
SCHEDULES = ((1.0, 1.0, 1.0), (1.5, 1.0, 0.5), (0.5, 1.0, 1.5), (0.75, 1.5, 0.25))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """Rows (source, source_size) -> with ``rank`` (from 0, null last), ``weight`` and ``target``.

    At the water level x a source gets min(weight * x, passes * size). Sources ordered by passes * size / weight
    stop in that order, so the level is found by trying each as the last that stops.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    order = Window.orderBy(F.col("stop") / F.col("weight"), "rank")
    ranked = ranked.withColumn("stop", F.col("source_size") * F.lit(float(passes)))
    ranked = ranked.withColumns(
        {
            "_budget": F.sum("source_size").over(everything) * F.lit(float(share)),
            "_stopped": F.coalesce(F.sum("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
            "_open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        }
    )
    # the first source, in that order, that the level of its own try leaves open
    got = ranked.withColumn("_try", (F.col("_budget") - F.col("_stopped")) / F.col("_open"))
    fits = F.col("_try") * F.col("weight") <= F.col("stop")
    level = F.min(F.when(fits, F.struct(F.col("stop") / F.col("weight"), "rank", "_try"))).over(everything)["_try"]
    capped = F.least(F.coalesce(level * F.col("weight"), F.col("stop")), F.col("stop"))
    return got.withColumn("target", capped).select("source", "source_size", "rank", "weight", "target")


def _invert(fraction, schedule):
    """t with G(t) = fraction, G the normalised integral of the piecewise linear schedule (array column)."""
    k = F.size(schedule) - 1
    areas = F.transform(F.sequence(F.lit(0), k - 1), lambda i: (F.get(schedule, i) + F.get(schedule, i + 1)) / 2)
    total = F.aggregate(areas, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0).alias("i"), (fraction * total).alias("left"), F.lit(False).alias("done"))
    step = lambda a, x: F.when(a["done"] | (a["left"] <= x) | (a["i"] >= k - 1), F.struct(a["i"].alias("i"), a["left"].alias("left"), F.lit(True).alias("done"))).otherwise(F.struct((a["i"] + 1).alias("i"), (a["left"] - x).alias("left"), F.lit(False).alias("done")))
    at = F.aggregate(areas, start, step)
    lo, hi, y = F.get(schedule, at["i"]), F.get(schedule, at["i"] + 1), at["left"]
    # lo x + (hi - lo) x^2 / 2 = y, in the form without cancellation
    root = F.sqrt(F.greatest(F.lit(0.0), lo * lo + F.lit(2.0) * (hi - lo) * y))
    x = F.when(y <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * y / (lo + root))
    return F.least(F.lit(1.0), (at["i"] + x) / k)


def mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, passes: int = 2, schedules=SCHEDULES, keep: list[str] | None = None) -> DataFrame:
    """Rows: doc, source, size, source_size, target, start (words of its source before it), taken, positions, parts (pass and words).

    ``positions``: one training time for each pass that takes words of the document. ``keep``: more columns.
    """
    # rows that share id and size come in the order of their other columns, so reruns agree; maps have no hash
    told = docs.select(*[F.col(f"`{c}`") for c, kind in docs.dtypes if not c.startswith("_") and "map<" not in kind])
    slim = docs.select(row_hash(told, 6).alias("_tie"), F.col(doc).alias("_doc"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.md5(F.coalesce(F.col(doc).cast("string"), F.lit(""))).alias("_h"), *(keep or []))
    slim = materialise(slim, "mix-sizes")
    aims = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, passes)
    dealt = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in schedules])
    aims = aims.withColumn("schedule", F.element_at(dealt, (F.col("rank") % len(schedules) + 1).cast("int")))
    aims = materialise(aims, "mix-targets").withColumnRenamed("source", "_source")
    placed = prefix(slim, ["source"], [F.col("_h"), F.col("_doc"), F.col("size"), F.col("_tie")], F.col("size"), "start")
    got = placed.join(aims, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_h")
    whole = F.floor(F.col("target") + F.lit(0.5))
    part = lambda p: F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), whole - F.col("source_size") * p) - F.col("start"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(passes - 1)), lambda p: F.struct(p.alias("p"), part(p).alias("n")))
    got = got.withColumn("parts", F.filter(parts, lambda x: x["n"] > 0))
    middle = lambda x: (F.col("source_size") * x["p"] + F.col("start") + x["n"] / F.lit(2.0)) / F.col("target")
    got = got.withColumn("positions", F.transform("parts", lambda x: F.round(_invert(middle(x), F.col("schedule")), 9)))
    got = got.withColumn("taken", F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["n"]))
    return got.select(F.col("_doc").alias(doc), "source", "size", "source_size", F.round("target", 6).alias("target"), "start", "taken", "positions", "parts", *(keep or []))


def apply_mix(docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """``docs`` as the mix takes them: whole documents, once for each pass that takes at least half of their
    words, sorted by training position. Rows that differ in any column are different documents."""
    own = {"_d": row_hash(docs, 3), "_t": row_hash(docs, 4)}
    got = mix(docs.withColumns(own), doc, text, source, keep=["_d", "_t"], **how)
    enough = F.filter(F.arrays_zip("positions", "parts"), lambda x: x["parts"]["n"] * 2 >= F.col("size"))
    got = got.select("_d", "_t", F.transform(enough, lambda x: x["positions"]).alias("_p")).where(F.size("_p") > 0)
    # equal rows: their positions one by one, each to one of them by its number
    got = got.select("_d", "_t", F.explode("_p").alias("_position"))
    # dropping repeats deals the texts by the same keys as the join: one shuffle of them, and one to sort
    taken = docs.withColumns(own).dropDuplicates(["_d", "_t"]).join(got, ["_d", "_t"])
    return taken.orderBy("_position", doc).select(*docs.columns)


def by_position(mixed: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of ``mix`` in training order, what is not taken last: with ``position`` and, of a second pass,
    ``last_position`` (the same where there is one)."""
    got = mixed.withColumns({"position": F.try_element_at("positions", F.lit(1)), "last_position": F.try_element_at("positions", F.lit(-1))})
    return got.orderBy(F.asc_nulls_last("position"), doc)


def _inverse_sql(fraction: str) -> str:
    """``_invert`` for schedules of three knots s0, s1, s2 as SQL."""
    y = f"({fraction}) * ((s0 + s1) / 2 + (s1 + s2) / 2)"
    first, second = "(s0 + s1) / 2", f"({y} - (s0 + s1) / 2)"
    one = f"2 * {y} / (s0 + sqrt(greatest(0, s0 * s0 + 2 * (s1 - s0) * {y})))"
    two = f"1 + 2 * {second} / (s1 + sqrt(greatest(0, s1 * s1 + 2 * (s2 - s1) * {second})))"
    return f"round(least(1.0, (CASE WHEN {y} <= {first} THEN {one} ELSE {two} END) / 2), 9)"


_KNOTS = ", ".join(f"CASE k % {len(SCHEDULES)} " + " ".join(f"WHEN {j} THEN {s[i]}::DOUBLE" for j, s in enumerate(SCHEDULES)) + f" END AS s{i}" for i in range(3))

ORACLE = f"""
WITH s AS (SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM z),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS stop FROM r),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS budget,
             coalesce(sum(stop) OVER (ORDER BY stop / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped,
             sum(weight) OVER (ORDER BY stop / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w),
v AS (SELECT *, (budget - stopped) / open AS level FROM o),
x AS (SELECT level FROM v WHERE level * weight <= stop ORDER BY stop / weight, k LIMIT 1),
t AS (SELECT source, source_size, least(x.level * weight, stop) AS target, {_KNOTS} FROM v, x),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s),
j AS (SELECT p.doc_id, p.size, p.start, t.* EXCLUDE (source), greatest(0, least(start + size, floor(target + 0.5)) - start) AS n0,
             greatest(0, least(start + size, floor(target + 0.5) - source_size) - start) AS n1 FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
i AS (SELECT *, CASE WHEN n0 > 0 THEN {_inverse_sql("(start + n0 / 2.0) / target")} END AS position,
             CASE WHEN n1 > 0 THEN {_inverse_sql("(source_size + start + n1 / 2.0) / target")} END AS later FROM j)
SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(n0 + n1 AS BIGINT) AS taken, position, coalesce(later, position) AS last_position FROM i
"""
