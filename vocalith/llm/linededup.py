"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed (two chained 64-bit hashes). A window hash that occurs at more
than one place keeps its first place, in the order (doc_id, line, hash of the text); the positions that the later windows cover
are merged and those lines go. A line that goes always has an equal line, earlier in that order, that stays.

Cases: windows of blank lines only do not count; a text of fewer than three lines has no window and stays; a
null text stays null and a null doc_id sorts first; a text whose lines all go becomes empty; rows that agree
in doc_id and text are one document to the order, so they lose the same lines. A window found in a third of all
rows meets in an aggregation with map-side combining and in a join whose large partitions can be split; the
covered positions of one document are bounded by its own lines. Other columns are carried along, but
for n_lines and n_removed, which are replaced; names that begin with _ are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

WINDOW = 3


def repeated_windows(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Later occurrences of repeated windows: one row (_doc, _text, line) each; _text is the text's hash."""
    lines = F.split(F.col(text), "\n")
    at = F.sequence(F.lit(0), F.size("_lines") - window)
    part = lambda i: F.slice("_lines", i + 1, window)
    hashed = F.transform(at, lambda i: F.struct(i.alias("line"), F.xxhash64(part(i)).alias("h1"), F.xxhash64(F.lit(17), part(i)).alias("h2"), F.length(F.trim(F.array_join(part(i), ""))).alias("n")))
    rows = docs.select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("_text"), lines.alias("_lines")).where(F.size("_lines") >= window)
    rows = rows.select("_doc", "_text", F.explode(F.filter(hashed, lambda x: x["n"] > 0)).alias("w")).select("_doc", "_text", "w.line", "w.h1", "w.h2")
    place = F.struct("_doc", "line", "_text")
    first = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("h1", "h2", "first")
    first = materialise(first, "line-windows")
    return rows.join(first, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("_doc", "_text", "line")


def dedup_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated lines gone from ``text``, and the counts n_lines and n_removed."""
    covered = repeated_windows(docs, doc, text, window).groupBy("_doc", "_text").agg(F.collect_set("line").alias("_starts"))
    covered = covered.withColumnsRenamed({"_doc": "_d", "_text": "_t"})
    on = F.col(doc).eqNullSafe(F.col("_d")) & (F.xxhash64(text) == F.col("_t"))
    got = docs.join(covered, on, "left").withColumn("_lines", F.split(F.col(text), "\n"))
    gone = F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + (window - 1)))))
    # a map gives each line its answer in constant time, however many lines a text has
    got = got.withColumn("_gone", F.when(F.col("_starts").isNotNull(), F.map_from_arrays(gone, F.transform(gone, lambda _: F.lit(True)))))
    numbered = F.transform("_lines", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    kept = F.array_join(F.transform(F.filter(numbered, lambda p: F.try_element_at("_gone", p["i"]).isNull()), lambda p: p["x"]), "\n")
    n = F.when(F.col(text).isNull(), 0).otherwise(F.size("_lines")).cast("long")
    got = got.withColumns({"n_lines": n, "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long"), text: F.when(F.col("_starts").isNull(), F.col(text)).otherwise(kept)})
    return got.select(*[c for c in docs.columns if c not in ("n_lines", "n_removed")], "n_lines", "n_removed")


ORACLE = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, text, CAST(i AS INTEGER) AS line, ls[i + 1] AS a, ls[i + 2] AS b, ls[i + 3] AS c
      FROM (SELECT doc_id, text, ls, unnest(range(0, len(ls) - 2)) AS i FROM l WHERE len(ls) >= 3)),
f AS (SELECT doc_id, text, line, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, line) AS k
      FROM w WHERE length(trim(a || b || c)) > 0),
g AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest([line, line + 1, line + 2]) AS p FROM f WHERE k > 1)),
e AS (SELECT doc_id, unnest(ls) AS x, unnest(range(0, len(ls))) AS i FROM l),
s AS (SELECT e.doc_id, coalesce(string_agg(CASE WHEN g.p IS NULL THEN x END, chr(10) ORDER BY i), '') AS text,
             count(*) AS n_lines, count(g.p) AS n_removed
      FROM e LEFT JOIN g ON e.doc_id = g.doc_id AND e.i = g.p GROUP BY e.doc_id)
SELECT d.doc_id, s.text, coalesce(s.n_lines, 0) AS n_lines, coalesce(s.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id
"""
