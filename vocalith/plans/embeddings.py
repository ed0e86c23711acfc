"""Queries over speaker embeddings: ten vectors in a row are the segments of a recording, label is the speaker.

Pairs come from a table of pairs of recordings (here each recording with the next one), never from all against all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.numbers import t_values
from ..operators import aggregates as A
from ..operators import recordings as C
from ..operators import rules as R
from ..operators import similarity as S
from .registry import query

#: Segments of a recording, and how many of them the verdict compares.
SEGMENTS, COMPARED = 10, 5

SEG = f"""s AS (SELECT vec_id // {SEGMENTS} AS rec, label, vec_id,
    row_number() OVER (PARTITION BY vec_id // {SEGMENTS} ORDER BY vec_id) AS rn, embedding::DOUBLE[] AS v FROM embeddings)"""
DOT = "list_inner_product({a}, {b})"


def cos(a: str, b: str) -> str:
    aa, bb, ab = DOT.format(a=a, b=a), DOT.format(a=b, b=b), DOT.format(a=a, b=b)
    return f"CASE WHEN {aa} = 0 OR {bb} = 0 THEN 0.0 ELSE {ab} / (sqrt({aa}) * sqrt({bb})) END"


def euclid(a: str, b: str, scale: str = "1.0") -> str:
    return f"1.0 / (1.0 + list_distance({a}, {b}) / {scale})"


def segments(t, per: int | None = None) -> DataFrame:
    rec = F.floor(F.col("vec_id") / SEGMENTS).cast("long").alias("rec")
    e = t("embeddings").select(rec, "label", "vec_id", V.as_double(F.col("embedding")).alias("v"))
    return S.ranked(e, ["rec"], [F.col("vec_id")], per)


def recording_pairs(t, per: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of every pair (pair_id: the first recording; the next one is the second)."""
    s = segments(t, per).select("rec", F.col("rn").alias("seq"), "v")
    recs = t("embeddings").select(F.floor(F.col("vec_id") / SEGMENTS).cast("long").alias("rec")).distinct()
    pairs = recs.join(recs.select((F.col("rec") - 1).alias("rec")), "rec").withColumnRenamed("rec", "pair_id")
    a = s.withColumnRenamed("rec", "pair_id").join(pairs, "pair_id", "left_semi")
    b = s.withColumn("pair_id", F.col("rec") - 1).drop("rec").join(pairs, "pair_id", "left_semi")
    return a, b


def pairs_sql(per: int | None = None) -> str:
    some = f" WHERE a.rn <= {per} AND b.rn <= {per}" if per else ""
    return f"""WITH {SEG}, p AS (SELECT a.rec AS pair_id, a.rn AS i, b.rn AS j, a.v AS va, b.v AS vb
    FROM s a JOIN s b ON b.rec = a.rec + 1{some}), c AS (SELECT *, {cos('va', 'vb')} AS sim FROM p)"""


STATS = """SELECT pair_id, avg(sim) AS mean, median(sim) AS median, max(sim) AS max, min(sim) AS min,
    stddev_pop(sim) AS std, count(*) AS n FROM c GROUP BY pair_id"""


@query(
    pairs_sql(COMPARED)
    + f""", st AS ({STATS}), x AS (SELECT pair_id, stddev_samp(sim) AS s FROM c GROUP BY pair_id),
t(df, t) AS (VALUES {t_values(COMPARED * COMPARED)})
SELECT st.pair_id, n, median, mean, std AS consistency, 1.0 / (1.0 + exp(-12.0 * (median - 0.5))) AS probability,
CASE WHEN n < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, mean - t * s / sqrt(n))) END AS ci_lo,
CASE WHEN n < 2 THEN 1.0 ELSE greatest(0.0, least(1.0, mean + t * s / sqrt(n))) END AS ci_hi,
CASE WHEN median >= 0.95 AND std < 0.10 THEN 'very_high' WHEN median >= 0.88 AND std < 0.12 THEN 'high'
WHEN median >= 0.80 AND std < 0.15 THEN 'probable' WHEN median >= 0.70 THEN 'similar' ELSE 'different' END AS verdict_code
FROM st JOIN x ON st.pair_id = x.pair_id LEFT JOIN t ON t.df = n - 1""",
    "median mean consistency probability ci_lo ci_hi",
)
def speaker_pair_verdict(spark, t):
    a, b = recording_pairs(t, COMPARED)
    sims = S.all_pairs(a, b, ["pair_id"])
    stats = S.pair_stats(sims, ["pair_id"])
    ci = A.confidence_interval(sims, ["pair_id"], "sim").drop("n")
    code = R.verdict(F.col("median"), F.col("std")).alias("verdict_code")
    probability = V.calibrated(F.col("median")).alias("probability")
    return stats.join(ci, "pair_id").select("pair_id", "n", "median", "mean", F.col("std").alias("consistency"), probability, "ci_lo", "ci_hi", code)


@query(pairs_sql(COMPARED) + " SELECT pair_id, i AS rn, sim FROM c WHERE i = j", "sim")
def zip_join_similarity(spark, t):
    a, b = (x.withColumnRenamed("seq", "rn") for x in recording_pairs(t, COMPARED))
    z = S.zip_join(a, b, ["pair_id"])
    return z.select("pair_id", F.col("rn").cast("long").alias("rn"), V.cosine(F.col("va"), F.col("vb")).alias("sim"))


@query(pairs_sql() + " " + STATS, "mean median max min std")
def all_pairs_stats(spark, t):
    a, b = recording_pairs(t)
    return S.pair_stats(S.all_pairs(a, b, ["pair_id"]), ["pair_id"])


@query(
    pairs_sql() + " SELECT pair_id, 'ecapa' AS metric, i AS seg_no, sim AS score FROM c WHERE i = j UNION ALL SELECT pair_id, 'res', i, sim FROM c WHERE i = j",
    "score",
)
def segment_similarities(spark, t):
    a, b = (x.select("pair_id", F.col("seq").alias("rn"), F.col("v").alias("ecapa"), (F.transform("v", lambda x: x * 2)).alias("res")) for x in recording_pairs(t))
    return C.segment_similarities(a, b, models=("ecapa", "res")).withColumn("seg_no", F.col("seg_no").cast("long"))


#: Each vector with the first one of its speaker.
AGAINST = f"WITH {SEG}, f AS (SELECT label, first(v ORDER BY vec_id) AS w FROM s GROUP BY label), p AS (SELECT s.vec_id, s.v, f.w FROM s JOIN f ON s.label = f.label)"


def against_first(t) -> DataFrame:
    s = segments(t)
    first = s.groupBy("label").agg(F.min_by("v", "vec_id").alias("vb"))
    return s.join(first, "label")


@query(
    f"""{AGAINST}, c AS (SELECT vec_id, {cos('v', 'w')} AS c, {euclid('v', 'w')} AS e FROM p)
SELECT vec_id, c AS cosine, e AS euclid, 1 / (1 + exp(-12 * (c - 0.5))) AS p_ecapa, 1 / (1 + exp(-10 * (c - 0.5))) AS p_xvec,
2 * abs(1 / (1 + exp(-12 * (c - 0.5))) - 0.5) AS confidence, 1 / (1 + exp(-12 * (c - 0.5))) >= 0.5 AS same_speaker,
2 * abs(1 / (1 + exp(-12 * (c - 0.5))) - 0.5) >= 0.85 AS reliable, 10 * c AS llr FROM c""",
    "cosine euclid p_ecapa p_xvec confidence llr",
)
def calibrated_probability(spark, t):
    v, w = F.col("v"), F.col("vb")
    out = against_first(t).select("vec_id", V.cosine(v, w).alias("cosine"), V.euclid_similarity(v, w).alias("euclid"))
    p = V.calibrated(F.col("cosine"))
    return out.select(
        "*", p.alias("p_ecapa"), V.calibrated(F.col("cosine"), "xvec").alias("p_xvec"), V.confidence(p).alias("confidence"),
        (p >= V.SAME_SPEAKER_PROBABILITY).alias("same_speaker"), (V.confidence(p) >= V.RELIABLE_CONFIDENCE).alias("reliable"), S.plda_score(F.col("cosine"))[1].alias("llr"),
    )


@query(
    f"""{AGAINST}, u AS (SELECT vec_id, unnest(v) AS x, unnest(w) AS y FROM p), r AS (SELECT vec_id, corr(x, y) AS r FROM u GROUP BY vec_id),
c AS (SELECT p.vec_id, {cos('v', 'w')} AS c, {euclid('v', 'w')} AS e, r FROM p JOIN r ON p.vec_id = r.vec_id)
SELECT vec_id, c AS cosine, e AS euclid, r AS correlation, 1 / (1 + exp(-10 * (c - 0.5))) AS probability, 2 * abs(1 / (1 + exp(-10 * (c - 0.5))) - 0.5) AS confidence,
c >= 0.75 AS same_speaker, 2 * abs(1 / (1 + exp(-10 * (c - 0.5))) - 0.5) >= 0.85 AS reliable FROM c""",
    "cosine euclid correlation probability confidence",
)
def pair_bundle(spark, t):
    return against_first(t).select("vec_id", *S.compare_pair(F.col("v"), F.col("vb"), "res"))


@query(f"{AGAINST}, u AS (SELECT vec_id, unnest(v) AS x, unnest(w) AS y FROM p) SELECT vec_id, corr(x, y) AS correlation FROM u GROUP BY vec_id", "correlation")
def vector_correlation(spark, t):
    return against_first(t).select("vec_id", V.pearson(F.col("v"), F.col("vb")).alias("correlation"))


@query(f"{AGAINST} SELECT vec_id, {euclid('v', 'w')} AS sim, {euclid('v', 'w', '10.0')} AS sim10 FROM p", "sim sim10")
def euclid_similarity(spark, t):
    v, w = F.col("v"), F.col("vb")
    return against_first(t).select("vec_id", V.euclid_similarity(v, w).alias("sim"), V.euclid_similarity(v, w, 10.0).alias("sim10"))


MEAN = """m AS (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(0, len(embedding))) AS pos
    FROM embeddings) GROUP BY label, pos)"""


@query(f"WITH {MEAN} SELECT label, CAST(pos AS INTEGER) AS pos, x FROM m", "x")
def mean_embedding(spark, t):
    m = S.mean_vector(t("embeddings").withColumnRenamed("embedding", "v"), ["label"])
    return m.select("label", F.posexplode("v").alias("pos", "x"))


@query(
    f"""WITH {MEAN}, w AS (SELECT label, list(x ORDER BY pos) AS w FROM m GROUP BY label),
c AS (SELECT e.label, {cos('e.embedding::DOUBLE[]', 'w.w')} AS sim FROM embeddings e JOIN w ON e.label = w.label)
SELECT label, CASE WHEN count(*) < 2 THEN 1.0 ELSE avg(sim) END AS stability,
CASE WHEN count(*) < 2 THEN 1.0 ELSE 1.0 - least(1.0, 5.0 * stddev_pop(sim)) END AS consistency, count(*) AS parts FROM c GROUP BY label""",
    "stability consistency",
)
def temporal_stability(spark, t):
    e = t("embeddings").withColumnRenamed("embedding", "v")
    return S.temporal_stability(e, S.mean_vector(e, ["label"]), ["label"])


@query(
    f"""{pairs_sql()}, u AS (SELECT pair_id, i, j, corr(x, y) AS r FROM (SELECT pair_id, i, j, unnest(va) AS x, unnest(vb) AS y FROM p) GROUP BY pair_id, i, j),
q AS (SELECT pair_id, max(sim) AS max_cosine FROM c GROUP BY pair_id), k AS (SELECT pair_id, avg(r) AS mean_correlation FROM u GROUP BY pair_id),
e AS (SELECT rec, list(x ORDER BY pos) AS v FROM (SELECT rec, pos, avg(x) AS x FROM (SELECT rec, unnest(v) AS x, unnest(range(0, len(v))) AS pos FROM s) GROUP BY rec, pos) GROUP BY rec)
SELECT q.pair_id, {cos('ea.v', 'eb.v')} AS mean_cosine, max_cosine, mean_correlation
FROM q JOIN k ON q.pair_id = k.pair_id JOIN e ea ON ea.rec = q.pair_id JOIN e eb ON eb.rec = q.pair_id + 1""",
    "mean_cosine max_cosine mean_correlation",
)
def sound_event_sets(spark, t):
    a, b = recording_pairs(t)
    return S.sound_event_comparison(a, b, ["pair_id"])


@query(f"WITH {SEG} SELECT vec_id, list_sum(list_transform(v, lambda x: abs(x))) / sqrt(list_inner_product(v, v)) AS l1, 1.0 AS l2 FROM s", "l1 l2")
def normalized_vectors(spark, t):
    n = segments(t).select("vec_id", V.l2_normalize(F.col("v")).alias("v"))
    return n.select("vec_id", V.total(F.transform("v", lambda x: F.abs(x))).alias("l1"), V.norm(F.col("v")).alias("l2"))
