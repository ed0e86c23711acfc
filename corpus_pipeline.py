"""A corpus pipeline over ``documents``: five stages, each written as Parquet and read again by the next.

Language ID rejects what has no letter or is in no learned language, by the share of its trigrams that the best
language knows (``fits`` of langid.predict: a score is never under 1 / languages); line dedup takes out repeated passages, and documents
that consist of nothing else; SimHash keeps one document of each group of near-duplicates (a Jaccard
similarity of five-word shingles of 0.8 or more, checked on the whole sets); mixing brings the sources to their target weights, in training
order; packing fills sequences of 1024 tokens. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocalith.llm import langid, linededup, mixing, packing, queries, simhash
from vocalith.llm.common import materialise, table

def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = langid.predict(docs, langid.fit(docs), out=("_lang", "_score"), fits="_fits")
    return got.where((F.col("_lang") != langid.UND) & F.col("_fits")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    got = linededup.dedup_lines(docs).where(F.col("text").isNull() | (F.col("n_removed") < F.col("n_lines")))
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(docs, queries.tokenizer_path()))


STAGES = [(f.__name__, f) for f in (language_id, line_dedup, simhash_near_dedup, mix_sources, pack)]

#: Stages 1, 3 and 5 are beyond SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
