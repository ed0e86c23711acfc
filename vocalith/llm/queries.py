"""The training-data queries: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, collocations, fingerprints, langid, linededup, lm, media, mixing, packing, quality, secrets, sharding, simhash
from .common import table


def fold(of: int):
    """The remainder of the id's CRC-32 that decides who is held out."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    model = langid.fit(docs.where(F.coalesce(fold(4) != 2, F.lit(True))), order=F.xxhash64("doc_id"))
    got = langid.predict(docs.select("doc_id", "text"), model)
    return got.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir), shards=40)
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "range")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir))
    return got.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    every = secrets.all_word_counts(docs)
    counts = secrets.most_frequent(every)
    language = secrets.Language.of(counts, secrets.letter_pairs(every))
    forest = secrets.fit(language, secrets.labelled_findings(list(counts)[:500]))
    return secrets.scan(docs, forest, language)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.by_position(mixing.mix(table(spark, sf_dir)))
    return got.select("doc_id", "size", "source_size", "target", "taken", "position", "last_position")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir), tokenizer_path(), F.coalesce(fold(7) == 2, F.lit(False)))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = media.media_columns(table(spark, sf_dir))
    return got.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir), tokenizer_path()))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_neighbours(table(spark, sf_dir))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir).select("doc_id", "text")
    got = quality.classify(docs, table(spark, sf_dir, "labels"), learn_from=fold(3) != 1, keep=["doc_id"])
    return got.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir), table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


OPERATORS = (
    op1_language_id, op2_line_dedup, op3_sharding, op4_simhash, op5_secret_scan, op6_mixing, op7_lm_scoring, op8_media, op9_packing,
    op10_fingerprints, op11_quality, op12_collocations, op13_filter_audit,
)
QUERIES = {f.__name__: f for f in OPERATORS}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": linededup.ORACLE, "op6_mixing": mixing.ORACLE, "op12_collocations": collocations.ORACLE, "op13_filter_audit": audit.ORACLE}
