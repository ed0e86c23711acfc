"""Windows over event time. Give ``late`` for a streaming table: it sets the watermark that bounds the state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marked(df: DataFrame, ts: str, late: str | None) -> DataFrame:
    return df.withWatermark(ts, late) if late else df


def tumbling(df: DataFrame, by: list[str], ts: str, size: str, aggs: list[Column], late: str | None = None) -> DataFrame:
    return _marked(df, ts, late).groupBy(*by, F.window(ts, size).alias("w")).agg(*aggs).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[F.col(_name(a)) for a in aggs])


def sliding(df: DataFrame, by: list[str], ts: str, size: str, hop: str, aggs: list[Column], late: str | None = None) -> DataFrame:
    return _marked(df, ts, late).groupBy(*by, F.window(ts, size, hop).alias("w")).agg(*aggs).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[F.col(_name(a)) for a in aggs])


def sessions(df: DataFrame, by: list[str], ts: str, gap: str, aggs: list[Column], late: str | None = None) -> DataFrame:
    """Runs of rows not further apart than ``gap``; a gap of exactly that size is bridged."""
    out = _marked(df, ts, late).groupBy(*by, F.session_window(ts, gap).alias("w")).agg(F.max(ts).alias("last"), *aggs)
    return out.select(*by, F.col("w.start").alias("start"), "last", *[F.col(_name(a)) for a in aggs])


def _name(c: Column) -> str:
    """The alias of an aggregate."""
    return str(c).rsplit(" AS ", 1)[-1].removesuffix("'>").strip("`")
