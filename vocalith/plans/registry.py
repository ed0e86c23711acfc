"""Registry of named queries, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Both engines round to this many digits, as sums differ in the last ones. What the order of a sum leaves is rounded
#: away first, and a step far below the digits kept takes exact decimals off the tie.
DIGITS, FIRST, STEP = 6, 9, 1e-10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.round(F.col(c), FIRST) + F.lit(STEP), DIGITS) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


def query(sql: str | None, floats: str = ""):
    """Register under the function's name. ``floats``: the double columns of the result."""

    def register(f):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, lambda name: table(spark, sf_dir, name)))

        QUERIES[f.__name__] = run
        if sql:
            marks = ", ".join(f"round(round({c}::DOUBLE, {FIRST}) + {STEP}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in floats.split())
            ORACLES[f.__name__] = f"SELECT * REPLACE ({marks}) FROM ({sql}) AS q" if marks else sql
        return run

    return register
