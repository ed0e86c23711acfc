"""Shared plumbing of the training-data operators: shared storage, bounded Arrow batches, running sums over ranges."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of a text: runs of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local session may lack it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vocalith-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, so a lost executor costs a re-read only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, rows: int = 2048, size: str = "16m") -> None:
    """Arrow batches to Python stay small even where single texts are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """Larger Arrow batches for an action on narrow rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Return freed memory to the system. Workers live on from stage to stage, so what one stage has needed would
    otherwise count against the memory of all later ones."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns, never null; a null differs from every value, in whichever column it stands."""
    every = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(F.lit(seed), *every)


def text_of(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words (see WORD), 0 for null."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def prefix(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` per ``keys`` in the order ``order``, as column ``out``; ties in any order.

    The rows are dealt by ranges of keys, order and a number of their own, so neither a key with a third of all rows
    nor one with many rows alike in ``order`` stays on one task. A running sum inside each range and key, plus the
    sums of the key's earlier ranges. The dealt rows are written, so the ranges hold for both.
    """
    dealt = df.withColumns({"_v": value, "_own": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(*[F.col(k) for k in keys], *order, F.col("_own")).withColumn("_part", F.spark_partition_id())
    dealt = materialise(dealt, "prefix")
    inner = Window.partitionBy("_part", *keys).orderBy(*order, "_own").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_local", F.coalesce(F.sum("_v").over(inner), F.lit(0)))
    names = [f"_k{i}" for i in range(len(keys))]
    base = dealt.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_part").alias("_b")).agg(F.sum("_v").alias("_s"))
    over = Window.partitionBy(*names).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("_before", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)] + [F.col("_part") == F.col("_b")]
    return local.join(base, on).withColumn(out, F.col("_local") + F.col("_before")).drop("_v", "_own", "_part", "_local", "_before", "_b", *names)
