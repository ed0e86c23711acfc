"""Runs over a stream are those of the batch operators, whatever the order within the watermark."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from vocalith.operators import series as S
from vocalith.streaming import runs as R

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = 1_700_000_000_000


def speech_of(n, seed):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        out += [rng.random() < 0.6] * rng.choice([1, 2, 5, 9])
    return out[:n]


def test_machine_against_batch_operators(spark):
    rows = [(f"r{k}", i / 10, s) for k in range(6) for i, s in enumerate(speech_of(60, k))] + [("all", i / 10, True) for i in range(9)] + [("none", i / 10, False) for i in range(9)]
    df = spark.createDataFrame(rows, "r string, ts double, speech boolean")
    want = {(r["r"], round(r["start_s"] * 1000), round(r["end_s"] * 1000), r["runs"]) for r in S.merge_runs(S.speech_runs(df, ["r"], "ts", "speech", 0.15), ["r"], 0.35).collect()}
    got = set()
    for rec in {r[0] for r in rows}:
        machine = R.Runs(150, 350)
        own = [(round(ts * 1000), s) for r, ts, s in rows if r == rec]
        for f in own:
            machine.frame(*f)
        machine.close(own[-1][0])
        machine.settle(10**9)
        got |= {(rec, *x) for x in machine.done}
    assert got == want


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    yield
    spark.conf.set(key, before)


def test_stream_is_the_batch(spark, store, tmp_path):
    source, at = str(tmp_path / "in"), lambda ms: datetime.datetime.fromtimestamp((T0 + ms) / 1000, datetime.UTC)
    rows = [(f"r{k}", i * 100, s) for k in range(3) for i, s in enumerate(speech_of(50, k))]
    schema = "r string, ts timestamp, speech boolean"
    rng = random.Random(1)
    # three parts in time, each in any order; then a late row, and rows that move the watermark on
    parts = [[x for x in rows if a <= x[1] < a + 1700] for a in (0, 1700, 3400)]
    late = [("r0", 100, True), ("r1", 0, True)]
    tails = [[("z", 30_000, False)], [("z", 200_000, False), *late], [("z", 400_000, False)]]
    seen = []
    frames = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source + "/*")
    for k, part in enumerate([*parts, *tails]):
        rng.shuffle(part)
        spark.createDataFrame([(r, at(ms), s) for r, ms, s in part], schema).coalesce(1).write.parquet(f"{source}/{k}")
        query = (
            R.merged_runs(frames, "r", "ts", "speech", "2 seconds", 0.15, 0.35, 20.0)
            .writeStream.foreachBatch(lambda df, _: seen.extend(tuple(x) for x in df.collect()))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        assert query.awaitTermination(120)
        time.sleep(0.05)
    df = spark.createDataFrame([(r, ms / 1000, s) for r, ms, s in rows], "r string, ts double, speech boolean")
    batch = S.merge_runs(S.speech_runs(df, ["r"], "ts", "speech", 0.15), ["r"], 0.35)
    want = {(r["r"], round(r["start_s"] * 1000) + T0, round(r["end_s"] * 1000) + T0, r["runs"]) for r in batch.select("r", "start_s", "end_s", F.col("runs")).collect()}
    assert set(seen) == want and len(seen) == len(want) > 5
