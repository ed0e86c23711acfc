"""The data source: partitions, pushed conditions, and writes that leave whole results or none."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

from vocalith.sources import audio, wav_source

from .test_flac import encode, music


@pytest.fixture(scope="module")
def source(spark):
    wav_source.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark


def tone(n):
    return 0.5 * np.sin(np.arange(n) / 9)


@pytest.fixture
def folder(tmp_path):
    for i in range(6):
        (tmp_path / f"r{i}.wav").write_bytes(audio.encode_wav(tone(1000 * (i + 1))))
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "f.flac").write_bytes(encode(music(4096)))
    (tmp_path / "bad.wav").write_bytes(b"RIFF nothing")
    (tmp_path / "song.mp3").write_bytes(b"x")
    (tmp_path / "notes.txt").write_bytes(b"x")
    return str(tmp_path)


def test_reading(source, folder):
    got = {os.path.basename(r["path"]): r for r in source.read.format("recordings").load(folder).collect()}
    assert set(got) == {*(f"r{i}.wav" for i in range(6)), "f.flac", "bad.wav", "song.mp3"}
    assert np.allclose(got["r2.wav"]["amp"], tone(3000), atol=1e-4) and (got["r2.wav"]["frames"], got["r2.wav"]["sr"]) == (3000, 16000)
    assert np.allclose(got["f.flac"]["amp"], music(4096)[:, 0] / 32768)
    assert (got["bad.wav"]["status"], got["song.mp3"]["status"]) == ("corrupt", "unsupported")
    assert source.read.format("recordings").load(f"{folder}/r1.wav").count() == 1
    assert source.read.format("recordings").load(f"file://{folder}/deep").count() == 1


def test_partitions_are_bounded_by_size(source, folder):
    parts = wav_source.Reader({"path": folder, "partition_bytes": "6000"}).partitions()
    assert len(parts) > 4 and all(len(p.files) == 1 or sum(n for _, n in p.files) <= 6000 for p in parts)
    assert sorted(f for p in parts for f in p.files) == wav_source.Reader({"path": folder}).listed()
    assert source.read.format("recordings").option("partition_bytes", "6000").load(folder).rdd.getNumPartitions() == len(parts)


def test_conditions_reach_the_listing(source, folder):
    r = wav_source.Reader({"path": folder})
    rest = list(r.pushFilters([EqualTo(("sr",), 16000), GreaterThan(("length",), 5000), StringEndsWith(("path",), ".wav")]))
    assert rest == [EqualTo(("sr",), 16000)] and [os.path.basename(p) for p, _ in r.listed()] == ["r2.wav", "r3.wav", "r4.wav", "r5.wav"]
    df = source.read.format("recordings").load(folder).where(F.col("path").endswith("r4.wav") & (F.col("length") > 100) & (F.col("status") == "ok"))
    assert [r["frames"] for r in df.select("frames").collect()] == [5000]


def rows(source, n, fail=None):
    @F.udf("array<double>")
    def samples(i):
        if i == fail:
            raise RuntimeError("this one fails")
        return tone(100 * (i + 1)).tolist()

    return source.range(n, numPartitions=4).select(F.format_string("rec%d", "id").alias("name"), samples("id").alias("amp"))


def test_writing(source, tmp_path):
    out = str(tmp_path / "out")
    rows(source, 8).write.format("recordings").mode("append").save(out)
    got = {os.path.basename(r["path"]): r["frames"] for r in source.read.format("recordings").load(out).collect()}
    assert got == {f"rec{i}.wav": 100 * (i + 1) for i in range(8)} and "_staging" not in os.listdir(out)
    rows(source, 2).write.format("recordings").mode("overwrite").save(out)
    assert sorted(os.listdir(out)) == ["rec0.wav", "rec1.wav"]


def test_a_failed_job_leaves_nothing(source, tmp_path):
    out = str(tmp_path / "out")
    rows(source, 3).write.format("recordings").mode("append").save(out)
    before = {f: os.path.getmtime(f"{out}/{f}") for f in os.listdir(out)}
    with pytest.raises(Exception, match="this one fails"):
        rows(source, 8, fail=6).write.format("recordings").mode("overwrite").save(out)
    assert {f: os.path.getmtime(f"{out}/{f}") for f in os.listdir(out)} == before


def test_equal_names_are_refused(source, tmp_path):
    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="name that another has"):
        rows(source, 4).withColumn("name", F.lit("same")).write.format("recordings").mode("append").save(out)
    assert not os.path.exists(out) or os.listdir(out) == []
