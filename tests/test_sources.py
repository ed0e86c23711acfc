"""Readers, guards and reports."""

import json

import numpy as np
from pyspark.sql import functions as F

from vocalith.operators.signal import SAMPLE_RATE
from vocalith.sources import audio, sinks
from vocalith.streaming import windows as T


def test_wav_round_trip_and_statuses(spark, tmp_path):
    x = 0.5 * np.sin(2 * np.pi * 440 * np.arange(SAMPLE_RATE * 2) / SAMPLE_RATE)
    (tmp_path / "a.wav").write_bytes(audio.encode_wav(x))
    (tmp_path / "quiet.WAV").write_bytes(audio.encode_wav(x * 0.01))
    (tmp_path / "short.wav").write_bytes(audio.encode_wav(x[:100], 8000))
    (tmp_path / "bad.wav").write_bytes(b"RIFFnothing")
    (tmp_path / "c.mp3").write_bytes(b"123")
    (tmp_path / "d.aac").write_bytes(b"123")
    got = {r["rec_id"]: r for r in audio.read_recordings(spark, str(tmp_path)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "ok", "quiet": "ok", "short": "short", "bad": "corrupt", "c": "unsupported"}
    assert np.allclose(got["a"]["amp"], x, atol=1e-4) and got["a"]["duration_s"] == 2.0
    assert abs(max(got["quiet"]["amp"]) - 10 ** (-3 / 20)) < 1e-6 and len(got["short"]["amp"]) == 200
    checks = {r["rec_id"]: r for r in audio.integrity(audio.read_recordings(spark, str(tmp_path))).collect()}
    assert checks["a"]["valid"] and not checks["bad"]["valid"] and checks["short"]["warnings"] == ["short"]


def test_guards(spark):
    df = spark.createDataFrame([("x/a.wav", 20 * 1024 * 1024), ("a.wav", 20 * 1024 * 1024 + 1), ("a.aac", 1), ("", 1), (None, 1), ("B.FLAC", 1)], "path string, length long")
    ok, bad = audio.guarded(df)
    assert ok.count() == 2 and sorted(r["reason"] for r in bad.collect()) == ["extension", "missing_path", "missing_path", "too_large"]


def test_metadata(spark):
    probe = json.dumps({"streams": [{"codec_type": "video"}, {"codec_type": "audio", "codec_name": "pcm_s16le", "sample_rate": "44100", "channels": 2, "bit_rate": "x"}], "format": {"duration": "1.5", "bit_rate": "320000", "tags": {"artist": "me", "vendor": "tool"}}})
    r = audio.file_metadata(spark.createDataFrame([("d/n.wav", probe), ("e", None)], "path string, probe_json string")).orderBy("path").collect()
    assert (r[0]["file_name"], r[0]["codec"], r[0]["sample_rate"], r[0]["duration_s"], r[0]["creation_tool"], r[0]["codec_note"]) == ("n.wav", "pcm_s16le", 44100, 1.5, "tool", "uncompressed")
    assert r[1]["codec"] is None and spark.range(1).select(audio.unknown_as_text(F.lit(None).cast("int"))).first()[0] == "Unknown"


def test_weights_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "w.json").write_text('{"ecapa": 2.0,\n "res": 0.5}')
    (tmp_path / "bad.json").write_text("nothing")
    assert {r["metric"]: r["weight"] for r in audio.read_weights(spark, str(tmp_path / "w.json")).collect()} == {"ecapa": 2.0, "res": 0.5}
    assert {r["metric"]: r["weight"] for r in audio.read_weights(spark, str(tmp_path / "bad.json")).collect()} == audio.DEFAULT_WEIGHTS
    assert {r["metric"] for r in audio.read_weights(spark, str(tmp_path / "none.json")).collect()} == set(audio.DEFAULT_WEIGHTS)
    monkeypatch.setenv("VM_SEGMENT_COUNT", "7")
    assert audio.Settings.from_env().segment_count == 7
    (tmp_path / "c.csv").write_text('index,mid,display_name\n0,/m/1,Speech\n1,/m/2,"Child speech, kid"\n')
    assert [r["display_name"] for r in audio.read_class_map(spark, str(tmp_path / "c.csv")).orderBy("index").collect()] == ["Speech", "Child speech, kid"]


def test_model_boundary(spark):
    def model():
        def encode(x):
            if len(x) == 1:
                raise ValueError("too short")
            return [x.sum(), 1.0]

        return encode

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [5.0])], "i int, frame array<double>")
    assert {r["i"]: r["v"] for r in audio.embedded(df, ["i"], model, 2).collect()} == {1: [3.0, 1.0], 2: [0.0, 0.0]}


def test_outputs(spark):
    a = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.1, None)], "r int, ts double, e double")
    assert sinks.plot_data(a, ["r"], ["e"]).count() == 1
    b = sinks.difference_bars(spark.createDataFrame([(1, 1.0, 9.0)], "p int, x double, y double"), spark.createDataFrame([(1, 1.5, 1.0)], "p int, x double, y double"), ["p"], {"x": 2.0, "y": 4.0})
    assert sorted((r["feature"], r["difference"], r["level"]) for r in b.collect()) == [("x", 0.25, "low"), ("y", 1.0, "high")]
    w = sinks.wav_rows(spark.createDataFrame([(1, [0.0, 0.5])], "i int, amp array<double>"), ["i"]).first()["wav"]
    assert audio.decode_wav(bytes(w))[1] == SAMPLE_RATE


def test_streaming_sessions_equal_batch(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:00:05", 2.0), (1, "2024-01-01 00:00:20", 4.0), (2, "2024-01-01 00:00:00", 8.0), (9, "2024-01-01 01:00:00", 0.0)]
    df = spark.createDataFrame(rows, "u int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    aggs = [F.sum("v").alias("total")]
    batch = {tuple(r) for r in T.sessions(df, ["u"], "ts", "10 seconds", aggs).collect() if r["u"] < 9}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = T.sessions(stream, ["u"], "ts", "10 seconds", aggs, late="1 minute").writeStream.format("memory").queryName("s").outputMode("append").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("s").collect()} == batch and len(batch) == 3
    finally:
        q.stop()


def test_settings_from_a_file(tmp_path, monkeypatch):
    path = tmp_path / ".env"
    path.write_text("# a comment\n\nexport VM_SEGMENT_COUNT=7\nVM_SEGMENT_S = '12.5'\nVM_MAX_BYTES=100 # bytes\nOTHER=1\nnothing\n")
    monkeypatch.setenv("VM_MAX_BYTES", "200")
    got = audio.Settings.from_env(path=str(path))
    assert (got.segment_count, got.segment_s, got.max_bytes, got.sample_rate) == (7, 12.5, 200, 16000)
    assert audio.Settings.from_env(path=str(tmp_path / "none")).segment_count == 5
