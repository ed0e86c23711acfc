"""Recordings as tables: decoding, information, guards, metadata, weights, class maps.

PCM WAV and FLAC are decoded here; other whitelisted formats come out with a status instead of
samples, to be decoded by a reader that has the codecs. Embeddings enter as tables.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator
from dataclasses import dataclass, fields
from os import environ

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.signal import SAMPLE_RATE, resample
from . import flac

#: Fixed values.
EXTENSIONS = (".wav", ".mp3", ".m4a", ".flac", ".ogg")
MAX_BYTES = 20 * 1024 * 1024
QUIET_DBFS, HEADROOM_DB, SHORT_S = -30.0, 3.0, 1.0
DEFAULT_WEIGHTS = {"ecapa": 1.5, "xvec": 1.5, "res": 1.2, "formant": 1.0, "formant_dynamics": 1.5, "fricative": 1.2, "nasal": 1.3, "vocal_tract": 1.8, "jitter_shimmer": 1.1, "yamnet": 0.8}


@dataclass(frozen=True)
class Settings:
    """One settings object for all thresholds; ``from_env`` reads VM_ variables of the same names, from a file of
    ``NAME=value`` lines and from the environment, which comes first."""

    sample_rate: int = SAMPLE_RATE
    segment_count: int = 5
    segment_s: float = 30.0
    confidence_level: float = 0.95
    consistency_warning: float = 0.15
    synthetic_probability: float = 0.7
    max_bytes: int = MAX_BYTES

    @classmethod
    def from_env(cls, prefix: str = "VM_", path: str | None = None) -> Settings:
        told = (env_file(path) if path else {}) | dict(environ)
        return cls(**{f.name: type(f.default)(told[prefix + f.name.upper()]) for f in fields(cls) if prefix + f.name.upper() in told})

    def thresholds(self) -> dict[str, float]:
        return {"very_high": 0.95, "high": 0.88, "probable": 0.80, "similar": 0.70}

    def model_weights(self) -> dict[str, float]:
        return dict(DEFAULT_WEIGHTS)


def env_file(path: str) -> dict[str, str]:
    """``NAME=value`` lines: blank lines and those from # on are left out, ``export`` and quotes around a value too.
    A file that is not there holds nothing."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except FileNotFoundError:
        return {}
    out = {}
    for line in lines:
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        value = value.strip()
        if equals and not name.startswith("#"):
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].strip()
    return out


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def reject_reason(path: Column, size: Column, exists: Column | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """Null where a file is taken; missing, empty path, extension and size are told apart."""
    there = F.lit(True) if exists is None else exists
    return F.when(path.isNull() | (path == ""), "missing_path").when(~there, "not_found").when(~extension(path).isin(*EXTENSIONS), "extension").when(size > max_bytes, "too_large")


def guarded(files: DataFrame, path: str = "path", size: str = "length") -> tuple[DataFrame, DataFrame]:
    """(taken, rejected with ``reason``)."""
    marked = files.withColumn("reason", reject_reason(F.col(path), F.col(size)))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def decode_wav(data: bytes) -> tuple[np.ndarray, int, int, int]:
    """(mono samples in -1..1, rate, channels, bits)."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, rate, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 1:
        x = np.frombuffer(raw, dtype=np.uint8).astype(float) / 128.0 - 1.0
    elif width == 3:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(raw, dtype={2: "<i2", 4: "<i4"}[width]).astype(float) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(1), rate, channels, 8 * width


def encode_wav(x: np.ndarray, sr: int = SAMPLE_RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def decode_flac(data: bytes) -> tuple[np.ndarray, int, int, int]:
    """(mono samples in -1..1, rate, channels, bits)."""
    x, info = flac.decode(data)
    return x.mean(axis=1) / float(1 << (info.bits - 1)), info.rate, info.channels, info.bits


_DECODERS = {"wav": decode_wav, "flac": decode_flac}
_DECODED = "rec_id string, path string, sr int, channels int, bits int, frames long, duration_s double, format string, status string, amp array<double>"


def decoded(files: DataFrame, target: int | None = SAMPLE_RATE) -> DataFrame:
    """``binaryFile`` rows -> one row for each recording; ``status`` is ok, short, unsupported or corrupt.

    Very quiet recordings (under -30 dBFS) are raised to 3 dB of headroom. ``target`` None keeps the native rate.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"], strict=True):
                name, dot = path.rsplit("/", 1)[-1], path.rsplit(".", 1)[-1].lower()
                row = [name.rsplit(".", 1)[0], path, None, None, None, None, None, dot, "unsupported", None]
                if dot in _DECODERS:
                    try:
                        x, sr, channels, bits = _DECODERS[dot](data)
                        frames, seconds = len(x), len(x) / sr
                        level = 20 * np.log10(max(float(np.sqrt(np.mean(x**2))) if len(x) else 0.0, 1e-10))
                        if len(x) and level < QUIET_DBFS and np.abs(x).max() > 0:
                            x = x / np.abs(x).max() * 10 ** (-HEADROOM_DB / 20)
                        if target:
                            x, sr = resample(x, sr, target), target
                        row[2:] = [sr, channels, bits, frames, seconds, dot, "short" if seconds < SHORT_S else "ok", x]
                    except (wave.Error, EOFError, KeyError, ValueError):
                        row[8] = "corrupt"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["rec_id", "path", "sr", "channels", "bits", "frames", "duration_s", "format", "status", "amp"]).astype({"sr": "Int32", "channels": "Int32", "bits": "Int32", "frames": "Int64"})

    return files.select("path", "content").mapInPandas(run, _DECODED)


def read_recordings(spark: SparkSession, path: str, target: int | None = SAMPLE_RATE) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return decoded(files.where(reject_reason(F.col("path"), F.col("length")).isNull()), target)


#: Schema of the probe's JSON.
PROBE = "streams array<struct<codec_type:string,codec_name:string,sample_rate:string,channels:int,bit_rate:string>>, format struct<duration:string,bit_rate:string,tags:map<string,string>>"


def file_metadata(files: DataFrame, probe: str = "probe_json") -> DataFrame:
    """Stat fields, the first audio stream of the probe's JSON, and the first tag that names a tool."""
    p = F.from_json(probe, PROBE)
    audio = F.try_element_at(F.filter(p["streams"], lambda s: s["codec_type"] == "audio"), F.lit(1))
    tag = F.coalesce(*[F.try_element_at(p["format"]["tags"], F.lit(k)) for k in ("encoder", "vendor", "product", "artist", "comment")])
    codec = audio["codec_name"]
    return files.withColumns(
        {
            "file_name": base_name(F.col("path")),
            "codec": codec,
            "sample_rate": audio["sample_rate"].try_cast("int"),
            "channels": audio["channels"],
            "bit_rate": F.coalesce(audio["bit_rate"], p["format"]["bit_rate"]).try_cast("int"),
            "duration_s": p["format"]["duration"].try_cast("double"),
            "creation_tool": tag,
            "codec_note": F.when(codec.contains("pcm"), "uncompressed").when(codec.isin("mp3", "aac", "vorbis", "opus"), "lossy").when(codec == "flac", "lossless"),
        }
    )


def unknown_as_text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("Unknown"))


def integrity(decoded_rows: DataFrame) -> DataFrame:
    """(rec_id, valid, errors, warnings) from the decoder's status."""
    s = F.col("status")
    return decoded_rows.select("rec_id", s.isin("ok", "short").alias("valid"), F.array_compact(F.array(F.when(s.isin("corrupt", "unsupported"), s))).alias("errors"), F.array_compact(F.array(F.when(s == "short", s))).alias("warnings"))


def read_weights(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A JSON object metric -> weight, which replaces the defaults; the defaults where it can't be read."""
    rows = None
    if path:
        try:
            line = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,double>", {"mode": "FAILFAST"}).alias("m"))
            rows = [(k, float(v)) for k, v in (line.first()["m"] or {}).items()]
        except Exception:  # any failure means the defaults
            rows = None
    return spark.createDataFrame(rows or sorted(DEFAULT_WEIGHTS.items()), "metric string, weight double")


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """(index, mid, display_name) of a sound-class CSV, with its header and quoted names."""
    return spark.read.csv(path, header=True, schema="index int, mid string, display_name string")


def embedded(frames: DataFrame, keys: list[str], model, size: int, frame: str = "frame") -> DataFrame:
    """Model boundary: ``model()`` gives a function from a list of frames to vectors, loaded once for each worker.
    A frame that it fails on gets zeros."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for b in batches:
            out = []
            for f in b:
                try:
                    out.append(np.asarray(encode(np.asarray(f)), dtype=np.float32))
                except Exception:  # the contract: zeros for what can't be embedded
                    out.append(np.zeros(size, dtype=np.float32))
            yield pd.Series(out)

    return frames.select(*keys, run(frame).alias("v"))
