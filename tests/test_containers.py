"""Headers of each container, built byte by byte; broken ones get a status."""

import struct

import numpy as np
import pytest

from vocalith.sources import audio, containers

from .test_flac import encode, music


def wav(seconds=2, tool=b"Recorder 3\0\0"):
    body = audio.encode_wav(np.zeros(16000 * seconds))[12:]
    info = b"INFOISFT" + struct.pack("<I", len(tool)) + tool
    body = b"LIST" + struct.pack("<I", len(info)) + info + body
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"WAVE" + body


def page(payload, granule=0):
    laces = [255] * (len(payload) // 255) + [len(payload) % 255]
    return b"OggS\0\2" + struct.pack("<q", granule) + bytes(12) + bytes([len(laces), *laces]) + payload


def vorbis(rate=44100, samples=88200):
    first = b"\x01vorbis" + struct.pack("<IBIiiiB", 0, 2, rate, 0, 128000, 0, 0xB8) + b"\1"
    return page(first) + page(b"\x03vorbis" + struct.pack("<I", 6) + b"libVor" + bytes(4)) + page(b"x" * 300, samples)


def opus():
    return page(b"OpusHead\1\1" + struct.pack("<HIhB", 312, 16000, 0, 0)) + page(b"OpusTags" + struct.pack("<I", 4) + b"libo" + bytes(4)) + page(b"x", 312 + 48000 * 3)


def mp3(xing=None, tag=True):
    id3 = b""
    if tag:
        frame = b"TSSE" + struct.pack(">I", 6) + bytes(2) + b"\0Lame\0"
        id3 = b"ID3\3\0\0" + bytes([0, 0, 0, len(frame)]) + frame
    body = b"\xff\xfb\x90\x00" + bytes(32)  # version 1 layer III, 128 kbit/s, 44100 Hz, two channels
    if xing:
        body += b"Xing" + struct.pack(">II", 1, xing)
    return id3 + body + bytes(16000 - len(body))


def atom(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + name + body


def m4a(at_end=False):
    entry = struct.pack(">I", 36) + b"mp4a" + bytes(16) + struct.pack(">HHHHI", 1, 16, 0, 0, 22050 << 16)
    track = atom(b"trak", atom(b"mdia", atom(b"mdhd", bytes(12), struct.pack(">II", 22050, 22050 * 4), bytes(4)), atom(b"minf", atom(b"stbl", atom(b"stsd", bytes(4), struct.pack(">I", 1), entry)))))
    tool = atom(b"udta", atom(b"meta", bytes(4), atom(b"ilst", atom(b"\xa9too", atom(b"data", bytes(8), b"Lavf60")))))
    moov, media = atom(b"moov", atom(b"mvhd", bytes(100)), track, tool), atom(b"mdat", bytes(200_000))
    return atom(b"ftyp", b"M4A ") + (media + moov if at_end else moov + media)


FILES = {
    "a.wav": (wav(), ("wav", "pcm_s16le", 16000, 1, 256000, 2.0, "Recorder 3", "ok")),
    "b.flac": (encode(music(16000, 2), stereo=10), ("flac", "flac", 16000, 2, None, 1.0, "a tool", "ok")),
    "c.ogg": (vorbis(), ("ogg", "vorbis", 44100, 2, 128000, 2.0, "libVor", "ok")),
    "d.ogg": (opus(), ("ogg", "opus", 16000, 1, None, 3.0, "libo", "ok")),
    "e.mp3": (mp3(), ("mp3", "mp3", 44100, 2, 128000, 1.0, "Lame", "ok")),
    "f.mp3": (mp3(xing=100, tag=False), ("mp3", "mp3", 44100, 2, None, 100 * 1152 / 44100, None, "ok")),
    "g.m4a": (m4a(), ("m4a", "aac", 22050, 1, None, 4.0, "Lavf60", "ok")),
    "h.m4a": (m4a(at_end=True), ("m4a", "aac", 22050, 1, None, 4.0, "Lavf60", "ok")),
    "i.txt": (b"just text", (None,) * 7 + ("unknown",)),
    "j.wav": (wav()[:30], (None,) * 7 + ("corrupt",)),
    "k.mp3": (b"\xff\xff\xff\xff" + bytes(50), (None,) * 7 + ("corrupt",)),
    "l.ogg": (page(b"something else"), (None,) * 7 + ("corrupt",)),
    "m.flac": (b"fLaC" + bytes(10), (None,) * 7 + ("corrupt",)),
    "n.m4a": (m4a()[:60], (None,) * 7 + ("corrupt",)),
    "o.wav": (b"", (None,) * 7 + ("unknown",)),
    "p.mp3": (b"ID3\3\0\0\x7f\x7f\x7f\x7f" + bytes(100_000), (None,) * 7 + ("out_of_range",)),
}


def test_headers(spark):
    df = spark.createDataFrame([(p, len(d), d) for p, (d, _) in FILES.items()] + [("null", None, None)], "path string, length long, content binary")
    got = {r["path"]: r for r in containers.with_headers(df).collect()}
    assert got["a.wav"].asDict().keys() == {"path", "length", *containers.FIELDS} and got["null"]["status"] == "unknown"
    for p, (data, want) in FILES.items():
        for k, v in zip(containers.FIELDS, want, strict=True):
            if k == "bit_rate" and v is None and want[-1] == "ok" and p != "d.ogg":
                v = round(8 * (len(data)) / want[5])
            assert got[p][k] == (pytest.approx(v) if isinstance(v, float) else v), (p, k)
    good, bad = containers.routed(containers.with_headers(df))
    assert (good.count(), bad.count()) == (8, 9)


def test_any_prefix_has_a_status():
    for data, _ in FILES.values():
        for n in (0, 1, 3, 4, 7, 8, 11, 12, 20, 27, 28, 40, 64, 90, 200, 400):
            head = data[:n]
            assert containers.probe(head, head[-containers.TAIL :], len(head))["status"] in ("ok", "corrupt", "unknown")


def test_files_on_disk(spark, tmp_path):
    for p, (data, _) in FILES.items():
        (tmp_path / p).write_bytes(data)
    got = containers.with_headers(spark.read.format("binaryFile").load(str(tmp_path)))
    found = {r["path"].rsplit("/", 1)[1]: r["status"] for r in got.collect()}
    assert {"o.wav": "unknown"} | found == {p: w[-1] for p, (_, w) in FILES.items()}  # Spark may leave empty files out
