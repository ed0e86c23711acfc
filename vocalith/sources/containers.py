"""What the headers of audio files tell, without a prober and without the payload: format, rate, channels, length, tool.

Only the first and the last bytes of a file are looked at (``HEAD`` and ``TAIL``), and its size. A header that does not fit
its format gives the status corrupt; one that lies outside these bytes, out_of_range.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flac

HEAD = TAIL = 1 << 16


class OutOfRangeError(Exception):
    """The header goes on where we do not look."""


def _need(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise OutOfRangeError
    return data[at : at + n]


def _text(raw: bytes) -> str | None:
    return raw.split(b"\0")[0].decode("utf-8", "replace").strip() or None


def riff(head: bytes, tail: bytes, size: int) -> dict:
    at, got = 12, {"format": "wav"}
    rate_bytes = 0
    while at + 8 <= len(head):
        name, n = head[at : at + 4], int.from_bytes(head[at + 4 : at + 8], "little")
        if name == b"fmt ":
            x = _need(head, at + 8, 16)
            kind, channels = int.from_bytes(x[:2], "little"), int.from_bytes(x[2:4], "little")
            rate, rate_bytes = int.from_bytes(x[4:8], "little"), int.from_bytes(x[8:12], "little")
            codec = {1: f"pcm_s{int.from_bytes(x[14:16], 'little')}le", 3: f"pcm_f{int.from_bytes(x[14:16], 'little')}le", 6: "pcm_alaw", 7: "pcm_mulaw"}.get(kind, "pcm" if kind == 0xFFFE else "unknown")
            got |= {"codec": codec, "sample_rate": rate, "channels": channels, "bit_rate": 8 * rate_bytes}
            if not rate or not channels or not rate_bytes:
                raise ValueError("fmt")
        elif name == b"data":
            if not rate_bytes:
                raise ValueError("data before fmt")
            got["duration_s"] = min(n, max(0, size - at - 8)) / rate_bytes
        elif name == b"LIST" and head[at + 8 : at + 12] == b"INFO":
            got["creation_tool"] = _info(head[at + 12 : at + 8 + n]) or got.get("creation_tool")
        at += 8 + n + (n & 1)
    if "codec" not in got or "duration_s" not in got:
        raise ValueError("chunks are missing") if at >= size else OutOfRangeError
    return got


def _info(raw: bytes) -> str | None:
    at = 0
    while at + 8 <= len(raw):
        n = int.from_bytes(raw[at + 4 : at + 8], "little")
        if raw[at : at + 4] == b"ISFT":
            return _text(raw[at + 8 : at + 8 + n])
        at += 8 + n + (n & 1)
    return None


def flac_stream(head: bytes, tail: bytes, size: int) -> dict:
    info = flac.stream_info(head)
    if not info.rate:
        raise ValueError("rate")
    seconds = info.samples / info.rate if info.samples else None
    return {"format": "flac", "codec": "flac", "sample_rate": info.rate, "channels": info.channels, "duration_s": seconds, "bit_rate": round(8 * size / seconds) if seconds else None, "creation_tool": info.vendor}


def ogg(head: bytes, tail: bytes, size: int) -> dict:
    segments = _need(head, 26, 1)[0]
    at = 27 + segments
    first = _need(head, at, sum(_need(head, 27, segments)))
    if first[:7] == b"\x01vorbis":
        got = {"codec": "vorbis", "channels": first[11], "sample_rate": int.from_bytes(first[12:16], "little"), "bit_rate": int.from_bytes(first[20:24], "little") or None}
        clock, skip, mark = got["sample_rate"], 0, b"\x03vorbis"
    elif first[:8] == b"OpusHead":
        got = {"codec": "opus", "channels": first[9], "sample_rate": int.from_bytes(first[12:16], "little") or 48000}
        clock, skip, mark = 48000, int.from_bytes(first[10:12], "little"), b"OpusTags"
    else:
        raise ValueError("no known stream")
    if not clock or not got["channels"]:
        raise ValueError("identification")
    page = tail.rfind(b"OggS")
    if page >= 0 and page + 14 <= len(tail):  # the last page knows how many samples went before
        got["duration_s"] = max(0, int.from_bytes(tail[page + 6 : page + 14], "little") - skip) / clock
    vendor = head.find(mark)
    if vendor >= 0 and vendor + len(mark) + 4 <= len(head):
        a = vendor + len(mark)
        got["creation_tool"] = _text(head[a + 4 : a + 4 + int.from_bytes(head[a : a + 4], "little")])
    return got | {"format": "ogg"}


#: Fixed values of layer III: rates by version, kbit/s by code for version 1 and for 2 and 2.5.
_MP3_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_MP3_KBITS = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}


def mp3(head: bytes, tail: bytes, size: int) -> dict:
    at, tool = 0, None
    if head[:3] == b"ID3":
        n = 0
        for b in _need(head, 6, 4):
            n = n << 7 | b & 127
        tool, at = _id3_tool(head[10 : 10 + n], head[3]), 10 + n
    h = int.from_bytes(_need(head, at, 4), "big")
    version, layer, code, rate_code = h >> 19 & 3, h >> 17 & 3, h >> 12 & 15, h >> 10 & 3
    if h >> 21 != 0x7FF or layer != 1 or version == 1 or code == 15 or rate_code == 3:
        raise ValueError("frame header")
    rate, kbits = _MP3_RATES[version][rate_code], _MP3_KBITS[3 if version == 3 else 2][code]
    one = h >> 6 & 3 == 3
    samples = 1152 if version == 3 else 576
    got = {"format": "mp3", "codec": "mp3", "sample_rate": rate, "channels": 1 if one else 2, "creation_tool": tool}
    mark = at + 4 + ((17 if one else 32) if version == 3 else (9 if one else 17))
    if head[mark : mark + 4] in (b"Xing", b"Info") and head[mark + 7] & 1 and mark + 12 <= len(head):
        frames = int.from_bytes(head[mark + 8 : mark + 12], "big")
        seconds = frames * samples / rate
        return got | {"duration_s": seconds, "bit_rate": round(8 * (size - at) / seconds) if seconds else None}
    audio = size - at - (128 if tail[-128:-125] == b"TAG" else 0)
    return got | {"bit_rate": 1000 * kbits or None, "duration_s": 8 * audio / (1000 * kbits) if kbits else None}


def _id3_tool(raw: bytes, version: int) -> str | None:
    at = 0
    while at + 10 <= len(raw) and raw[at]:
        x = raw[at + 4 : at + 8]
        n = sum(b << 7 * (3 - i) for i, b in enumerate(x)) if version == 4 else int.from_bytes(x, "big")
        if raw[at : at + 4] in (b"TSSE", b"TENC") and n > 1:
            body, code = raw[at + 11 : at + 10 + n], raw[at + 10]
            return body.decode({1: "utf-16", 2: "utf-16-be"}.get(code, "utf-8"), "replace").strip("\0 ") or None
        at += 10 + n
    return None


def _atoms(data: bytes, at: int, end: int):
    """(name, start of the body, end) of each atom."""
    while at + 8 <= min(end, len(data)):
        n, body = int.from_bytes(data[at : at + 4], "big"), at + 8
        if n == 1:
            n, body = int.from_bytes(_need(data, at + 8, 8), "big"), at + 16
        n = n or end - at
        if n < 8:
            raise ValueError("atom")
        yield data[at + 4 : at + 8], body, at + n
        at += n


def mp4(head: bytes, tail: bytes, size: int) -> dict:
    top = {name: (a, b) for name, a, b in _atoms(head, 0, size)}
    data, (at, end) = head, top.get(b"moov", (0, 0))
    if not end or end > len(head):  # the index may stand at the end
        k = tail.find(b"moov")
        if k < 4:
            raise OutOfRangeError
        data, at, end = tail, k + 4, k - 4 + int.from_bytes(tail[k - 4 : k], "big")
        if end > len(tail):
            raise OutOfRangeError
    got: dict = {"format": "m4a"}

    def walk(a: int, b: int) -> None:
        for name, x, y in _atoms(data, a, b):
            if name in (b"trak", b"mdia", b"minf", b"stbl", b"udta", b"ilst", b"\xa9too"):
                walk(x, y)
            elif name == b"meta":
                walk(x + 4, y)
            elif name == b"data" and y - x > 8:
                got["creation_tool"] = _text(data[x + 8 : y])
            elif name == b"mdhd":
                long = data[x] == 1
                scale, ticks = (data[x + 20 : x + 24], data[x + 24 : x + 32]) if long else (data[x + 12 : x + 16], data[x + 16 : x + 20])
                if int.from_bytes(scale, "big"):
                    got["_seconds"] = int.from_bytes(ticks, "big") / int.from_bytes(scale, "big")
            elif name == b"stsd" and data[x + 12 : x + 16] in (b"mp4a", b"alac", b"Opus", b"fLaC"):
                entry = x + 8
                got["codec"] = {b"mp4a": "aac", b"alac": "alac", b"Opus": "opus", b"fLaC": "flac"}[data[x + 12 : x + 16]]
                got["channels"], got["sample_rate"] = int.from_bytes(data[entry + 24 : entry + 26], "big"), int.from_bytes(data[entry + 32 : entry + 34], "big")
                got["duration_s"] = got.get("_seconds")

    walk(at, end)
    if "codec" not in got:
        raise ValueError("no audio track")
    seconds = got.pop("_seconds", None)
    return got | {"bit_rate": round(8 * size / seconds) if seconds else None}


def probe(head: bytes, tail: bytes, size: int) -> dict:
    """The fields that the headers give, and ``status``: ok, corrupt, out_of_range, unknown."""
    kind = riff if head[:4] == b"RIFF" and head[8:12] == b"WAVE" else flac_stream if head[:4] == b"fLaC" else ogg if head[:4] == b"OggS" else mp4 if head[4:8] == b"ftyp" else mp3 if head[:3] == b"ID3" or (len(head) > 1 and head[0] == 0xFF and head[1] >> 5 == 7) else None
    if kind is None:
        return {"status": "unknown"}
    try:
        return kind(head, tail, size) | {"status": "ok"}
    except OutOfRangeError:
        return {"status": "out_of_range" if size > len(head) else "corrupt"}
    except (ValueError, IndexError):
        return {"status": "corrupt"}


FIELDS = {"format": "string", "codec": "string", "sample_rate": "int", "channels": "int", "bit_rate": "int", "duration_s": "double", "creation_tool": "string", "status": "string"}


def with_headers(files: DataFrame, content: str = "content", size: str = "length") -> DataFrame:
    """``binaryFile`` rows with what their headers tell; only the first and last bytes go to Python, and the payload is dropped."""

    @F.pandas_udf(", ".join(f"{k} {t}" for k, t in FIELDS.items()))
    def run(head: pd.Series, tail: pd.Series, n: pd.Series) -> pd.DataFrame:
        rows = [probe(bytes(h or b""), bytes(t or b""), int(k or 0)) for h, t, k in zip(head, tail, n, strict=True)]
        out = pd.DataFrame([[r.get(k) for k in FIELDS] for r in rows], columns=list(FIELDS), dtype=object)
        whole = {"sample_rate": "Int32", "channels": "Int32", "bit_rate": "Int32", "duration_s": "Float64"}
        return out.astype(whole)

    data = F.col(content)
    tail = F.substring(data, F.greatest(F.length(data) - TAIL + 1, F.lit(1)), F.lit(TAIL))
    got = files.withColumn("_h", run(F.substring(data, 1, HEAD), tail, F.coalesce(F.col(size), F.length(data).cast("long"), F.lit(0).cast("long"))))
    return got.select(*[c for c in files.columns if c not in (content, *FIELDS)], "_h.*")


def routed(probed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose headers are whole, the others)."""
    good = F.col("status") == "ok"
    return probed.where(good), probed.where(~good)
