"""Media columns: content-addressed images in tar shards.

A payload of 8-bit samples is stored losslessly as a grey-scale PNG, 576 samples a line. A task writes the
images it makes into tar shards in the shared folder; the member's name is the digest of its payload, and a
digest is stored once in a shard. Rows carry digest, shard, offset and length of the stored image. When copies
sit in several shards, every row points at the same one of them (the least place).

Metadata columns come from range reads of the 33 header bytes alone (signature and IHDR); features come from
the stored bytes, read back, decoded and checked against the digest. Equal payloads are read once. A retried
task writes shards of new names; what the lost attempt wrote is never pointed at.

Cases: a null text counts as empty and is stored as one line of padding; equal texts share a digest, a place
and all features; a payload that would need over 2^31 - 1 lines is refused by the format; an empty table writes
no shard. The folder can be any that pyarrow's file systems open (file, hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, shared_dir

LINE = 576
HEADER = 33
_BLOCK = 512


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes, padded with 255 to a positive multiple of LINE, and their number before."""
    data = (text or "").encode()
    return data + b"\xff" * ((-len(data)) % LINE if data else LINE), len(data)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(payload: bytes, level: int = 6) -> bytes:
    """A grey-scale PNG of 8-bit samples, LINE wide, no line filters."""
    lines = np.frombuffer(payload, dtype=np.uint8).reshape(-1, LINE)
    raw = np.zeros((len(lines), LINE + 1), dtype=np.uint8)
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def header(data: bytes) -> dict:
    """Width, height, bit depth and colour type from the first HEADER bytes."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", data[16:26])
    return {"width": width, "height": height, "bit_depth": depth, "colour_type": colour}


def decode(data: bytes) -> bytes:
    """The samples of an image that ``encode`` made."""
    width = header(data)["width"]
    at, parts = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), dtype=np.uint8).reshape(-1, width + 1)
    if raw[:, 0].any():
        raise ValueError("line filters are not in use here")
    return raw[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit average hash over 64 equal stretches."""
    x = np.frombuffer(samples, dtype=np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    entropy = float(-(p[p > 0] * np.log2(p[p > 0])).sum())
    level = np.arange(256)
    mean = float(p @ level)
    spread = float(np.sqrt(max(0.0, p @ (level - mean) ** 2)))
    parts = x.reshape(64, -1).mean(1)  # LINE is a multiple of 64
    bits = np.packbits(parts > parts.mean()).tobytes().hex()
    return f"mean={mean:.4f};std={spread:.4f};entropy={entropy:.4f};ahash={bits}"


def _tar_header(name: str, size: int) -> bytes:
    """A ustar header with fixed owner, mode and time, so that equal members are equal bytes."""
    fields = [name.encode().ljust(100, b"\0"), b"0000644\0", b"0000000\0", b"0000000\0", f"{size:011o}\0".encode(), b"00000000000\0", b" " * 8, b"0", b"\0" * 100, b"ustar\x0000"]
    raw = bytearray(b"".join(fields).ljust(_BLOCK, b"\0"))
    raw[148:156] = f"{sum(raw):06o}\0 ".encode()
    return bytes(raw)


def _open(uri: str):
    """File system and path of a folder given by URI or plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def store(docs: DataFrame, folder: str, doc: str = "doc_id", text: str = "text", shard_bytes: int = 64 << 20) -> DataFrame:
    """Write the payloads; rows (doc, digest, n_bytes, shard, offset, length): offset and length of the image in its shard."""
    bounded_batches(docs.sparkSession)

    def write(batches):
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        name, out, at, placed = "", None, 0, {}
        try:
            for x in batches:
                rows = []
                for d, t in zip(x["d"], x["t"], strict=True):
                    payload, n = payload_of(t)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in placed:
                        if out is None:
                            name, at, placed = f"{uuid.uuid4().hex[:20]}.tar", 0, {}
                            out = files.open_output_stream(f"{root}/{name}")
                        image = encode(payload)
                        out.write(_tar_header(f"{digest.hex()}.png", len(image)) + image + b"\0" * (-len(image) % _BLOCK))
                        placed[digest] = (name, at + _BLOCK, len(image))
                        at += _BLOCK + len(image) + -len(image) % _BLOCK
                    rows.append((d, digest, n, *placed[digest]))
                    if at >= shard_bytes:
                        out.write(b"\0" * 2 * _BLOCK)
                        out.close()
                        out, at, placed = None, 0, {}
                yield pd.DataFrame(rows, columns=["d", "digest", "n_bytes", "shard", "offset", "length"])
        finally:
            if out is not None:
                out.write(b"\0" * 2 * _BLOCK)
                out.close()

    kind = docs.schema[doc].dataType.simpleString()
    # ids as text: pandas has no long with nulls
    got = docs.select(F.col(doc).cast("string").alias("d"), F.col(text).alias("t")).mapInPandas(write, "d string, digest binary, n_bytes long, shard string, offset long, length long")
    return materialise(got.select(F.col("d").cast(kind).alias(doc), "digest", "n_bytes", "shard", "offset", "length"), "media-index")


def places(index: DataFrame) -> DataFrame:
    """One place for each digest, in the order of shards and offsets, so that reads go forward."""
    one = index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("p")).select("digest", "p.*")
    return materialise(one, "media-places")


def _reader(folder: str):
    """reads(shard, offset, length): range reads; keeps the last shard open."""
    files, root = _open(folder)
    held: dict[str, object] = {}

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in held:
            for f in held.values():
                f.close()
            held.clear()
            held[shard] = files.open_input_file(f"{root}/{shard}")
        return held[shard].read_at(length, offset)

    return read


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


def read_headers(place: DataFrame, folder: str) -> DataFrame:
    """``place`` with metadata columns from HEADER bytes of each image: width, height, bit_depth, colour_type."""

    def run(batches):
        read = _reader(folder)
        for x in batches:
            got = [header(read(s, o, HEADER)) for s, o in zip(x["shard"], x["offset"], strict=True)]
            yield pd.concat([x, pd.DataFrame(got, columns=["width", "height", "bit_depth", "colour_type"])], axis=1)

    return place.repartitionByRange("shard", "offset").sortWithinPartitions("shard", "offset").mapInPandas(run, f"{_ddl(place)}, width long, height long, bit_depth int, colour_type int")


def read_features(heads: DataFrame, folder: str) -> DataFrame:
    """Rows of ``read_headers``, in whose order every image is read back, with its payload's size, digests and features.
    Raises if the payload isn't what was stored or hasn't the size that the header tells."""

    def run(batches):
        read = _reader(folder)
        for x in batches:
            out = []
            for digest, s, o, n, w, h in zip(x["digest"], x["shard"], x["offset"], x["length"], x["width"], x["height"], strict=True):
                image = read(s, o, n)
                payload = decode(image)
                if hashlib.sha256(payload).digest() != digest or len(payload) != w * h:
                    raise ValueError(f"{s} at {o}: the stored image is not {digest.hex()}")
                out.append((len(payload), zlib.crc32(payload[-32:]), hashlib.sha256(image).digest(), features(payload)))
            yield pd.concat([x, pd.DataFrame(out, columns=["payload_bytes", "tail_crc32", "media_sha256", "feature"])], axis=1)

    return heads.mapInPandas(run, f"{_ddl(heads)}, payload_bytes long, tail_crc32 long, media_sha256 binary, feature string")


def media_columns(docs: DataFrame, doc: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Store, index, read back; one row for each row of ``docs``: its digests in hex, its place, its features."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/media-{uuid.uuid4().hex}"
    index = store(docs, folder, doc, text)
    place = places(index)
    read = materialise(read_features(read_headers(place, folder), folder), "media-features")
    hexed = lambda c: F.lower(F.hex(c))
    got = index.select(doc, "digest", "n_bytes").join(read, "digest").withColumnRenamed("length", "media_bytes")
    return got.withColumns({"digest": hexed("digest"), "payload_sha256": hexed("digest"), "media_sha256": hexed("media_sha256")})
