import hashlib
import io
import tarfile
import zlib

import numpy as np

from vocalith.llm import media
from vocalith.llm.common import shared_dir

from .tables import documents, empty, frame


def test_round_trip_and_header():
    for t in (None, "", "a", "é" * 600, "x" * 576, "y" * 577):
        payload, n = media.payload_of(t)
        assert n == len((t or "").encode()) and len(payload) % 576 == 0 and len(payload) > 0
        image = media.encode(payload)
        assert media.decode(image) == payload
        assert media.header(image[: media.HEADER]) == {"width": 576, "height": len(payload) // 576, "bit_depth": 8, "colour_type": 0}


def test_columns(spark):
    rows = documents()
    got = media.media_columns(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        payload, n = media.payload_of(texts[r["doc_id"]])
        assert r["n_bytes"] == n and r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["width"] == 576 and r["height"] == len(payload) // 576
        image = media.encode(payload)
        assert r["media_bytes"] == len(image) and r["media_sha256"] == hashlib.sha256(image).hexdigest() and r["feature"] == media.features(payload)
    places = {}
    for r in got:
        places.setdefault(r["digest"], set()).add((r["shard"], r["offset"], r["media_bytes"]))
    assert all(len(v) == 1 for v in places.values())


def test_shards_are_tar_files_and_header_reads(spark):
    folder = shared_dir(spark) + "/media-test"
    index = media.store(frame(spark).repartition(2), folder, shard_bytes=20_000)
    place = media.places(index)
    heads = {bytes(r["digest"]): r for r in media.read_headers(place, folder).collect()}
    files, root = media._open(folder)
    shards = {}
    for r in place.collect():
        shards.setdefault(r["shard"], []).append(r)
    assert len(shards) > 1
    for shard, rows in shards.items():
        data = files.open_input_file(f"{root}/{shard}").read()
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            members = {m.name: m for m in t.getmembers()}
        for r in rows:
            m = members[bytes(r["digest"]).hex() + ".png"]
            assert (m.offset_data, m.size) == (r["offset"], r["length"])
            assert heads[bytes(r["digest"])]["width"] == 576


def test_metadata_columns_come_from_the_header_reads(spark, monkeypatch):
    calls, real = [], media.read_headers
    monkeypatch.setattr(media, "read_headers", lambda *a: calls.append(a) or real(*a))
    got = media.media_columns(frame(spark)).collect()
    assert len(calls) == 1 and {(r["width"], r["bit_depth"], r["colour_type"]) for r in got} == {(576, 8, 0)}


def test_features_tell_payloads_apart():
    a, b = (np.random.default_rng(i).integers(0, 256, 5760, dtype=np.uint8).tobytes() for i in (1, 2))
    assert media.features(a) != media.features(b) and media.features(a) == media.features(bytes(a))


def test_empty(spark):
    assert media.media_columns(empty(spark)).count() == 0
