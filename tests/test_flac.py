"""FLAC decoding against an encoder written for the tests: every kind of subframe, bit for bit."""

import hashlib

import numpy as np
import pytest

from vocalith.sources import audio, flac


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> (n - 1 - i) & 1 for i in range(n)]

    def rice(self, v, k):
        u = v << 1 if v >= 0 else (-v << 1) - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)

    def bytes(self):
        bits = self.bits + [0] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, dtype=np.uint8)).tobytes()


def residual(w, e, order, size, partitions, escape=False):
    wide = not escape and len(e) and np.abs(e).max() > 1 << 12  # parameters of five bits
    w.put(1 if wide else 0, 2)
    w.put(partitions.bit_length() - 1, 4)
    at = 0
    for i in range(partitions):
        n = size // partitions - (order if i == 0 else 0)
        part = e[at : at + n]
        at += n
        if escape:
            width = max((int(abs(v)).bit_length() + 1 for v in part), default=1)
            w.put(15, 4)
            w.put(width, 5)
            for v in part:
                w.put(int(v), width)
        else:
            k = max(0, int(np.mean(np.abs(part)) + 1).bit_length() - 1) if n else 0
            w.put(k, 5 if wide else 4)
            for v in part:
                w.rice(int(v), k)


def subframe(w, x, bits, kind, wasted=0):
    x = [int(v) >> wasted for v in x]
    bits -= wasted
    code = {"constant": 0, "verbatim": 1}.get(kind[0], 8 + kind[1] if kind[0] == "fixed" else 31 + len(kind[1]) if kind[0] == "lpc" else 0)
    w.put(0, 1)
    w.put(code, 6)
    w.put(1 if wasted else 0, 1)
    if wasted:
        w.put(1, wasted)
    if kind[0] == "constant":
        w.put(x[0], bits)
    elif kind[0] == "verbatim":
        for v in x:
            w.put(v, bits)
    else:
        order = kind[1] if kind[0] == "fixed" else len(kind[1])
        for v in x[:order]:
            w.put(v, bits)
        if kind[0] == "fixed":
            e = np.diff(np.array(x, dtype=object), order)
        else:
            w.put(11, 4)  # 12 bits a coefficient
            w.put(kind[2], 5)
            for c in kind[1]:
                w.put(c, 12)
            e = [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(kind[1])) >> kind[2]) for i in range(order, len(x))]
        residual(w, e, order, len(x), *kind[-1])


def encode(x, rate=16000, bits=16, size=256, kinds=(("fixed", 2, (4,)),), stereo=0, wasted=0, md5=True, break_at=None):
    """``x``: (n, channels). ``stereo``: 8 to 10 as in the frame header."""
    n, channels = x.shape
    width = -(-bits // 8)
    digest = hashlib.md5(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()).digest() if md5 else bytes(16)
    head = size.to_bytes(2, "big") * 2 + bytes(6) + ((rate << 44) | (channels - 1) << 41 | (bits - 1) << 36 | n).to_bytes(8, "big") + digest
    tool = b"a tool"
    comment = len(tool).to_bytes(4, "little") + tool + bytes(4)
    out = b"fLaC\x00" + len(head).to_bytes(3, "big") + head + b"\x84" + len(comment).to_bytes(3, "big") + comment
    for i, a in enumerate(range(0, n, size)):
        part = x[a : a + size].astype(object)
        how = stereo or channels - 1
        frame = b"\xff\xf8" + bytes([7 << 4, how << 4]) + chr(i).encode() + (len(part) - 1).to_bytes(2, "big")
        frame += bytes([flac.crc8(frame)])
        both = [part[:, c] for c in range(channels)]
        if stereo:
            left, right = both
            side = left - right
            both = {8: [left, side], 9: [side, right], 10: [(left + right) >> 1, side]}[stereo]
        w = Writer()
        for c, v in enumerate(both):
            wide = bits + (1 if (stereo in (8, 10) and c == 1) or (stereo == 9 and c == 0) else 0)
            kind = kinds[(i + c) % len(kinds)]
            subframe(w, v, wide, kind if kind[0] in ("constant", "verbatim") or len(v) % kind[-1][0] == 0 else ("verbatim",), wasted)
        frame += w.bytes()
        out += frame + flac.crc16(frame).to_bytes(2, "big")
    if break_at is not None:
        out = out[:break_at] + bytes([out[break_at] ^ 0x10]) + out[break_at + 1 :]
    return out


def music(n, channels=1, bits=16, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)[:, None]
    x = np.sin(t / (7 + np.arange(channels))) * 0.4 + rng.normal(size=(n, channels)) * 0.02
    return np.rint(x * (1 << (bits - 1))).astype(np.int64)


LPC = ("lpc", [1500, -700, 90], 10, (2,))


@pytest.mark.parametrize(
    ("channels", "bits", "kinds", "stereo", "wasted"),
    [
        (1, 16, [("verbatim",)], 0, 0),
        (1, 8, [("fixed", k, (1,)) for k in range(5)], 0, 0),
        (2, 16, [("fixed", 3, (8,)), LPC], 0, 0),
        (2, 16, [LPC], 8, 0),
        (2, 16, [("fixed", 1, (4,))], 9, 0),
        (2, 24, [("fixed", 2, (4,)), LPC], 10, 0),
        (1, 16, [("fixed", 2, (4, True))], 0, 0),
        (3, 20, [("fixed", 2, (4,))], 0, 3),
    ],
)
def test_bit_exact(channels, bits, kinds, stereo, wasted):
    x = music(1000 + 12, channels, bits) >> wasted << wasted
    got, info = flac.decode(encode(x, bits=bits, kinds=kinds, stereo=stereo, wasted=wasted))
    assert (got == x).all() and (info.rate, info.channels, info.bits, info.samples, info.vendor) == (16000, channels, bits, 1012, "a tool")


def test_constant_and_extremes():
    x = np.full((512, 1), -32768)
    assert (flac.decode(encode(x, kinds=[("constant",)]))[0] == x).all()
    x = np.array([[32767], [-32768]] * 128)
    assert (flac.decode(encode(x, kinds=[("fixed", 4, (1,)), ("lpc", [2047, -2048], 11, (1,))]))[0] == x).all()


def test_broken_streams_raise():
    data = encode(music(1024))
    for at in range(30, len(data), 97):
        with pytest.raises(ValueError):
            flac.decode(data[:at])
    rng = np.random.default_rng(0)
    for at in rng.integers(60, len(data), size=60):
        with pytest.raises(ValueError):
            flac.decode(encode(music(1024), break_at=int(at)))
    assert len(flac.decode(encode(music(0)))[0]) == 0


def test_recordings(spark):
    good, two = encode(music(16000)), encode(music(8000, 2), stereo=10)
    files = [("/a/one.flac", good), ("/a/two.flac", two), ("/a/bad.flac", good[:-100]), ("/a/x.mp3", b"?")]
    got = {r["rec_id"]: r for r in audio.decoded(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert np.allclose(got["one"]["amp"], music(16000)[:, 0] / 32768) and got["one"]["status"] == "ok"
    assert (got["two"]["status"], got["two"]["channels"], got["two"]["bits"], got["two"]["frames"]) == ("short", 2, 16, 8000)
    assert got["bad"]["status"] == "corrupt" and got["bad"]["amp"] is None and got["x"]["status"] == "unsupported"
