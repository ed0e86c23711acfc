"""FLAC frames to samples. A bit stream's Rice codes are found by following precomputed jumps from code to code, then
read all at once; fixed predictors are undone by running sums. Anything that does not fit the format raises ValueError.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format: rates and sizes by code.
_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


@dataclass
class StreamInfo:
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    largest_frame: int
    vendor: str | None
    first_frame: int


def stream_info(data: bytes) -> StreamInfo:
    """The metadata in front of the frames; ``data`` may end after it."""
    if data[:4] != b"fLaC" or len(data) < 42 or data[4] & 0x7F:
        raise ValueError("no FLAC stream")
    body = data[8:42]
    packed = int.from_bytes(body[10:18], "big")
    info = StreamInfo(packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34], int.from_bytes(body[7:10], "big"), None, 0)
    at = 4
    while True:
        if at + 4 > len(data):
            raise ValueError("metadata without an end")
        size, kind = int.from_bytes(data[at + 1 : at + 4], "big"), data[at] & 0x7F
        if kind == 4 and at + 8 <= len(data):
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            info.vendor = data[at + 8 : at + 8 + n].decode("utf-8", "replace") or None
        last, at = data[at] & 0x80, at + 4 + size
        if last:
            info.first_frame = at
            return info


def _crc_table(poly: int, width: int) -> list[int]:
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for i in range(256):
        c = i << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        out.append(c)
    return out


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: bytes) -> int:
    c = 0
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC16[c >> 8 ^ b]
    return c


class _Bits:
    """The bits of some bytes from a position on."""

    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)), 0
        ones = np.flatnonzero(self.bits)
        here = np.searchsorted(ones, np.arange(len(self.bits)))
        self.next_one = np.append(ones, len(self.bits))[here]

    def _room(self, n: int) -> None:
        if self.at + n > len(self.bits):
            raise ValueError("the frame ends early")

    def number(self, n: int, signed: bool = False) -> int:
        self._room(n)
        v = int("".join(map(str, self.bits[self.at : self.at + n].tolist())), 2) if n else 0
        self.at += n
        return v - (1 << n) if signed and n and v >> (n - 1) else v

    def numbers(self, count: int, n: int) -> np.ndarray:
        """``count`` signed numbers of ``n`` bits."""
        self._room(count * n)
        v = self._gathered(self.at + n * np.arange(count), n)
        self.at += count * n
        return v - ((v >> (n - 1) & 1) << n) if n else v

    def _gathered(self, starts: np.ndarray, n: int) -> np.ndarray:
        v = np.zeros(len(starts), dtype=np.int64)
        for j in range(n):
            v = v << 1 | self.bits[starts + j]
        return v

    def unary(self) -> int:
        self._room(1)
        one = int(self.next_one[self.at])
        zeros, self.at = one - self.at, one + 1
        self._room(0)
        return zeros

    def rice(self, count: int, k: int) -> np.ndarray:
        """``count`` Rice codes of parameter ``k``."""
        jump, at, end = (self.next_one + 1 + k).tolist(), self.at, len(self.bits)
        starts = []
        for _ in range(count):
            if at >= end:
                raise ValueError("the frame ends early")
            starts.append(at)
            at = jump[at]
        if at > end:
            raise ValueError("the frame ends early")
        self.at = at
        s = np.array(starts, dtype=np.int64)
        one = self.next_one[s]
        v = (one - s) << k | self._gathered(one + 1, k)
        return v >> 1 ^ -(v & 1)


def _residual(b: _Bits, size: int, order: int) -> np.ndarray:
    method, partitions = b.number(2), 1 << b.number(4)
    if method > 1 or size % partitions or size // partitions < order:
        raise ValueError("residual coding")
    width, out = 4 + method, []
    for i in range(partitions):
        n = size // partitions - (order if i == 0 else 0)
        k = b.number(width)
        out.append(b.numbers(n, b.number(5)) if k == (1 << width) - 1 else b.rice(n, k))
    return np.concatenate(out)


def _restored(warm: np.ndarray, rest: np.ndarray, coefficients: list[int], shift: int) -> np.ndarray:
    x, back = warm.tolist(), coefficients[::-1]
    order = len(back)
    for i, e in enumerate(rest.tolist()):
        x.append(e + (sum(c * v for c, v in zip(back, x[i : i + order], strict=True)) >> shift))
    return np.array(x, dtype=np.int64)


def _subframe(b: _Bits, size: int, bits: int) -> np.ndarray:
    if b.number(1):
        raise ValueError("subframe")
    kind = b.number(6)
    wasted = b.unary() + 1 if b.number(1) else 0
    bits -= wasted
    if kind == 0:
        x = np.full(size, b.number(bits, True), dtype=np.int64)
    elif kind == 1:
        x = b.numbers(size, bits)
    elif 8 <= kind <= 12:
        order = kind - 8
        warm = b.numbers(order, bits)
        x = _residual(b, size, order)
        for k in range(order - 1, -1, -1):  # from the next difference to the k-th, which goes on from that of the first samples
            x = np.diff(warm, k)[-1] + np.cumsum(x)
        x = np.concatenate([warm, x])
    elif kind >= 32:
        order = kind - 31
        warm, precision = b.numbers(order, bits), b.number(4) + 1
        shift = b.number(5, True)
        if precision == 16 or shift < 0:
            raise ValueError("predictor")
        coefficients = [b.number(precision, True) for _ in range(order)]
        x = _restored(warm, _residual(b, size, order), coefficients, shift)
    else:
        raise ValueError("subframe type")
    return x << wasted


def _coded_number(data: bytes, at: int) -> int:
    """Length of the frame or sample number, coded like UTF-8."""
    lead = data[at] if at < len(data) else 0xFF
    n = 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if lead == 0xFF or n == 0 or 0x80 <= lead < 0xC0:
        raise ValueError("frame number")
    return n


def _frame(data: bytes, at: int, info: StreamInfo) -> tuple[np.ndarray, int]:
    """Samples (n, channels) of the frame at ``at``, and where it ends."""
    if at + 6 > len(data) or int.from_bytes(data[at : at + 2], "big") & 0xFFFE != 0xFFF8:
        raise ValueError("no frame here")
    size_code, rate_code, how, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    end = at + 4 + _coded_number(data, at + 4)
    if size_code in (6, 7):
        size, end = int.from_bytes(data[end : end + size_code - 5], "big") + 1, end + size_code - 5
    else:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if 2 <= size_code <= 5 else 256 << (size_code - 8)
    end += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if size_code == 0 or how > 10 or rate_code == 15 or end >= len(data) or crc8(data[at:end]) != data[end]:
        raise ValueError("frame header")
    bits = _BITS.get(bits_code, info.bits) if bits_code else info.bits
    channels = how + 1 if how < 8 else 2
    most = size * channels * (bits + 1) // 8 + 64 * channels + 4096
    b = _Bits(data[end + 1 : end + 1 + most])
    side = {8: 1, 9: 0, 10: 1}.get(how)
    x = [_subframe(b, size, bits + (c == side)) for c in range(channels)]
    if how == 8:
        x[1] = x[0] - x[1]
    elif how == 9:
        x[0] = x[0] + x[1]
    elif how == 10:
        middle = x[0] << 1 | x[1] & 1
        x = [(middle + x[1]) >> 1, (middle - x[1]) >> 1]
    end += 1 + -(-b.at // 8)
    if end + 2 > len(data) or crc16(data[at:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("frame checksum")
    return np.stack(x, axis=1), end + 2


def decode(data: bytes) -> tuple[np.ndarray, StreamInfo]:
    """All samples (n, channels) as integers, held against the stream's own digest where it has one."""
    info = stream_info(data)
    at, parts = info.first_frame, []
    while at < len(data):
        x, at = _frame(data, at, info)
        if x.shape[1] != info.channels:
            raise ValueError("channels change")
        parts.append(x)
    x = np.concatenate(parts) if parts else np.zeros((0, info.channels), dtype=np.int64)
    if info.samples and len(x) != info.samples:
        raise ValueError("samples are missing")
    width = -(-info.bits // 8)
    raw = x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()
    if any(info.md5) and hashlib.md5(raw).digest() != info.md5:
        raise ValueError("digest differs")
    return x, info
