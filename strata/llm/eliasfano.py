"""Elias-Fano codes of non-decreasing integers, with sampled select."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQQIIQQ")
#: One value in so many has its place in the bit vector noted, in 32 bits; a shard has fewer than 2^32 places.
SAMPLE = 256


class EliasFano:
    """n values in [low, low + span]: ``bits`` low bits each, the high parts as ones in a unary bit vector.

    Takes about 2 + log2(span / n) bits a value.  ``select(i)`` reads one value: from the noted place of
    the last sampled one it counts set bits byte by byte; ``all()`` decodes everything at once.
    """

    def __init__(self, n: int, low: int, span: int, bits: int, lows: np.ndarray, highs: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.span, self.bits, self.lows, self.highs, self.samples = n, low, span, bits, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(0, 0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low = int(values[0])
        rest = (values - low).astype(np.uint64)
        span = int(rest[-1])
        bits = max(0, (span // n).bit_length() - 1) if span else 0
        lows = np.zeros(0, np.uint8)
        if bits:
            each = (rest[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            lows = np.packbits(each.astype(np.uint8).ravel(), bitorder="little")
        places = ((rest >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        vector = np.zeros(int(places[-1]) + 1, np.uint8)
        vector[places] = 1
        return cls(n, low, span, bits, lows, np.packbits(vector, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.bits):
            at = i * self.bits + k
            value |= (int(self.lows[at >> 3]) >> (at & 7) & 1) << k
        return value

    def select(self, i: int) -> int:
        """Value i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place >> 3
        byte = int(self.highs[at]) >> (place & 7) << (place & 7)
        while (ones := byte.bit_count()) <= left:
            left -= ones
            at += 1
            byte = int(self.highs[at])
        for _ in range(left):
            byte &= byte - 1
        place = at * 8 + (byte & -byte).bit_length() - 1
        return self.low + ((place - i) << self.bits | self._low(i))

    def all(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        out = (places - np.arange(self.n)) << self.bits
        if self.bits:
            each = np.unpackbits(self.lows, bitorder="little")[: self.n * self.bits].reshape(self.n, self.bits)
            out = out | (each.astype(np.int64) << np.arange(self.bits)).sum(1)
        return out + self.low

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(self.n, self.low & 0xFFFFFFFFFFFFFFFF, self.span, self.bits, len(self.samples), len(self.lows), len(self.highs))
        return head + self.samples.astype("<u4").tobytes() + self.lows.tobytes() + self.highs.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The code that stands at a place, and where it ends."""
        n, low, span, bits, samples, lows, highs = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        parts = []
        for dtype, size in (("<u4", samples), (np.uint8, lows), (np.uint8, highs)):
            parts.append(np.frombuffer(data, dtype, size, at))
            at += size * np.dtype(dtype).itemsize
        return cls(n, low - (1 << 64) if low >> 63 else low, span, bits, parts[1], parts[2], parts[0]), at
