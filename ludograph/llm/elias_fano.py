"""Elias-Fano coding of rising integers: about 2 + log2(range / count) bits each, with a select structure.

The high part of value i is the place of the i-th set bit minus i; the low bits lie packed beside it. Every
``EVERY``-th set bit's place is kept as a 32-bit number, so one value is found by scanning a short stretch.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 256
_HEAD = struct.Struct("<QqBQQ")  # count, first value, low width, bytes of low bits, bytes of high bits


class EliasFano:
    def __init__(self, count: int, first: int, width: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.count, self.first, self.width = count, first, width
        self.low, self.high, self.places = low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """Code int64 values that never fall."""
        n = len(values)
        if not n:
            return cls(0, 0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        first = int(values[0])
        rest = values.astype(np.int64).view(np.uint64) - np.uint64(first % (1 << 64))
        width = max(0, (int(rest[-1]) // n).bit_length() - 1)
        lows = []
        for at in range(0, n, 1 << 16):  # whole bytes a piece
            piece = rest[at : at + (1 << 16), None] >> np.arange(width, dtype=np.uint64)
            lows.append(np.packbits((piece & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little"))
        bits = (rest >> np.uint64(width)).astype(np.int64) + np.arange(n)
        if int(bits[-1]) >= 1 << 32:
            raise ValueError("too long for 32-bit places")
        flags = np.zeros(int(bits[-1]) + 1, dtype=np.uint8)
        flags[bits] = 1
        low = np.concatenate(lows)
        return cls(n, first, width, low, np.packbits(flags, bitorder="little"), bits[::EVERY].astype(np.uint32))

    def _lows(self, start: int, stop: int) -> np.ndarray:
        if not self.width:
            return np.zeros(stop - start, dtype=np.uint64)
        a, b = start * self.width, stop * self.width
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        weights = np.uint64(1) << np.arange(self.width, dtype=np.uint64)
        return (bits.reshape(-1, self.width).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def select(self, start: int, stop: int | None = None) -> np.ndarray:
        """Values start up to stop (one if stop is not given), as int64."""
        stop = start + 1 if stop is None else min(stop, self.count)
        if not 0 <= start < stop:
            return np.zeros(0, np.int64)
        begin = int(self.places[start // EVERY])
        last = stop - 1
        end = int(self.places[last // EVERY + 1]) if last // EVERY + 1 < len(self.places) else len(self.high) * 8
        flags = np.unpackbits(self.high[begin // 8 : end // 8 + 1], bitorder="little")
        ones = np.flatnonzero(flags) + begin // 8 * 8
        ones = ones[ones >= begin][start % EVERY :][: stop - start]
        high = (ones - np.arange(start, stop)).astype(np.uint64) << np.uint64(self.width)
        return ((high | self._lows(start, stop)) + np.uint64(self.first % (1 << 64))).view(np.int64)

    def dumps(self) -> bytes:
        head = _HEAD.pack(self.count, self.first, self.width, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.places.astype("<u4").tobytes()

    @classmethod
    def loads(cls, data: bytes) -> EliasFano:
        count, first, width, low, high = _HEAD.unpack_from(data)
        at = _HEAD.size
        raw = np.frombuffer(data, dtype=np.uint8)
        places = np.frombuffer(data, dtype="<u4", offset=at + low + high)
        return cls(count, first, width, raw[at : at + low], raw[at + low : at + low + high], places)
