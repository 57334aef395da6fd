"""Elias-Fano coding of a non-decreasing sequence, with select.

Each value is cut into ``low`` low bits, stored side by side, and the rest, stored in unary in one
bit vector: value i sets bit ``(value >> low) + i``. That takes about ``2 + log2(universe / n)``
bits a value. Every ``SAMPLE``-th set bit's place is kept, as a 32-bit number, so ``select`` scans a
short stretch only. A sequence has fewer than 2**30 values.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
#: Set bits of a byte, and the place of its k-th.
_SET = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_ONES, _KTH = _SET.sum(axis=1).astype(np.int64), np.argsort(-_SET.astype(np.int64), axis=1, kind="stable")
_HEAD = struct.Struct("<QQB7xQQ")  # values, universe, low bits, bytes of low part, bytes of high part


def _low_width(n: int, universe: int) -> int:
    return max(0, (universe // n).bit_length() - 1) if n else 0


def dump(values: np.ndarray, universe: int) -> bytes:
    """``values``: non-decreasing, from 0 to ``universe``."""
    values = np.asarray(values, dtype=np.uint64)
    n, low = len(values), _low_width(len(values), int(universe))
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros((int(universe) >> low) + n + 1, dtype=np.uint8)
    high[places] = 1
    highs = np.packbits(high, bitorder="little").tobytes()
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(n, int(universe), low, len(lows), len(highs)) + lows + highs + samples


class EliasFano:
    """Reads what ``dump`` wrote."""

    def __init__(self, data: bytes | memoryview, at: int = 0):
        self.n, self.universe, self.low, n_lows, n_highs = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        self._lows = np.frombuffer(data, np.uint8, n_lows, at)
        self._highs = np.frombuffer(data, np.uint8, n_highs, at + n_lows)
        n_samples = -(-self.n // SAMPLE)
        self._samples = np.frombuffer(data, "<u4", n_samples, at + n_lows + n_highs).astype(np.int64)
        self.end = at + n_lows + n_highs + 4 * n_samples

    def select(self, i: int | np.ndarray) -> int | np.ndarray:
        """The i-th value, from 0, or the values at an array of places: reads from the sample before the first to the one after the last."""
        at = np.atleast_1d(np.asarray(i, dtype=np.int64))
        if not len(at):
            return np.zeros(0, np.int64)
        if at.min() < 0 or at.max() >= self.n:
            raise IndexError(i)
        lo, hi = int(at.min()) // SAMPLE, int(at.max()) // SAMPLE + 1
        begin = int(self._samples[lo]) // 8
        end = int(self._samples[hi]) // 8 + 1 if hi < len(self._samples) else len(self._highs)
        part = self._highs[begin:end].copy()
        part[0] &= 0xFF << int(self._samples[lo]) % 8 & 0xFF  # bits before the sample belong to earlier values
        ones = np.cumsum(_ONES[part])
        rank = at - lo * SAMPLE
        byte = np.searchsorted(ones, rank, side="right")
        bit = _KTH[part[byte], rank - ones[byte] + _ONES[part[byte]]]
        out = ((begin + byte) * 8 + bit - at).astype(np.uint64) << np.uint64(self.low)
        for k in range(self.low):
            place = at * self.low + k
            out |= (self._lows[place >> 3].astype(np.uint64) >> (place & 7).astype(np.uint64) & np.uint64(1)) << np.uint64(k)
        out = out.astype(np.int64)  # beyond 2**63 the same bits
        return out if np.ndim(i) else int(out.view(np.uint64)[0])
