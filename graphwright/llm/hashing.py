"""Vectorised 64-bit hashing of bytes, words and windows (NumPy, wrap-around arithmetic).

Rabin-Karp hashes are polynomials over mixed symbols modulo 2**64; windows of any length are
put together from power-of-two levels, so each costs a few array operations per symbol.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
MASK64 = (1 << 64) - 1
#: Separators of words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def release() -> None:
    """Freed memory goes back to the system: Python workers stay alive between tasks, and idle ones count beside those at work."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def mix(x: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Bijective avalanche of 64-bit values."""
    x = x.copy() if out is None else out
    x ^= x >> U64(31)
    x *= U64(0x7FB5D329728EA185)
    x ^= x >> U64(27)
    x *= U64(0x81DADEF4BC2DD44D)
    x ^= x >> U64(33)
    return x


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[list(SEPARATORS)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64; kept and grown per process."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        step = np.full(size, base & MASK64, dtype=U64)
        step[0] = 1
        _powers[base] = have = np.multiply.accumulate(step)
    return have[:n]


INVERSE = pow(BASE, -1, 1 << 64)


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    flags = np.zeros(len(data) + 2, np.int8)
    np.logical_not(IS_SEPARATOR[data], out=flags[1:-1].view(bool))
    edges = np.diff(flags)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, wherever it stands."""
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_SYMBOLS[data] * powers(BASE, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers(INVERSE, len(data) + 1)[starts]
    h ^= (ends - starts).astype(U64) * U64(0xA0761D6478BD642F)
    return mix(h, h)


class Rolling:
    """Rabin-Karp hashes of all windows of a symbol array; at(length, positions) or all of them."""

    def __init__(self, symbols: np.ndarray, longest: int):
        self.levels = [symbols]
        size = 1
        while 2 * size <= longest and len(self.levels[-1]) > size:
            last = self.levels[-1]
            self.levels.append(last[:-size] * U64(pow(BASE, size, 1 << 64)) + last[size:])
            size *= 2

    def at(self, length: int, where: np.ndarray | None = None) -> np.ndarray:
        n = len(self.levels[0]) - length + 1
        out, offset = None, 0
        for level in range(length.bit_length() - 1, -1, -1):
            if length >> level & 1:
                values = self.levels[level]
                part = values[offset : offset + n] if where is None else values[where + offset]
                out = part.copy() if out is None else out * U64(pow(BASE, 1 << level, 1 << 64)) + part
                offset += 1 << level
        return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of so many values."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if width > size else out
