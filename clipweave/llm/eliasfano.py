"""Elias-Fano sequences and packed integers over numpy arrays, which may be memory-mapped."""

from __future__ import annotations

import numpy as np

U, CHUNK = np.uint64, 1 << 16  # arrays are made in pieces, which take little memory beside the result
_BYTE = np.array([[next((i for i in range(8) if b >> i & 1 and bin(b & ((1 << i) - 1)).count("1") == r), 0) for r in range(8)] for b in range(256)], np.int64)


def pack(values: np.ndarray, bits: int) -> np.ndarray:
    """The low bits, so many, of integers, one after the other, in 64-bit words; a word more at the end. Of up to 56 bits, one at most crosses the end of a word."""
    n = len(values)
    out = np.zeros(n * bits // 64 + 2, U)
    for a in range(0, n if bits else 0, CHUNK):
        part = values[a : a + CHUNK].astype(U) & U((1 << bits) - 1)
        off = np.arange(a, a + len(part), dtype=np.int64) * bits
        word, shift = off >> 6, (off & 63).astype(U)
        first = np.nonzero(np.append(True, word[1:] != word[:-1]))[0]
        out[word[first]] |= np.bitwise_or.reduceat(part << shift, first)
        over = np.nonzero(shift + U(bits) > U(64))[0]
        out[word[over] + 1] |= part[over] >> (U(64) - shift[over])
    return out


def unpack(words: np.ndarray, bits: int, at: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(at), U)
    off = at.astype(U) * U(bits)
    word, shift = (off >> U(6)).astype(np.int64), off & U(63)
    high = np.where(shift > 0, words[word + 1] << (U(64) - np.maximum(shift, U(1))), U(0))
    return (words[word] >> shift | high) & U((1 << bits) - 1)


def _select(words: np.ndarray, before: np.ndarray, k: np.ndarray, flip: bool) -> np.ndarray:
    """Position of the k-th one (flip: zero). before: such bits before each word."""
    at = np.searchsorted(before, k, side="right") - 1
    w = words[at]
    w = ~w if flip else w.copy()
    r = k - before[at]
    pos = at.astype(np.int64) * 64
    for width in (32, 16, 8):
        low = np.bitwise_count(w & U((1 << width) - 1)).astype(np.int64)
        go = r >= low
        r = r - low * go
        w = np.where(go, w >> U(width), w)
        pos += width * go
    return pos + _BYTE[(w & U(255)).astype(np.int64), np.minimum(r, 7)]


class EliasFano:
    """A sorted sequence of unsigned integers: packed low bits, and high bits in unary."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.n, self.bits = (int(x) for x in arrays["meta"])
        self.low, self.high, self.ones, self.zeros = (arrays[k] for k in ("low", "high", "ones", "zeros"))

    @staticmethod
    def build(values: np.ndarray, universe: int) -> dict[str, np.ndarray]:
        n = len(values)
        bits = min(56, max(0, (universe // max(n, 1)).bit_length() - 1))
        size = n + (universe >> bits) + 2
        raw = np.zeros((size + 63) // 64 * 64, np.uint8)
        for a in range(0, n, CHUNK):
            top = (values[a : a + CHUNK].astype(U) >> U(bits)).astype(np.int64)
            raw[top + np.arange(a, a + len(top))] = 1
        high = np.packbits(raw, bitorder="little").view(U)
        count = np.bitwise_count(high).astype(np.int64)
        ones = np.concatenate([[0], np.cumsum(count)])[:-1]
        zeros = np.arange(len(high), dtype=np.int64) * 64 - ones
        return {"meta": np.array([n, bits], np.int64), "low": pack(values, bits), "high": high, "ones": ones, "zeros": zeros}

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        return (_select(self.high, self.ones, i, False) - i).astype(U) << U(self.bits) | unpack(self.low, self.bits, i)

    def find(self, x: np.ndarray, steps: int = 4) -> np.ndarray:
        """The position of each value, -1 where it is missing. A value's upper bits lead to a run of ones, most of them short: some steps along it, then a binary search for those whose run is longer."""
        x = x.astype(U)
        out = np.full(len(x), -1)
        if not self.n or not len(x):
            return out
        h, want = (x >> U(self.bits)).astype(np.int64), x & U((1 << self.bits) - 1)
        bit = np.where(h > 0, _select(self.high, self.zeros, np.maximum(h - 1, 0), True) + 1, 0)
        on, at = np.arange(len(x)), bit - h
        for _ in range(steps):
            live = (self.high[bit >> 6] >> (bit & 63).astype(U) & U(1)).astype(bool)
            on, bit, at = on[live], bit[live], at[live]
            if not len(on):
                return out
            got, w = unpack(self.low, self.bits, at), want[on]
            hit = got == w
            out[on[hit]] = at[hit]
            more = got < w
            on, bit, at = on[more], bit[more] + 1, at[more] + 1
        if len(on):
            end = _select(self.high, self.zeros, h[on], True) - h[on]
            out[on] = search(lambda i: unpack(self.low, self.bits, i), at, np.maximum(end, at), want[on])
        return out


def search(get, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Binary search for each x in its own range [lo, hi) of get(positions); -1 where it is missing."""
    lo, end = lo.copy(), hi
    hi = hi.copy()
    on = np.nonzero(lo < hi)[0]
    while len(on):
        mid = (lo[on] + hi[on]) >> 1
        less = get(mid) < x[on]
        lo[on] = np.where(less, mid + 1, lo[on])
        hi[on] = np.where(less, hi[on], mid)
        on = on[lo[on] < hi[on]]
    out = np.full(len(lo), -1, np.int64)
    on = np.nonzero(lo < end)[0]
    out[on] = np.where(get(lo[on]) == x[on], lo[on], -1)
    return out
