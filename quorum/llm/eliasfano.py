"""Elias-Fano sequences and quantised logarithms for memory-mapped tries."""

from __future__ import annotations

import numpy as np

STEP = 1 << 16          # elements between two entries of the directory


class EliasFano:
    """A non-decreasing sequence of unsigned integers.

    Of each value the low bits are packed as they are; the high parts are a
    bit vector with a one at ``high + index``, so a value takes about two bits
    more than its low part.  ``directory`` holds the place of every ``STEP``-th
    one, from which a run of values is decoded."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.directory = n, low_bits, low, high, directory

    @classmethod
    def encode(cls, values: np.ndarray) -> "EliasFano":
        v = np.asarray(values, dtype=np.uint64)
        n = len(v)
        top = int(v[-1]) if n else 0
        bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.concatenate([np.packbits(
            ((v[i:i + STEP, None] >> shifts) & np.uint64(1)).astype(np.uint8), axis=None)
            for i in range(0, n, STEP)] or [np.empty(0, np.uint8)]) if bits else np.empty(0, np.uint8)
        ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        flags[ones] = 1
        return cls(n, bits, low, np.packbits(flags), ones[::STEP].copy())

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.directory]

    def block(self, k: int) -> np.ndarray:
        """Values ``k * STEP`` to ``(k + 1) * STEP``."""
        a, b = k * STEP, min((k + 1) * STEP, self.n)
        m = b - a
        first = int(self.directory[k])
        last = int(self.directory[k + 1]) if k + 1 < len(self.directory) else len(self.high) * 8
        flags = np.unpackbits(self.high[first // 8:(last + 7) // 8])
        ones = np.flatnonzero(flags)
        at = ones + first // 8 * 8
        at = at[np.searchsorted(at, first):][:m]
        high = (at - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        start = k * (STEP * self.low_bits // 8)
        raw = np.unpackbits(self.low[start:start + (m * self.low_bits + 7) // 8],
                            count=m * self.low_bits).reshape(m, self.low_bits)
        low = np.zeros(m, dtype=np.uint64)
        for i in range(self.low_bits):
            low |= raw[:, i].astype(np.uint64) << np.uint64(i)
        return high | low

    def values(self) -> np.ndarray:
        out = [self.block(k) for k in range(len(self.directory))]
        return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Successor search: the index of each of the sorted ``keys``, -1
        where its successor is another value.  Decodes each run once."""
        out = np.full(len(keys), -1, dtype=np.int64)
        done = 0
        for k in range(len(self.directory)):
            if done == len(keys):
                break
            run = self.block(k)
            to = int(np.searchsorted(keys, run[-1], side="right"))
            part = keys[done:to]
            if len(part):
                at = np.searchsorted(run, part)
                hit = run[np.minimum(at, len(run) - 1)] == part
                out[done:to][hit] = at[hit] + k * STEP
            done = to
        return out


class Quantised:
    """Numbers as codes of a small codebook: bins of equal population, each
    represented by its mean."""

    def __init__(self, codes: np.ndarray, book: np.ndarray):
        self.codes, self.book = codes, book

    @classmethod
    def fit(cls, x: np.ndarray, bits: int = 8) -> "Quantised":
        if not len(x):
            return cls(np.empty(0, np.uint8), np.zeros(1))
        distinct = np.unique(x)
        if len(distinct) <= 1 << bits:
            return cls(np.searchsorted(distinct, x).astype(np.uint8), distinct)
        cuts = np.unique(np.quantile(x, np.linspace(0, 1, (1 << bits) + 1)[1:-1]))
        codes = np.searchsorted(cuts, x, side="right")
        sums = np.bincount(codes, weights=x, minlength=len(cuts) + 1)
        sizes = np.bincount(codes, minlength=len(cuts) + 1)
        return cls(codes.astype(np.uint8), sums / np.maximum(sizes, 1))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.book[self.codes[at]]
