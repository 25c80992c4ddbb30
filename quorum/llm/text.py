"""Words of Arrow text columns as numpy arrays, without Python strings.

A column's UTF-8 bytes are cut into words by a byte table, and each word is
hashed (64 bits) with array arithmetic; work memory is bounded by
``HASH_BYTES`` whatever a text's length is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

HASH_BYTES = 1 << 19
BLOCK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: words [^\x20\x09-\x0D]+
NOT_WHITE = np.ones(256, dtype=bool)
NOT_WHITE[[0x20, *range(0x09, 0x0E)]] = False

#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z, all of non-ASCII
WORD_CHARS = np.zeros(256, dtype=bool)
WORD_CHARS[0x30:0x3A] = WORD_CHARS[0x61:0x7B] = True
WORD_CHARS[0x80:] = True

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.empty(0, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash's base, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        p = np.full(max(64, 1 << int(n - 1).bit_length()), _BASE, dtype=np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its row offsets; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(off):
        off = np.zeros(1, dtype=np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``limit`` bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def word_spans(buf: np.ndarray, offsets: np.ndarray,
               table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, words per row); no word crosses a row's end."""
    n = len(buf)
    rows = len(offsets) - 1
    if not n:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(rows, dtype=np.int64)
    inside = table[buf]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[first[first > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    per_row = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, per_row


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    out = np.empty(len(starts), dtype=np.uint64)
    lens = ends - starts
    total = np.concatenate(([0], np.cumsum(lens)))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(total, total[a] + HASH_BYTES, side="right")) - 1)
        ln = lens[a:b]
        at = total[a:b] - total[a]
        pos = np.arange(total[b] - total[a]) - np.repeat(at, ln)
        chars = buf[pos + np.repeat(starts[a:b], ln)]
        out[a:b] = np.add.reduceat(_BYTE[chars] * powers(int(ln.max()))[pos], at)
        out[a:b] += ln.astype(np.uint64) * _BASE
        a = b
    return mix(out)


def hash_of(word: bytes) -> int:
    """The hash that :func:`word_hashes` gives to one word."""
    b = np.frombuffer(word, dtype=np.uint8)
    return int(word_hashes(b, np.array([0]), np.array([len(b)]))[0])
