"""Words and word hashes of a batch of texts, computed over one flat byte buffer.

A word is a maximal run of characters other than space and the controls \\t to \\r, with
A-Z lower-cased.  Separators are single bytes in UTF-8, so bytes are as good as characters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a finaliser of shifts and odd multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_powers = {"n": 0, "up": None, "down": None}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n; kept between batches."""
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        up = np.full(size, BASE, dtype=np.uint64)
        down = np.full(size, INVERSE, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _powers["up"][:n], _powers["down"][:n]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; NULL is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.empty(0, np.uint8)
    return raw, offsets - (offsets[0] if len(offsets) else 0)


# For word matching that does not mind punctuation: every ASCII byte but letters and digits.
PUNCTUATED = np.ones(256, dtype=bool)
PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def word_bounds(raw: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of all words, and the first word of each row (n + 1)."""
    gap = separator[raw]
    edge = np.zeros(len(raw) + 1, dtype=bool)
    edge[offsets] = True  # a row's end also ends its last word
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = True
        before[1:] = gap[:-1]
    starts = np.flatnonzero(~gap & (before | edge[:-1]))
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[-1] = True
        after[:-1] = gap[1:]
    ends = np.flatnonzero(~gap & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """One 64-bit value per word, the same for the same bytes in any row and any process."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(BYTE_VALUE[LOWER[raw] if lower else raw] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def batches(column: pa.Array, most_bytes: int = 1 << 20):
    """Cut a string column into slices of about so many bytes, one row at least."""
    lengths = np.diff(flat_bytes(column)[1])
    start = 0
    while start < len(column):
        stop = start + max(1, int(np.searchsorted(np.cumsum(lengths[start:]), most_bytes, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop
