"""Vectorised word, line and n-gram hashing over Arrow string columns.

Texts stay in their UTF-8 buffers: a slice of rows is one byte array, words
are runs of bytes other than ``\\x20\\x09-\\x0D`` (all ASCII, so no character
is cut), and every hash comes from prefix sums, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = 0xD6E8FEB86659FD93 | 1

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (splitmix64): spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (kept, grown by doubling)."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length() if n > 1 else 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[base] = (out[0], out[1])
    return have


def _prefix(values: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_tables(base, len(values) + 1)
    cum = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], dtype=np.uint64, out=cum[1:])
    return cum, down


def _ranges(cum: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((cum[b] - cum[a]) * down[a] + (b - a).astype(np.uint64))


class Slice:
    """Words of consecutive rows: ``ws``/``we`` byte ranges, ``dw`` word offsets by row."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int):
        self.data, self.off, self.first, self.rows = data, off, first, len(off) - 1
        ns = ~IS_SPACE[data]
        start, end = ns.copy(), ns.copy()
        if len(data):
            start[1:] &= ~ns[:-1]
            end[:-1] &= ~ns[1:]
            full = off[:-1] < off[1:]
            a, b = off[:-1][full], off[1:][full] - 1
            start[a] = ns[a]
            end[b] = ns[b]
        self.nonspace = ns
        self.ws = np.flatnonzero(start)
        self.we = np.flatnonzero(end) + 1
        self.dw = np.searchsorted(self.ws, off)
        self.word_row = np.repeat(np.arange(self.rows), np.diff(self.dw))
        self._byte_prefix = None
        self._word_prefix = None

    def byte_ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the byte ranges [a, b)."""
        if self._byte_prefix is None:
            self._byte_prefix = _prefix(_BYTE[self.data], _BASE)
        return _ranges(*self._byte_prefix, a, b)

    def word_ranges(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the word sequences [a, b), whatever white space is between."""
        if self._word_prefix is None:
            self._word_prefix = _prefix(self.byte_ranges(self.ws, self.we), _GRAM)
        return _ranges(*self._word_prefix, a, b)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-word windows inside one row, and their hashes."""
        at = np.arange(len(self.ws))
        at = at[at + n <= self.dw[1:][self.word_row]]
        return at, self.word_ranges(at, at + n)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array by row."""
        cum = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(flags, out=cum[1:])
        return cum[self.off[1:]] - cum[self.off[:-1]]


def slices(col: pa.Array, max_bytes: int = 2_000_000, lower: bool = False, table: np.ndarray | None = None) -> Iterator[Slice]:
    """Consecutive row slices of a string column, each of about ``max_bytes``
    (one longer text is one slice); null reads as empty. ``table`` maps bytes
    first (``lower``: A-Z to a-z)."""
    table = LOWER if lower else table
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or not pa.types.is_string(col.type):
        col = col.cast(pa.large_string())
    col = pc.fill_null(col, "") if col.null_count else col
    n = len(col)
    if n == 0:
        return
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    buffers = col.buffers()
    off = np.frombuffer(buffers[1], kind)[col.offset:col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, side="right")) - 1)
        data = raw[off[i]:off[j]]
        yield Slice(data if table is None else table[data], off[i:j + 1] - off[i], i)
        i = j


def cover(starts: np.ndarray, length: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of ``length`` starting at ``starts``."""
    diff = np.zeros(total + 1, np.int64)
    np.add.at(diff, starts, 1)
    np.add.at(diff, np.minimum(starts + length, total), -1)
    return np.cumsum(diff[:-1]) > 0
