"""Numpy views of Arrow text columns, shared by the corpus operators.

A batch of texts is handled as one run of UTF-8 bytes plus offsets, cut into pieces of about half a
megabyte so that the work arrays of a task stay small however many rows a batch has. A single
text is never cut: a piece holds at least one whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 19
#: Words are runs of bytes other than these: space, tab, line feed, vertical tab, form feed, return.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_SECOND = 0xD6E8FEB86659FD93 | 1
#: A worker keeps powers up to this many; for a longer text they are made each time.
_KEPT_POWERS = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(buf: np.ndarray, offs: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive pieces of whole texts."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z; all other bytes as they are."""
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word; for row i the words first[i]:first[i + 1]."""
    if buf.size == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    text = ~_IS_SPACE[buf]
    edge = np.zeros(buf.size + 1, bool)
    edge[offs] = True
    opens = text & edge[:-1]
    opens[1:] |= text[1:] & ~text[:-1]
    closes = text & edge[1:]
    closes[:-1] |= text[:-1] & ~text[1:]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, offs)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0..n and their inverses, modulo 2 ** 64."""
    up, down = _powers.get(base, (np.zeros(0, np.uint64),) * 2)
    if up.size <= n:
        size = max(n + n // 8 + 1, PIECE_BYTES // 2)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=np.uint64))
        up, down = made
        if size <= _KEPT_POWERS:
            _powers[base] = (up, down)
    return up, down


def prefix(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Running sums of values[i] * base ** i, so that any span's polynomial takes two look-ups."""
    out = np.empty(values.size + 1, np.uint64)
    out[0] = 0
    np.cumsum(values.astype(np.uint64, copy=False) * powers(values.size, base)[0][: values.size], out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hash of each span of what prefix() has summed, whatever stands around it."""
    return mix((sums[ends] - sums[starts]) * powers(sums.size, base)[1][starts])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    values = buf.astype(np.uint64)
    values += np.uint64(0x51ED27)
    return span_hash(prefix(values), starts, ends)


def window_hashes(word_hash: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of the `length` words from each start."""
    a = span_hash(prefix(word_hash), starts, starts + length)
    return a, span_hash(prefix(word_hash, _SECOND), starts, starts + length, _SECOND)


def window_starts(first: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The word at which each window of `length` words inside one row starts, and its row."""
    counts = np.maximum(np.diff(first) - length + 1, 0)
    rows = np.repeat(np.arange(counts.size), counts)
    return ranges(first[:-1], counts), rows


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] numbers), starts[1], ... as one array."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(np.asarray(starts) - before, counts)
