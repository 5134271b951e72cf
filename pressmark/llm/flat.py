"""Flat views of text columns: one byte buffer and offsets per slice of an Arrow batch.

Every per-text operator of this subpackage works on these slices with numpy, so no
Python object is made per word or per byte. A slice holds about ``SLICE_BYTES`` of
text (a longer text is a slice by itself), which bounds the memory of a task by
its longest text.

Defined cases: a null text is an empty one; an empty batch has no slices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n + 1 offsets of a string column; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, last row + 1, bytes, offsets) with about ``limit`` bytes each."""
    data, offs = text_buffers(column)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << max(0, n - 1).bit_length())
        have = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            while len(have) < size:
                have = np.concatenate([have, have * np.uint64(pow(base, len(have), 2**64))])
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [starts, ends): equal spans, equal hashes."""
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_MIX[data] * powers(len(data)), out=prefix[1:])
        h = (prefix[ends] - prefix[starts]) * powers(len(data) + 1, _INVERSE)[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offs: np.ndarray, white: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and counts per text of the maximal runs of bytes outside ``white``."""
    inside = ~white[data]
    before = np.empty_like(inside)
    if len(inside):
        before[0] = False
        before[1:] = inside[:-1]
        before[offs[:-1][offs[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    if len(inside):
        after[-1] = False
        after[:-1] = inside[1:]
        last = offs[1:] - 1
        after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offs))
    return starts, ends, counts


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and counts per text of its \\n-split lines; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    n = np.diff(np.searchsorted(breaks, offs)) + 1
    first = np.cumsum(n) - n
    starts, ends = np.empty(n.sum(), np.int64), np.empty(n.sum(), np.int64)
    is_first = np.zeros(len(starts), bool)
    is_first[first] = True
    starts[first] = offs[:-1]
    starts[~is_first] = breaks + 1
    is_last = np.zeros(len(starts), bool)
    is_last[first + n - 1] = True
    ends[first + n - 1] = offs[1:]
    ends[~is_last] = breaks
    return starts, ends, n


def totals(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over the spans [starts, ends)."""
    prefix = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=prefix[1:], dtype=np.int64)
    return prefix[ends] - prefix[starts]


def code_points(data: np.ndarray) -> np.ndarray:
    """True where a code point starts in UTF-8 bytes."""
    return (data & 0xC0) != 0x80
