"""Words, hashes and minimizers of a whole batch of texts at once, as numpy arrays over the Arrow buffers.

A text is its UTF-8 bytes; a null text has none. Words are maximal runs of bytes other than space and 0x09-0x0D.
Hashes are polynomials over 64 bits with random byte codes, finished by a mixing step; they depend on content alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2**64; kept and grown in the worker."""
    found = _powers.get(base)
    if found is None or len(found) <= n:
        found = np.full(max(n + 1, 1 << 12), base, np.uint64)
        found[0] = 1
        np.multiply.accumulate(found, out=found)
        if len(found) <= 4 * BLOCK_BYTES:
            _powers[base] = found
    return found


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits depend on all bits of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    size = np.dtype(kind).itemsize
    off = np.frombuffer(offsets, kind, len(column) + 1, column.offset * size).astype(np.int64) if offsets and len(column) else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data and data.size else np.zeros(0, np.uint8)), off


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for consecutive rows of about `limit` bytes; a row is never cut."""
    data, off = texts(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def rows_of(off: np.ndarray) -> np.ndarray:
    """Row number of every item, from offsets."""
    return np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(off))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and offsets of the rows' words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(~blank[1:-1] & (blank[:-2] | edge[:-1]))
    end = np.flatnonzero(~blank[1:-1] & (blank[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(start, off).astype(np.int64)


def prefix(data: np.ndarray) -> np.ndarray:
    """Running polynomial of bytes, for `span_hash`."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * _power(_BYTE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, equal for equal content wherever it lies."""
    inverse = _power(pow(_BYTE, -1, 1 << 64), len(run))
    return mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix(data), start, end)


def run_of_words(h: np.ndarray) -> np.ndarray:
    """Running polynomial of word hashes, for `sequence_hash`."""
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_WORD, len(h))[: len(h)], out=out[1:])
    return out


def sequence_hash(run: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each sequence of words [start, end)."""
    inverse = _power(pow(_WORD, -1, 1 << 64), len(run))
    return mix((run[end] - run[start]) * inverse[start] + (end - start).astype(np.uint64))


def windows(h: np.ndarray, woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word of every window of k words of one row, and the windows' hashes."""
    first = starts_of(woff, k)
    return first, sequence_hash(run_of_words(h), first, first + k)


def starts_of(off: np.ndarray, k: int) -> np.ndarray:
    """Where windows of k items start that stay within one row."""
    n = int(off[-1])
    if n < k:
        return np.zeros(0, np.int64)
    row = rows_of(off)
    return np.flatnonzero(row[k - 1 :] == row[: n - k + 1])


def least(key: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive keys."""
    out, have = key, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """For each w consecutive hashes the place of the leftmost least, by the upper 40 bits."""
    at = least((h & ~U((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64), w) if len(h) < 1 << 24 else None
    if at is not None:
        return (at & U((1 << 24) - 1)).astype(np.int64)
    high = h >> U(24)  # a text of over 16 million items
    small = least(high, w)
    out, base = np.empty(len(small), np.int64), np.arange(len(small))
    out[:] = -1
    for d in range(w):
        hit = (out < 0) & (high[d : d + len(small)] == small)
        out[hit] = base[hit] + d
    return out


def row_first(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Whether an item is the first of its row with its key."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.lexsort((np.arange(len(key)), key, row))
        k, r = key[order], row[order]
        out[order] = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])]
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def lists(values: np.ndarray, off: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column from flat values and offsets."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values, kind))
