"""Vectorised byte-level text kernels over Arrow string columns.

Every kernel works on one contiguous byte buffer that holds many documents, so a batch of texts costs a few numpy
passes instead of a Python loop per word.  Nulls count as empty texts.  Words are maximal runs of bytes other than
space and \\t..\\r, which equals ``[^\\x20\\x09-\\x0D]+`` on the decoded text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_rng = np.random.Generator(np.random.PCG64(20240607))
#: Two independent families of 64-bit polynomial hashes over a random byte alphabet.
SYMBOL = _rng.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD95)
INVERSE = tuple(pow(b, -1, 2**64) for b in BASE)
#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 4096 if n <= 4096 else max(n, SLICE_BYTES + 4096)
        have = np.empty(size, np.uint64)
        have[0], filled = 1, 1
        while filled < size:
            step = min(filled, size - filled)
            np.multiply(have[:step], np.uint64(pow(base, filled, 2**64)), out=have[filled : filled + step])
            filled += step
        if size <= 2 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (in place on a fresh array)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_hash(data: np.ndarray, family: int = 0) -> np.ndarray:
    """Prefix sums from which ``span_hash`` reads the hash of any byte range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(SYMBOL[family][data] * powers(BASE[family], len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0) -> np.ndarray:
    back = powers(INVERSE[family], len(prefix))
    return mix((prefix[end] - prefix[start]) * back[start])


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): text i is ``bytes[starts[i]:starts[i+1]]``; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    n = len(column)
    starts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(starts: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; each holds at least one row."""
    n, lo = len(starts) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def batch_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, starts) for each slice of a column."""
    data, starts = column_bytes(column)
    for lo, hi in slices(starts, limit):
        yield lo, hi, data[starts[lo] : starts[hi]], starts[lo : hi + 1] - starts[lo]


def word_spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every word, in order."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts] = True
    opens = solid.copy()
    opens[1:] &= ~solid[:-1] | edge[1:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:] | edge[1:-1]
    first = np.flatnonzero(opens)
    return first, np.flatnonzero(closes) + 1, np.searchsorted(starts, first, "right") - 1


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)


def shingle_sets(data: np.ndarray, starts: np.ndarray, width: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``width``-word shingles over A-Z lower-cased words.

    A row of fewer words has one shingle, the whole sequence; a row without words has none.
    """
    n = len(starts) - 1
    data = LOWER[data]
    first, last, row = word_spans(data, starts)
    if not len(first):
        return [np.zeros(0, np.uint64)] * n
    words = span_hash(prefix_hash(data), first, last)
    count = row_counts(row, n)
    begin = np.concatenate(([0], np.cumsum(count)))
    weight = powers(0xA0761D6478BD642F, width + 2)
    m = len(words) - width + 1
    whole = np.zeros(max(m, 0), np.uint64)
    for j in range(width if m > 0 else 0):
        whole += words[j : j + m] * weight[j + 1]
    whole = mix(whole)
    out = []
    for i in range(n):
        a, k = int(begin[i]), int(count[i])
        if k >= width:
            out.append(np.unique(whole[a : a + k - width + 1]))
        elif k:
            short = (words[a : a + k] * weight[1 : k + 1]).sum(dtype=np.uint64) + np.uint64(k)
            out.append(mix(np.array([short], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_of(value: bytes | None) -> str:
    return "" if value is None else value.decode("utf-8", "replace")
