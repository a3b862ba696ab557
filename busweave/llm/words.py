"""Words of texts as hashes, computed for whole Arrow columns at once.

A word is a maximal run of bytes other than space and 0x09-0x0D; UTF-8 keeps
those bytes for themselves.  Work goes in slices of a few megabytes, so memory
is bounded by one slice or by the longest single text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 18
SLICE_BYTES = 1 << 19


class Words(NamedTuple):
    """Word hashes of a slice; document i owns hash[first[i]:first[i + 1]]."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    data: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place)."""
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    row = np.full(n, base, np.uint64)
    row[:1] = 1
    return np.multiply.accumulate(row)


def _byte_values(fold: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    if fold:
        table[65:91] = table[97:123]
    return table


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES):
    """Row ranges of a batch with about ``most`` bytes of text each."""
    lengths = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    part = (np.cumsum(lengths) - lengths) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip([0, *edges], [*edges, len(lengths)], strict=True):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one run of UTF-8 bytes and the places where they begin and end."""
    column = pa.concat_arrays([texts.cast(pa.large_string()).fill_null("")])
    _, offsets, data = column.buffers()
    cuts = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return body[cuts[0] : cuts[-1]], cuts - cuts[0]


def words_of(texts: pa.Array, fold: bool = False) -> Words:
    """Hashes and byte ranges of all words; ``fold`` lower-cases A-Z first."""
    body, cuts = text_bytes(texts)
    n = len(body)
    space = _SPACE[body]
    edge = np.zeros(n + 1, bool)
    edge[cuts] = True
    start, stop = ~space, ~space
    start[1:] &= space[:-1] | edge[1:n]
    stop[:-1] &= space[1:] | edge[1:n]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    first = np.searchsorted(starts, cuts)
    return Words(range_hashes(body, starts, stops, fold), first, starts, stops, body)


def range_hashes(body: np.ndarray, starts: np.ndarray, stops: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hashes of ascending, disjoint byte ranges from prefix sums over blocks of bytes."""
    table = _byte_values(fold)
    power, inverse = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(stops, low + _BLOCK - 1, "right")))
        size = stops[j - 1] - low
        if size >= len(power):
            power, inverse = _powers(_BASE, size + 1), _powers(_INVERSE, size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(table[body[low : low + size]] * power[:size], out=sums[1:])
        a, b = starts[i:j] - low, stops[i:j] - low
        out[i:j] = (sums[b] - sums[a]) * inverse[a]
        i = j
    return mix(out)


def windows(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Unmixed hash of every run of ``width`` values (rows may cross documents)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= np.uint64(base)
        out += values[j : j + n]
    return out
