"""Vectorised hashing of words, bytes and their windows with NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
POSITION_BITS = U(28)
_POSITION = (U(1) << POSITION_BITS) - U(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """Powers 0..n-1 of the hash base, or of its inverse, modulo 2**64."""
    name = "inverse" if inverse else "base"
    if name not in _tables or len(_tables[name]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        table = np.full(size, _INVERSE if inverse else _BASE, U)
        table[0] = 1
        _tables[name] = np.multiply.accumulate(table)
    return _tables[name][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes; ``span`` reads the hash of any stretch from them."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def span(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (pre[end] - pre[start]) * powers(len(pre), True)[start]


def byte_codes(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD1342543DE82EF95) + U(seed))


def pack(items: list[bytes], limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of about ``limit`` bytes together; a longer item stands alone."""
    start = size = 0
    for i, item in enumerate(items):
        if i > start and size + len(item) > limit:
            yield start, i
            start, size = i, 0
        size += len(item)
    if start < len(items):
        yield start, len(items)


def pieces(batch: pa.RecordBatch, limit: int = 1 << 18, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in neighbouring rows of about ``limit`` bytes of text together; a longer text stands alone."""
    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def word_hashes(items: list[bytes], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words between ASCII white space, and the offsets of each item's words."""
    data = np.frombuffer(b"\n".join(items) + b"\n", np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    pre = prefix(byte_codes(seed)[data])
    hashes = mix(span(pre, starts, ends) + (ends - starts).astype(U) * U(0xA0761D6478BD642F))
    at = np.cumsum([0] + [len(x) + 1 for x in items])
    return hashes, np.searchsorted(starts, at)


def grams(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` neighbouring values, ``k`` a power of two."""
    out, size = values, 1
    while size < k:
        out = out[:-size] * U(pow(_BASE, size, 1 << 64)) + out[size:]
        size *= 2
    return mix(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def super_grams(values: np.ndarray, offsets: np.ndarray, k: int, width: int):
    """Runs of windows that share their least ``k``-gram.

    Windows of ``width`` values stay inside one item. Equal windows have their least k-gram at the
    same place (the leftmost of equals), so a window that occurs twice lies in two runs with the
    same gram. Returns item, first and last window start, place and hash of the gram.
    """
    empty = np.zeros(0, np.int64)
    if len(values) < width:
        return empty, empty, empty, empty, empty.astype(U)
    gram = grams(values, k)
    key = (gram & ~_POSITION) | np.arange(len(gram), dtype=U)
    place = (sliding_min(key, width - k + 1) & _POSITION).astype(np.int64)
    fits = np.diff(offsets) >= width
    change = np.zeros(len(place) + 1, np.int64)
    np.add.at(change, offsets[:-1][fits], 1)
    np.add.at(change, offsets[1:][fits] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(change)[:-1] > 0)
    if not len(at):
        return empty, empty, empty, empty, empty.astype(U)
    place = place[at]
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1))))
    low, high = at[first], at[np.concatenate((first[1:] - 1, [len(at) - 1]))]
    item = np.searchsorted(offsets, low, side="right") - 1
    place = place[first]
    return item, low, high, place, gram[place]


def ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, one after another, and the range each one comes from."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) - first[owner] + np.asarray(starts)[owner], owner
