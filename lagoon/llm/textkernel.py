"""Vectorised byte-level text kernels over Arrow string buffers.

All functions take the UTF-8 bytes of many rows laid end to end (``data``) and row ``offsets``, so a
batch is tokenised and hashed without a Python string per word. Work arrays are made for at most
``CHUNK`` bytes at a time, cut where no word is cut, so that memory stays bounded for long texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK = 1 << 19
LONG = 64
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, elementwise on uint64."""
    z = x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
    z ^= z >> U64(30)
    z *= U64(0xBF58476D1CE4E5B9)
    z ^= z >> U64(27)
    z *= U64(0x94D049BB133111EB)
    z ^= z >> U64(31)
    return z


_TABLE = mix(np.arange(256, dtype=U64), 7)  # a 64-bit value for each byte
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n + 1:
        size = max(n + 1, CHUNK + 1)
        _POWERS[:] = []
        for base in (_BASE, _INV):
            p = np.full(size, U64(base), dtype=U64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    """True for the bytes that belong to words, given the byte ranges that separate them."""
    keep = np.ones(256, dtype=bool)
    for lo, hi in ranges:
        keep[lo : hi + 1] = False
    return keep


#: words ``[^\x20\x09-\x0D]+``
SPACED = separators([(0x20, 0x20), (0x09, 0x0D)])
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(data uint8, offsets int64) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, dat = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if dat is None:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(dat, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def from_strings(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return buffers(pa.array(texts, type=pa.large_string()))


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased."""
    return _LOWER[data]


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and each row's first word (len rows + 1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    m = word[data]
    edge = np.empty(n, dtype=bool)
    edge[0] = m[0]
    np.logical_and(m[1:], ~m[:-1], out=edge[1:])
    heads = offsets[:-1][np.diff(offsets) > 0]
    edge[heads] = m[heads]
    starts = np.flatnonzero(edge)
    np.logical_and(m[:-1], ~m[1:], out=edge[:-1])
    edge[-1] = m[-1]
    tails = heads[1:] - 1
    edge[tails] = m[tails]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over mapped bytes, by prefix sums, then mixed.

    Words above ``LONG`` bytes, which are few, are hashed one by one with another function: there are
    long words of two letters that every such polynomial modulo 2^64 takes for equal.
    """
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = int(np.searchsorted(ends, base + CHUNK, side="right"))
        j = max(j, i + 1)
        stop = int(ends[j - 1])
        n = stop - int(base)
        up, down = _powers(n)
        acc = np.zeros(n + 1, dtype=U64)
        part = _TABLE[data[base:stop]]
        part *= up[:n]
        np.cumsum(part, out=acc[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (acc[e] - acc[s]) * down[s] + (e - s).astype(U64)
        i = j
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes())
    return mix(out, 11)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size``-word shingles of each row, and each row's first one (len rows + 1).

    A row with fewer words has its whole sequence as one; a row without words has none.
    """
    counts = np.diff(first)
    n_of = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(n_of)])
    out = np.empty(int(begin[-1]), dtype=U64)
    full = np.flatnonzero(counts >= size)
    if len(words) >= size and len(full):
        total = len(words) - size + 1
        acc = np.zeros(total, dtype=U64)
        for k in range(size):
            acc *= U64(0xD1342543DE82EF95)
            acc += words[k : k + total]
            acc ^= acc >> U64(29)
        keep = np.ones(total, dtype=bool)
        # a window that begins among a row's last size - 1 words runs into the next row
        edges = first[1:][counts > 0]
        lows = np.maximum(edges - (size - 1), first[:-1][counts > 0])
        for k in range(size - 1):
            at = lows + k
            at = at[(at < edges) & (at < total)]
            keep[at] = False
        good = acc[keep]
        slot = np.ones(int(begin[-1]), dtype=bool)
        short = np.flatnonzero((counts > 0) & (counts < size))
        slot[begin[short]] = False
        out[slot] = good
    for c in range(1, size):
        rows = np.flatnonzero(counts == c)
        h = np.full(len(rows), (c * 0xA24BAED4963EE407) & (2**64 - 1), dtype=U64)
        for k in range(c):
            h = mix(h + words[first[rows] + k], 3)
        out[begin[rows]] = h
    return mix(out, 5), begin


def slices(offsets: np.ndarray, limit: int = CHUNK) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, at least a row."""
    out, i, n = [], 0, len(offsets) - 1
    while i < n:
        j = max(int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1, i + 1)
        out.append((i, min(j, n)))
        i = j
    return out
