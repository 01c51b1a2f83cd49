"""Vectorised text kernels over Arrow string columns: many documents at once, no per-word Python.

A chunk of documents is one ``uint8`` array plus offsets.  Words, lines and byte windows
get 64-bit fingerprints from one prefix sum of ``byte * base**i`` (mod 2**64): the
fingerprint of any slice is the difference of two prefixes times an inverse power.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_ODD = [0xBF58476D1CE4E5B9 | 1, 0x94D049BB133111EB | 1, 0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1, 0xE7037ED1A0B428DB | 1, 0x8EBC6AF09C88C6E3 | 1, 0x589965CC75374CC3 | 1, 0x1D8E4E27C47D124F | 1]
_powers: list[np.ndarray] = []

#: Bytes of documents that are worked on at once; a larger document is a chunk of its own, and
#: the counts that allow it take such a document in parts (``parts``).
CHUNK_BYTES = 512 << 10

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of ``h``."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES * 3 // 2)
        both = []
        for b in (_BASE, _INVERSE):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        _powers[:] = both
    return _powers[0][:n], _powers[1][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of documents of about ``limit`` bytes."""
    limit = limit or CHUNK_BYTES
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def cut_long(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray, limit: int = 0) -> np.ndarray:
    """Offsets with more edges inside documents of over ``limit`` bytes, each just after a byte of ``ends``.

    Where such bytes are further apart than ``limit``, so are the edges.
    """
    limit = limit or CHUNK_BYTES
    long = np.flatnonzero(np.diff(offsets) > limit)
    more: list[int] = []
    for d in long.tolist():
        at, end = int(offsets[d]), int(offsets[d + 1])
        while end - at > limit:
            near = np.flatnonzero(ends[data[at : at + limit]])
            if len(near):
                at += int(near[-1]) + 1
            else:
                far = at + limit
                while far < end and not ends[data[far : far + limit]].any():
                    far += limit
                if far >= end:
                    break
                at = far + int(np.argmax(ends[data[far : far + limit]])) + 1
            if at < end:
                more.append(at)
    return np.sort(np.concatenate([offsets, np.array(more, np.int64)])) if more else offsets


def parts(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, offsets, rows) of documents and, where one is long, of its parts; ``rows`` says whose they are."""
    fine = cut_long(data, offsets, ends)
    if fine is offsets:
        yield data, offsets, np.arange(len(offsets) - 1)
        return
    # An edge opens the last document that begins at or before it; empty documents have no bytes to count.
    owner = np.searchsorted(offsets, fine[:-1], "right") - 1
    for i, j, part, off in chunks(data, fine):
        yield part, off, owner[i:j]


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the fingerprint polynomial, one longer than the data."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[: len(data)], out=out[1:])
    return out


def slices(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of byte slices; slices of equal bytes have equal ones."""
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U) * U(_ODD[7]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes other than ASCII white space, within its row."""
    ink = ~SPACE[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start = ink.copy()
    start[1:] &= ~ink[:-1] | edge[1:-1]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:-1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def word_prints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of every word; long documents are taken in parts, cut at white space."""
    found = []
    for part, off, rows in parts(data, offsets, SPACE):
        s, e, row = words(part, off)
        found.append((slices(prefix(part), s, e), rows[row]))
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def grams(h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of n words in a row, and where each starts; none crosses a row."""
    k = len(h) - n + 1
    if k <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:k] == row[n - 1 :])
    g = np.zeros(k, U)
    for j in range(n):
        g += h[j : j + k] * U(_ODD[j])
    return mix(g[at]), at


def in_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Fingerprints that are equal for equal values of one row only."""
    return mix(h ^ mix(row.astype(U) * U(_ODD[6]) + U(1)))


def repeated(key: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(key), bool)
    twice = np.unique(twice)
    return twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key
