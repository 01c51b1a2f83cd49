"""The public pre-tokenisation pattern over bytes, vectorised, and a growing word table.

``starts`` finds where each match of the pattern begins:

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Matches tile a text, so the starts say everything.  Bytes of one character share a class.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from . import kernel as K

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: White space beyond ASCII, as Unicode's White_Space property has it (fixed values).
_WIDE_SPACE = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_tables: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """Class of every code point."""
    if "all" not in _tables:
        t = np.full(0x110000, OTHER, np.uint8)
        for cp in range(0x110000):
            c = unicodedata.category(chr(cp))[0]
            if c == "L":
                t[cp] = LETTER
            elif c == "N":
                t[cp] = NUMBER
        t[[0x20, *range(0x09, 0x0E), *_WIDE_SPACE]] = SPACE
        _tables["all"] = t
    return _tables["all"]


def _byte_classes(data: np.ndarray) -> np.ndarray:
    if "ascii" not in _tables:
        a = np.full(256, OTHER, np.uint8)
        for b in range(128):
            a[b] = LETTER if chr(b).isalpha() else NUMBER if chr(b).isdigit() else SPACE if K.SPACE[b] else OTHER
        _tables["ascii"] = a
    cls = _tables["ascii"][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = data[lead]
        size = 2 + (b >= 0xE0).astype(np.int64) + (b >= 0xF0)
        cp = np.where(size == 2, b & 0x1F, np.where(size == 3, b & 0x0F, b & 0x07)).astype(np.int64)
        last = len(data) - 1
        for j in (1, 2, 3):
            on = size > j
            cp[on] = (cp[on] << 6) | (data[np.minimum(lead[on] + j, last)] & 0x3F)
        c = _classes()[np.minimum(cp, 0x10FFFF)]
        cls[lead] = c
        for j in (1, 2, 3):
            on = size > j
            cls[np.minimum(lead[on] + j, last)] = c[on]
    return cls


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which matches begin, in order; each document's first byte is one."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cls = _byte_classes(data)
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    head = head[:n]
    turn = head.copy()
    turn[1:] |= cls[1:] != cls[:-1]
    begin = turn.copy()
    space = cls == SPACE
    # Where ink follows white space in the same document, the last white space stands apart:
    # a blank joins the ink, anything else is a match of its own.
    after = np.flatnonzero(turn & ~space & ~head)
    after = after[space[after - 1]]
    last = after - 1
    for _ in range(3):
        inside = (data[last] & 0xC0) == 0x80
        if not inside.any():
            break
        last = last - inside
    begin[last] = True
    blank = data[last] == 0x20
    begin[after[blank]] = False
    # Contractions: a lone quote that begins a match, then one of the endings.
    quote = np.flatnonzero(data[:-1] == 0x27)
    if len(quote):
        quote = quote[begin[quote] & turn[quote] & turn[quote + 1] & ~head[quote + 1] & (cls[quote + 1] == LETTER)]
    if len(quote):
        one = data[quote + 1]
        two = np.where(quote + 2 < n, data[np.minimum(quote + 2, n - 1)], 0)
        same = (quote + 2 < n) & ~head[np.minimum(quote + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = same & (((one == 0x72) & (two == 0x65)) | ((one == 0x76) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C)))
        for hit, size in ((short, 2), (long, 3)):
            q = quote[hit]
            begin[q + 1] = False
            end = q + size
            end = end[end < n]
            end = end[cls[end] == LETTER]
            begin[end] = True
    return np.flatnonzero(begin)


def cut_long(data: np.ndarray, offsets: np.ndarray, limit: int = 0) -> np.ndarray:
    """Offsets with more edges inside documents of over ``limit`` bytes, each where a match begins.

    Starts found in a window are those of the whole text, but for the window's last bytes:
    a cut character, a contraction's end.  A match longer than the window widens it.
    """
    limit = limit or K.CHUNK_BYTES
    more: list[int] = []
    for d in np.flatnonzero(np.diff(offsets) > limit).tolist():
        at, end, width = int(offsets[d]), int(offsets[d + 1]), limit
        while end - at > width:
            part = data[at : at + width]
            s = starts(part, np.array([0, width]))
            s = s[(s > 0) & (s <= width - 8)]
            # White space before an edge would look like that at a text's end, where none stands apart.
            s = s[_byte_classes(part)[s - 1] != SPACE]
            if len(s):
                at, width = at + int(s[-1]), limit
                more.append(at)
            else:
                width *= 2
    return np.sort(np.concatenate([offsets, np.array(more, np.int64)])) if more else offsets


class WordTable:
    """Fingerprint of a word -> its place in a pool of token ids; open addressing in numpy.

    ``encode`` turns new words (a list of bytes) into lists of ids.  The table is emptied
    when it passes ``most`` words, so memory is bounded whatever the corpus holds.
    """

    def __init__(self, encode, most: int = 1 << 18):
        self.encode, self.most = encode, most
        self.bits = (most - 1).bit_length() + 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.at = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.int32)

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each key, or of the free place where it would go, and whether it is there."""
        mask = np.uint64((1 << self.bits) - 1)
        place = (h & mask).astype(np.int64)
        todo = np.arange(len(h))
        found = np.zeros(len(h), bool)
        while len(todo):
            k = self.keys[place[todo]]
            hit = k == h[todo]
            found[todo[hit]] = True
            todo = todo[~hit & (k != 0)]
            place[todo] = (place[todo] + 1) & int(mask)
        return place, found

    def lookup(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, length) in ``pool`` of the ids of each word."""
        h = np.where(h == 0, np.uint64(1), h)
        place, found = self._find(h)
        if not found.all():
            new, first = np.unique(h[~found], return_index=True)
            if self.n + len(new) > self.most:
                self.clear()
                if len(new) < len(h):
                    new, first = np.unique(h, return_index=True)
                    where = first
                else:
                    where = np.flatnonzero(~found)[first]
            else:
                where = np.flatnonzero(~found)[first]
            if len(new) > self.most:
                raise ValueError("a chunk holds more distinct words than the table")
            raw = data.tobytes()
            ids = self.encode([raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for y in ids for x in y), np.int32, int(sizes.sum()))
            base = self.at[-1]
            self.pool = np.concatenate([self.pool, flat])
            self.at = np.concatenate([self.at, base + np.cumsum(sizes)])
            left, number = new, np.arange(self.n, self.n + len(new), dtype=np.int32)
            while len(left):
                p, _ = self._find(left)
                self.keys[p] = left
                won = self.keys[p] == left
                self.slot[p[won]] = number[won]
                left, number = left[~won], number[~won]
            self.n += len(new)
            place, found = self._find(h)
        k = self.slot[place]
        return self.at[k], self.at[k + 1] - self.at[k]


def gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """``pool[start[i] : start[i] + size[i]]`` for all i, one after another; places are made a block at a time."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    out = np.empty(total, pool.dtype)
    i = done = 0
    while done < total:
        j = max(i + 1, int(np.searchsorted(ends, done + block, "right")))
        n = int(ends[j - 1]) - done
        out[done : done + n] = pool[np.repeat(start[i:j] - (ends[i:j] - size[i:j] - done), size[i:j]) + np.arange(n)]
        i, done = j, done + n
    return out
