"""Cutting texts into the words of byte-level BPE, a whole batch at once.

The word pattern takes contractions ('s 't 're 've 'm 'll 'd), then runs of letters, of
numbers or of other characters, each with one space in front of it, then white space without
the character before a word. So word borders follow from where the class of the characters
changes, and are found with array operations.
"""

from __future__ import annotations

import functools

import numpy as np
import regex

from factloom.llm.arrow import mixed, odd_numbers

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0

#: Words of more bytes than this have no hash; they are looked at one by one.
HASHED_BYTES = 64
_ODD = odd_numbers(HASHED_BYTES, 7)


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, every):
            out[at[m.start(): m.end()]] = kind
    return out


def borders(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where words begin in UTF-8 ``data``; no word spans two texts."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
    if len(at) == n:
        point = data.astype(np.uint32)
    else:
        point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind, n = classes()[point], len(at)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, offsets[:-1][offsets[:-1] < len(data)])] = True
    first[n] = True
    run = np.empty(n, bool)
    run[0] = True
    run[1:] = kind[1:] != kind[:-1]
    run |= first[:n]
    start = run.copy()

    ends = np.append(np.flatnonzero(run), n)  # the character after a run is the next one's first
    last = ends[1:] - 1
    joined = (kind[last] == SPACE) & ~first[last + 1]  # white space before a word of its text
    single = last[joined]
    start[single] = True
    space = single[point[single] == 0x20]
    start[space + 1] = False

    lone = np.flatnonzero((point == 0x27) & start)  # an apostrophe by itself, not after a space
    lone = lone[lone + 1 < n]
    lone = lone[~first[lone + 1] & (kind[lone + 1] == LETTER)]
    if len(lone):
        padded = np.append(point, [0, 0])
        a, b = padded[lone + 1], padded[lone + 2]
        b = np.where(first[np.minimum(lone + 2, n)], 0, b)
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        start[lone[one | two] + 1] = False
        after = np.concatenate([lone[one] + 2, lone[two] + 3])
        after = after[after < n]
        start[after[(kind[after] == LETTER) | first[after]]] = True
    return at[np.flatnonzero(start)]


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words that cover ``data``; those of long words mean nothing."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(data), dtype=np.int64) - np.repeat(starts, lengths)
    np.minimum(place, HASHED_BYTES - 1, out=place)
    value = (data.astype(np.uint64) + np.uint64(1)) * _ODD[place]
    return mixed(np.add.reduceat(value, starts) + lengths.astype(np.uint64)) | np.uint64(1)


class Codes:
    """Hash to row number, by open addressing; at most half of the slots are used."""

    def __init__(self, bits: int = 21):
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.rows, self.used = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        open_, slot = np.arange(len(keys)), keys & self.mask
        while len(open_):
            held = self.keys[slot]
            hit = held == keys[open_]
            out[open_[hit]] = self.rows[slot[hit]]
            on = ~hit & (held != 0)
            open_, slot = open_[on], (slot[on] + np.uint64(1)) & self.mask
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that aren't there yet."""
        need = self.used + len(keys)
        if 2 * need > len(self.keys):
            full = np.flatnonzero(self.keys)
            keys, rows = np.concatenate([self.keys[full], keys]), np.concatenate([self.rows[full], rows])
            self._empty((2 * need - 1).bit_length())
        self.used = need
        slot = keys & self.mask
        while len(keys):
            free = self.keys[slot] == 0
            _, one = np.unique(slot, return_index=True)
            put = np.zeros(len(keys), bool)
            put[one] = True
            put &= free
            self.keys[slot[put]], self.rows[slot[put]] = keys[put], rows[put]
            keys, rows, slot = keys[~put], rows[~put], (slot[~put] + (~free[~put]).astype(np.uint64)) & self.mask


def per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Offsets of the texts in their words."""
    return np.searchsorted(starts, offsets)


