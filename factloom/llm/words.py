"""The words of a batch of texts, found and hashed with array operations."""

from __future__ import annotations

import hashlib

import numpy as np

from factloom.llm.arrow import mixed, odd_numbers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Bytes of words of letters, digits and whatever isn't ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True
#: Bytes of words between white space.
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False

_LONG = 64
_ODD = odd_numbers(_LONG, 11)


class Words:
    """The words of texts: where they are, whose they are, and a hash of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
        self.low, inside = _LOWER[data], kind[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        start = inside.copy()
        start[1:] &= ~inside[:-1] | first[1:-1]
        end = inside
        end[:-1] &= ~inside[1:] | first[1:-1]
        self.starts, self.ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        self.by_text = np.searchsorted(self.starts, offsets)
        self.hashes = self._hashes(kind[data])

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        starts, lengths = self.starts, self.ends - self.starts
        if not len(starts):
            return np.zeros(0, np.uint64)
        place = np.arange(starts[0], len(inside), dtype=np.int64)
        place -= np.repeat(starts, np.diff(np.append(starts, len(inside))))
        np.minimum(place, _LONG - 1, out=place)
        value = (self.low[starts[0]:].astype(np.uint64) + np.uint64(1)) * _ODD[place]
        value[~inside[starts[0]:]] = 0
        out = mixed(np.add.reduceat(value, starts - starts[0]) + lengths.astype(np.uint64))
        for i in np.flatnonzero(lengths > _LONG):
            word = self.low[starts[i]: self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def windows(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on; the last ones of a text reach beyond it."""
        n = max(0, len(self.hashes) - size + 1)
        out, odd = np.zeros(n, np.uint64), odd_numbers(size, 13)
        for k in range(size):
            out += self.hashes[k: n + k] * odd[k]
        return mixed(out)

    def text(self, word: int, size: int) -> bytes:
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[word: word + size], self.ends[word: word + size]))
