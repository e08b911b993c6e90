"""Repeated substrings of bounded length in a block of bytes, by backward extension on its
Burrows-Wheeler transform.

The rows of the transform are the sorted suffixes. Rows that share a prefix of l bytes are an
interval; putting a byte in front of the prefix leads to the rows of an interval for l + 1. All
intervals of one length are extended together, breadth first, so the common prefixes of
neighbouring rows come out by increasing value: 0, 1, 2 and so on. The expansion stops at the
wanted length. Neighbours that then have no value share at least that many bytes.
"""

from __future__ import annotations

import numpy as np

from factloom.llm.arrow import ranges

#: Symbols before the bytes: the end of the block, and what stands between its pieces.
END, BREAK, FIRST = 0, 1, 2
_PACKED, _WIDTH = 7, 9


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of the sorted suffixes. ``symbols``: below 512, the last one smaller than all others.

    Suffixes are sorted by their first 7 symbols, then those still equal by twice as many, and
    so on; a suffix's rank is the first place of its group.
    """
    n = len(symbols)
    padded = np.append(symbols, np.zeros(_PACKED, np.int64))
    key = np.zeros(n, np.int64)
    for j in range(_PACKED):
        key = key << _WIDTH | padded[j: j + n]
    order = np.argsort(key)
    place, rank, known = np.arange(n), np.empty(n, np.int64), _PACKED
    suffix, key = order, key[order]
    while len(place):
        first = np.append(True, key[1:] != key[:-1])
        rank[suffix] = place[np.maximum.accumulate(np.where(first, np.arange(len(place)), 0))]
        open_ = ~(first & np.append(first[1:], True))
        place, suffix = place[open_], suffix[open_]
        after = suffix + known
        key = rank[suffix] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        by = np.argsort(key)
        suffix, key = suffix[by], key[by]
        order[place] = suffix
        known *= 2
    return order


def prefix_groups(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Group number of each row: neighbours are of one group if they share ``length`` symbols."""
    n = len(order)
    last = symbols[order - 1]  # the transform; the first suffix wraps around
    rows = np.argsort(last, kind="stable")
    back = np.empty(n, np.int64)  # where a row goes when its last symbol is put in front
    back[rows] = np.arange(n)
    same = np.append(False, last[rows][1:] == last[rows][:-1])
    previous = np.full(n, -1)  # the row before with the same last symbol
    previous[rows[same]] = rows[np.flatnonzero(same) - 1]
    border = np.zeros(n + 1, bool)  # rows that differ from the one before within what is known
    border[-1] = True
    new = np.flatnonzero(np.append(True, symbols[order][1:] != symbols[order][:-1]))
    border[new] = True
    for _ in range(1, length):
        # an interval begins at each new border; its rows whose symbol didn't occur since
        # the border lead to rows that differ from their neighbour one symbol later
        known = np.flatnonzero(border)
        size = known[np.searchsorted(known, new, "right")] - new
        row = ranges(new, size)
        row = row[previous[row] < np.repeat(new, size)]
        new = back[row]
        new = np.sort(new[~border[new]])
        if not len(new):
            break
        border[new] = True
    return np.cumsum(border[:-1]) - 1


def repeated(pieces: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, offset, group) of every substring of ``length`` bytes that occurs more than once."""
    if not pieces:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    starts = np.append(0, np.cumsum(sizes + 1))
    symbols = np.full(starts[-1] + 1, BREAK, np.int64)
    symbols[-1] = END
    symbols[ranges(starts[:-1], sizes)] = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64) + FIRST
    order = suffix_array(symbols)
    group = prefix_groups(symbols, order, length)
    piece = np.searchsorted(starts, order, "right") - 1
    piece = np.minimum(piece, len(pieces) - 1)
    offset = order - starts[piece]
    whole = offset + length <= sizes[piece]
    piece, offset, group = piece[whole], offset[whole], group[whole]
    often = np.bincount(group, minlength=1)[group] > 1 if len(group) else np.zeros(0, bool)
    return piece[often], offset[often], group[often]
