"""Brown class-based bigrams: how likely a text is under a model of word classes.

The probability of a word after another is that of its class after the other's class, times
that of the word in its class. The commonest words are put into classes by exchange on the driver:
one word after the other goes to the class that makes the corpus likeliest, in some sweeps. That is
where all words start from: in each round every word of ``least`` occurrences or more goes to the
class that is best for it beside the others' classes of the round before. Words that occur less often
and unknown ones fall into classes by their last bytes, the endings. ``Shape`` has the numbers.
Both probabilities are smoothed.

All counts are over every training text. Tasks hold the commonest words, the head, with a class each. Where two words of the head meet, a
task counts each one's neighbour class in place, and hands on only those counts, packed by ranges of words; pairs of words are
written nowhere; the texts are, once, as numbers of words. Where a word of the head meets another one, the other's row in a distributed table lists it; only pairs of two words
outside the head are joined. Counts and classes of words are tables that grow with the texts. The driver gets the counts of the
pairs of ``start`` words and of classes, and the classes of the head, all of fixed size.

Words are runs of bytes that aren't white space, A-Z in lower case, told apart by a 64-bit hash.
An end follows the last word of a text and stands before its first. Null and empty texts are an end
alone. Rows are told apart by place, so keys may repeat or be null; rows with a null key are scored
but not learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.arrow import flat, lean, mixed, odd_numbers, steps
from factloom.llm.pretoken import Codes
from factloom.llm.tables import kept
from factloom.llm.words import SOLID, Words

#: Added to every count.
DELTA = 0.1


@dataclass(frozen=True)
class Shape:
    """Numbers of a model. With a ``vocabulary`` only that many words are put into classes."""

    vocabulary: int | None = None
    classes: int = 48
    endings: int = 64
    sweeps: int = 6
    head: int = 1 << 19
    start: int = 2048  # words of the exchange on the driver, where there is no vocabulary
    rounds: int = 2
    least: int = 2

    @property
    def first(self) -> int:
        return self.start if self.vocabulary is None else self.vocabulary

    @property
    def ids(self) -> int:
        return self.first + self.endings + 1

    @property
    def kinds(self) -> int:
        return self.classes + self.endings + 1


#: Bytes of text that a step works on; distinct words, and bigrams, that a task gathers before it hands them on.
_STEP_BYTES, _GATHERED_WORDS, _GATHERED_PAIRS = 1 << 20, 1 << 19, 1 << 21
_TAIL = odd_numbers(2, 31)
#: The end among hashes of words, and words whose moves are worked out in one go.
_END, _MOVED_WORDS = np.uint64(0), 512


def _words(part: pa.RecordBatch, text: str, endings: int) -> tuple[Words, np.ndarray]:
    """The words, and the ending of each."""
    offsets, data = flat(part.column(text))
    words = Words(data, offsets, SOLID)
    last = words.low[words.ends - 1].astype(np.uint64)
    before = np.where(words.ends - words.starts > 1, words.low[np.maximum(words.ends - 2, 0)], 0).astype(np.uint64)
    return words, (mixed(last * _TAIL[0] + before * _TAIL[1]) % np.uint64(endings)).astype(np.int64)


def word_counts(texts: DataFrame, text: str, endings: int) -> DataFrame:
    """(word, ending, n): occurrences of each word, by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def handed() -> pa.RecordBatch:
            hashes, ending, n = (np.concatenate(x) for x in zip(*held))
            hashes, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            held.clear()
            counts = np.bincount(back, n, minlength=len(hashes)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ending[first].astype(np.int32)), pa.array(counts)], names=["word", "ending", "n"])

        for batch in batches:
            for part in steps(batch, text, _STEP_BYTES):
                words, ending = _words(part, text, endings)
                hashes, first, n = np.unique(words.hashes, return_index=True, return_counts=True)
                held.append((hashes, ending[first], n))
                if sum(len(h[0]) for h in held) > _GATHERED_WORDS:
                    made = handed()
                    if made.num_rows * 2 > _GATHERED_WORDS:
                        yield made
                    else:
                        held.append((made.column(0).to_numpy().view(np.uint64), made.column(1).to_numpy().astype(np.int64), made.column(2).to_numpy()))
        if held:
            yield handed()

    counts = texts.select(text).mapInArrow(lean(run), "word long, ending int, n long")
    return counts.groupBy("word", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The commonest words and their counts, commonest first."""

    words: np.ndarray
    counts: np.ndarray

    def codes(self) -> Codes:
        out = Codes(bits=max(10, (2 * len(self.words)).bit_length()))
        out.add(self.words, np.arange(len(self.words)))
        return out


def commonest(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """((words, counts), endings) of the commonest words, ``most`` at most, commonest first.

    A table of a few thousand steps of the count tells which least count leaves no more than
    that; only words of that count or more come to the driver.
    """
    fine = 1024  # every count of its own up to here, 64 steps for each doubling above
    step = F.when(F.col("n") <= fine, F.col("n")).otherwise(F.floor(64 * F.log2("n")) + fine).cast("long")
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    total, least = 0, None
    for row in sorted(sizes, key=lambda r: -r.least):
        total += row.words
        if total > most:
            break
        least = row.least
    made = counts.filter(F.col("n") >= least if least is not None else F.lit(False)).select("word", "n", "ending").toArrow()
    word, n, ending = (made.column(i).to_numpy() for i in range(3))
    order = np.lexsort((word, -n))
    return (word[order].view(np.uint64), n[order]), ending[order].astype(np.int64)


def _with_ends(ids: np.ndarray, words: Words, end: int) -> tuple[np.ndarray, np.ndarray]:
    texts = len(words.by_text) - 1
    out = np.full(len(ids) + texts, end, ids.dtype)
    text = np.repeat(np.arange(texts), np.diff(words.by_text))
    out[np.arange(len(ids)) + text] = ids
    return out, words.by_text[:-1] + np.arange(texts)


def _before(ids: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[first] = end
    return out


def _squeezed(x: np.ndarray) -> bytes:
    """Numbers of 32 bits, bytes of equal weight together."""
    return zlib.compress(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _spread(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def prepared(texts: DataFrame, text: str, head: Head, shape: Shape) -> DataFrame:
    """The texts as numbers, and the words outside the head with their neighbours.

    Rows with ``ids``: some texts, words and the end of each: the rank of a word of the head; the end is the number after
    those, any other word the one after that and its ending's. Rows without: (word, other, code) for each word outside the
    head and each neighbour of it. ``code`` is twice the neighbour's number, plus 1 if it comes before; where the next
    word isn't in the head either, ``other`` is that word, once for both, and ``code`` is null.
    """
    size = len(head.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, nothing = head.codes(), pa.binary()
        for batch in batches:
            for part in steps(batch, text, _STEP_BYTES):
                words, ending = _words(part, text, shape.endings)
                rank = codes.find(words.hashes)
                ids, first = _with_ends(np.where(rank >= 0, rank, size + 1 + ending), words, size)
                one = pa.array([_squeezed(ids)], nothing)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), one], names=["word", "other", "code", "ids"])
                if (ids <= size).all():
                    continue
                hashes, _ = _with_ends(words.hashes, words, _END)
                before, hash_before = _before(ids, first, size), _before(hashes, first, _END)
                led, follows, both = (before <= size) & (ids > size), (before > size) & (ids <= size), (before > size) & (ids > size)
                word = np.concatenate([hashes[led], hash_before[follows], hash_before[both]]).view(np.int64)
                known = int(led.sum() + follows.sum())
                missing = np.arange(len(word)) < known
                other = np.concatenate([np.zeros(known, np.int64), hashes[both].view(np.int64)])
                code = np.concatenate([before[led] * 2 + 1, ids[follows] * 2, np.zeros(len(word) - known, np.int64)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(other, mask=missing), pa.array(code, mask=~missing), pa.nulls(len(word), nothing)],
                                                 names=["word", "other", "code", "ids"])

    return texts.select(text).mapInArrow(lean(run), "word long, other long, code int, ids binary")


def _numbers(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(before, ids) of the pairs of each row; the end stands before the first word of a text."""
    for batch in batches:
        for row in batch.column(0):
            ids = _spread(row.as_py()).astype(np.int64)
            yield np.append(end, ids[:-1]), ids


def bigram_counts(ids: DataFrame, head: Head, endings: np.ndarray, shape: Shape) -> np.ndarray:
    """Occurrences of each pair of a vocabulary word, an ending or the end, as a square of fixed size."""
    size, end = shape.ids, len(head.words)
    # what each number is: itself, its ending, the end, its ending
    rank = np.arange(end)
    to = np.concatenate([np.where(rank < shape.first, rank, shape.first + endings), [size - 1], shape.first + np.arange(shape.endings)]).astype(np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(size * size, np.int32), []

        def add() -> None:
            keys = np.concatenate(held)
            held.clear()
            keys.sort()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            total[keys[starts]] += np.diff(np.append(starts, len(keys))).astype(np.int32)

        for before, after in _numbers(batches, end):
            held.append(to[before] * size + to[after])
            if sum(map(len, held)) > _GATHERED_PAIRS:
                add()
        if held:
            add()
        rows = total.reshape(size, size)
        full = np.flatnonzero(rows.any(1))
        for some in np.array_split(full, max(1, len(full) // 256)):
            after = [np.flatnonzero(rows[i]).astype(np.uint16) for i in some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([a.tobytes() for a in after], pa.binary()),
                                              pa.array([rows[i][a].tobytes() for i, a in zip(some, after)], pa.binary())], names=["id", "after", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, after, n in zip(*(c.to_pylist() for c in batch.columns)):
                row = total.setdefault(i, np.zeros(size, np.int64))
                row[np.frombuffer(after, np.uint16)] += np.frombuffer(n, np.int32)
        for i, row in total.items():
            after = np.flatnonzero(row).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([after.tobytes()], pa.binary()), pa.array([row[after].tobytes()], pa.binary())],
                                             names=["id", "after", "n"])

    schema = "id int, after binary, n binary"
    summed = ids.mapInArrow(lean(count), schema).repartition("id").mapInArrow(lean(add), schema)
    out = np.zeros((size, size))
    for row in summed.collect():  # at most ``size`` rows of ``size`` counts
        out[row.id, np.frombuffer(row.after, np.uint16)] = np.frombuffer(row["n"], np.int64)
    return out


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, shape: Shape) -> np.ndarray:
    """The class of each id: vocabulary words by exchange, endings and the end one class each.

    Words start in turn by rank and move, commonest first, to wherever the likelihood of the
    bigrams of classes is largest; ties go to the first class. Stops when none moves.
    """
    size, kinds = shape.ids, shape.kinds
    place = np.concatenate([np.arange(shape.first) % shape.classes, shape.classes + np.arange(shape.endings + 1)])
    turned = np.ascontiguousarray(pairs.T)
    active = [w for w in range(shape.first) if pairs[w].any() or turned[w].any()]
    rows = {w: (np.flatnonzero(pairs[w]).astype(np.int32), np.flatnonzero(turned[w]).astype(np.int32)) for w in active}
    grid = np.zeros((kinds, kinds))
    for i in range(size):
        grid[place[i]] += np.bincount(place, pairs[i], minlength=kinds)
    for _ in range(shape.sweeps):
        moved = 0
        for w in active:
            after, before = rows[w]
            own, old = pairs[w, w], place[w]
            r = np.bincount(place[after], pairs[w, after], minlength=kinds)
            c = np.bincount(place[before], turned[w, before], minlength=kinds)
            r[old] -= own
            c[old] -= own
            grid[old] -= r
            grid[:, old] -= c
            grid[old, old] -= own
            best = int(np.argmax(_gains(grid, r, c, own, shape.classes)))
            grid[best] += r
            grid[:, best] += c
            grid[best, best] += own
            place[w] = best
            moved += best != old
        if not moved:
            break
    return place


def _gains(grid: np.ndarray, r: np.ndarray, c: np.ndarray, own: float, classes: int) -> np.ndarray:
    """How much the log-likelihood rises by a word with these neighbours in each class."""
    k = np.arange(classes)
    right, left = np.flatnonzero(r), np.flatnonzero(c)
    x, y = grid[:classes, right], grid[left, :classes]
    out = (_h(x + r[right]) - _h(x)).sum(1) + (_h(y + c[left][:, None]) - _h(y)).sum(0)
    d = grid[k, k]
    out += _h(d + r[k] + c[k] + own) + _h(d) - _h(d + r[k]) - _h(d + c[k])
    rows, columns = grid[:classes].sum(1), grid[:, :classes].sum(0)
    return out - _h(rows + r.sum() + own) + _h(rows) - _h(columns + c.sum() + own) + _h(columns)


def started(counts: DataFrame, head: Head, place: np.ndarray, shape: Shape) -> DataFrame:
    """(word, n, kind): the class of each word, as the exchange left it or by its ending."""
    some = Head(head.words[: shape.first], head.counts[: shape.first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = some.codes()
        for batch in batches:
            rank = codes.find(batch.column("word").to_numpy().view(np.uint64))
            kind = np.where(rank >= 0, place[rank], shape.classes + batch.column("ending").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(kind.astype(np.int32))], names=["word", "n", "kind"])

    return counts.select("word", "ending", "n").mapInArrow(lean(run), "word long, n long, kind int")


#: Words of a block of neighbour classes, blocks of the commonest words, and counts that a task gathers before it sorts them.
_BLOCK, _COMMON, _GATHERED_CELLS = 1024, 8, 1 << 21


class _Cells:
    """Counts of (word of the head, side, class), gathered and handed on in blocks of words; and of pairs of
    classes. The commonest words' counts are an array, others are sorted when enough are gathered."""

    def __init__(self, shape: Shape, size: int):
        self.kinds, self.grid = shape.kinds, np.zeros(shape.kinds * shape.kinds, np.int64)
        self.span = 3 * shape.kinds * _BLOCK
        self.common = np.zeros(min(_COMMON, -(-size // _BLOCK)) * self.span, np.int64)
        self.raw: list[np.ndarray] = []
        self.gathered = 0
        self._empty()

    def _empty(self) -> None:
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, rank: np.ndarray, side: np.ndarray | int, kind: np.ndarray) -> None:
        self.raw.append((rank * 3 + side) * self.kinds + kind)
        self.gathered += len(rank)

    def pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        self.grid += np.bincount(x * self.kinds + y, minlength=len(self.grid))

    def full(self) -> bool:
        """Gathers what was added; whether it is time to hand on."""
        if self.gathered <= _GATHERED_CELLS:
            return False
        self._merge()
        return 2 * len(self.keys) > _GATHERED_CELLS

    def _merge(self) -> None:
        if not self.raw:
            return
        keys = np.concatenate(self.raw)
        self.raw.clear()
        self.gathered = 0
        low = keys < len(self.common)
        if len(self.common):
            self.common += np.bincount(keys[low], minlength=len(self.common))
        keys = keys[~low]
        keys.sort()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(starts, len(keys)))
        keys, n = np.concatenate([self.keys, keys[starts]]), np.concatenate([self.n, n])
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.n = keys[starts], np.add.reduceat(n, starts) if len(starts) else n

    def _block(self, number: int, keys: np.ndarray, n: np.ndarray) -> tuple:
        return number, _squeezed(np.diff(keys, prepend=0)), _squeezed(n)

    def blocks(self, last: bool = True) -> Iterator[pa.RecordBatch]:
        """What was counted so far, which starts anew; before the last time, without the array."""
        self._merge()
        block = self.keys // self.span
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(block))
        rows = [self._block(int(block[a]), self.keys[a:b] - block[a] * self.span, self.n[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        self._empty()
        if last:
            for i in range(0, len(self.common), self.span):
                at = np.flatnonzero(self.common[i: i + self.span])
                if len(at):
                    rows.append(self._block(i // self.span, at, self.common[i + at]))
            if self.grid.any():
                rows.append((-1, self.grid.tobytes(), b""))
        for i in range(0, len(rows), 64):
            yield _block_rows(rows[i: i + 64])


def _block_rows(rows: list) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(3)], names=["block", "keys", "n"])


_BLOCKS = "block int, keys binary, n binary"


def _beside_head(ids: DataFrame, size: int, place: np.ndarray, shape: Shape, cells: bool) -> DataFrame:
    """Blocks of the neighbours' classes of words of the head beside such words, ends included; without
    ``cells`` only the pairs of classes. ``place``: the class of each word of the head and of the end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, kinds = _Cells(shape, size if cells else 0), place.astype(np.int64)
        for before, after in _numbers(batches, size):
            both = (after <= size) & (before <= size)
            a, b = before[both], after[both]
            x, y = kinds[a], kinds[b]
            made.pairs(x, y)
            if cells:
                same = a == b
                left, right, twice = (a < size) & ~same, (b < size) & ~same, same & (a < size)
                made.add(a[left], 0, y[left])
                made.add(b[right], 1, x[right])
                made.add(a[twice], 2, x[twice])
                if made.full():
                    yield from made.blocks(last=False)
        yield from made.blocks()

    return ids.mapInArrow(lean(run), _BLOCKS)


def _beside_others(rows: DataFrame, size: int, place: np.ndarray, shape: Shape, cells: bool) -> DataFrame:
    """The same from (kind, codes) of words outside the head."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, kinds = _Cells(shape, size if cells else 0), place.astype(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                codes = part.column("codes")
                code = codes.flatten().to_numpy().astype(np.int64)
                kind = np.repeat(part.column("kind").to_numpy().astype(np.int64), np.diff(np.asarray(codes.offsets)))
                rank, ahead = code >> 1, code & 1 == 1
                made.pairs(np.where(ahead, kinds[rank], kind), np.where(ahead, kind, kinds[rank]))
                if cells:
                    known = rank < size
                    made.add(rank[known], 1 - (code & 1)[known], kind[known])
                    if made.full():
                        yield from made.blocks(last=False)
        yield from made.blocks()

    return rows.select("kind", "codes").mapInArrow(lean(run), _BLOCKS)


def _added(blocks: DataFrame, shape: Shape) -> DataFrame:
    """One row for each block: a task adds up one block after the other."""
    span = 3 * shape.kinds * _BLOCK

    def closed(block: int, counts: np.ndarray) -> pa.RecordBatch:
        if block < 0:
            return _block_rows([(block, counts.tobytes(), b"")])
        at = np.flatnonzero(counts)
        if counts.max() >= 1 << 32:
            raise OverflowError("a class follows a word 2^32 times")
        return _block_rows([(block, _squeezed(np.diff(at, prepend=0)), _squeezed(counts[at]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = None, None
        for batch in batches:
            for block, keys, n in zip(*batch.columns):
                if block.as_py() != now:
                    if now is not None:
                        yield closed(now, counts)
                    now = block.as_py()
                    counts = np.zeros(span if now >= 0 else shape.kinds * shape.kinds, np.int64)
                if now < 0:
                    counts += np.frombuffer(keys.as_py(), np.int64)
                else:
                    counts[np.cumsum(_spread(keys.as_py()).astype(np.int64))] += _spread(n.as_py())
        if now is not None:
            yield closed(now, counts)

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(lean(run), _BLOCKS)


def _head_kinds(counts: DataFrame, head: Head, place: np.ndarray) -> DataFrame:
    """(word, n, kind) of the head's words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = head.codes()
        for batch in batches:
            rank = codes.find(batch.column("word").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(place[rank].astype(np.int32))], names=["word", "n", "kind"])

    least = int(head.counts[-1]) if len(head.counts) else None
    return counts.filter(F.col("n") >= least if least is not None else F.lit(False)).select("word", "n").mapInArrow(lean(run), "word long, n long, kind int")


def _grid(cells: DataFrame, shape: Shape) -> np.ndarray:
    """A square of classes from (x, y, n)."""
    out = np.zeros((shape.kinds, shape.kinds))
    for r in cells.groupBy("x", "y").agg(F.sum("n").alias("n")).collect():
        out[r.x, r.y] = r["n"]
    return out


def likelihood(grid: np.ndarray) -> float:
    return float(_h(grid).sum() - _h(grid.sum(0)).sum() - _h(grid.sum(1)).sum())


def best(grid: np.ndarray, old: np.ndarray, ends: np.ndarray, side: np.ndarray, kind: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """For words in the classes ``old``, the class of the largest likelihood if nothing else
    moves; ties go to the first. ``side``, ``kind`` and ``n``, from ``ends`` to ``ends``: how often
    a class follows the word (0) or precedes it (1), and the word itself does (2)."""
    words, owner = len(old), np.repeat(np.arange(len(old)), np.diff(ends))

    def of(which: int) -> np.ndarray:
        at = side == which
        return np.bincount(owner[at] * len(grid) + kind[at], n[at], minlength=words * len(grid)).reshape(words, -1)

    r, c, own = of(0), of(1), of(2).sum(1)
    total_r, total_c = r.sum(1) + own, c.sum(1) + own
    out, k = np.zeros((words, classes)), np.arange(classes)
    mine = k == old[:, None]
    for which, cells, beside in ((0, grid[:classes].T, c), (1, grid[:, :classes], r)):
        at = side == which
        w, j, m = owner[at], kind[at], n[at][:, None]
        x = cells[j] - mine[w] * m  # the word is taken out of its class
        same = j == old[w]
        x[same] -= beside[w[same], :classes] + mine[w[same]] * own[w[same], None]
        gain = _h(x + m) - _h(x)
        starts = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else w
        if len(w):
            out[w[starts]] += np.add.reduceat(gain, starts)
    a, b = r[:, :classes], c[:, :classes]
    d = grid[k, k] - mine * (a + b + own[:, None])
    out += _h(d + a + b + own[:, None]) + _h(d) - _h(d + a) - _h(d + b)
    left, right = grid.sum(1)[:classes] - mine * total_r[:, None], grid.sum(0)[:classes] - mine * total_c[:, None]
    out -= _h(left + total_r[:, None]) - _h(left) + _h(right + total_c[:, None]) - _h(right)
    return np.argmax(out, 1)


def _head_moves(added: DataFrame, grid: np.ndarray, place: np.ndarray, free: np.ndarray, shape: Shape) -> np.ndarray:
    """The best class of each word of the head; words that aren't ``free`` stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, n in zip(*(c.to_pylist() for c in batch.columns)):
                key, n, out = np.cumsum(_spread(keys).astype(np.int64)), _spread(n).astype(np.int64), []
                word, side, kind = key // shape.kinds // 3, key // shape.kinds % 3, key % shape.kinds
                old = place[block * _BLOCK: min((block + 1) * _BLOCK, len(place) - 1)].astype(np.int64)
                for at in range(0, len(old), _MOVED_WORDS):
                    ends = np.searchsorted(word, np.arange(at, min(at + _MOVED_WORDS, len(old)) + 1))
                    c = slice(ends[0], ends[-1])
                    out.append(best(grid, old[at: at + _MOVED_WORDS], ends - ends[0], side[c], kind[c], n[c], shape.classes))
                yield _block_rows([(block, np.concatenate(out).astype(np.uint16).tobytes(), b"")])

    out = place.copy()
    for r in added.filter("block >= 0").mapInArrow(lean(run), _BLOCKS).select("block", "keys").collect():  # a number for each word of the head
        made = np.frombuffer(r["keys"], np.uint16)
        at = slice(r["block"] * _BLOCK, r["block"] * _BLOCK + len(made))
        out[at] = np.where(free[at], made, out[at])
    return out


def _other_moves(rows: DataFrame, linked: DataFrame, grid: np.ndarray, place: np.ndarray, shape: Shape) -> DataFrame:
    """``rows`` (word, n, kind, codes) with the best class of each word. ``linked``: (word, side, y, n), neighbours outside the head."""
    beside = linked.groupBy("word").agg(F.collect_list(F.struct("side", "y", "n")).alias("cells"))  # two or three a class at most
    rows = rows.join(beside, "word", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = place.astype(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, _MOVED_WORDS):
                part = batch.slice(at, _MOVED_WORDS)
                codes, cells = part.column("codes"), part.column("cells")
                code = codes.flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(codes.offsets)))
                key = [(owner * 3 + (code & 1)) * shape.kinds + kinds[code >> 1]]
                lengths = np.array([len(c) if c.is_valid else 0 for c in cells], np.int64)
                side, kind, n = (f.to_numpy(zero_copy_only=False).astype(np.int64) for f in cells.flatten().flatten())
                key.append((np.repeat(np.arange(part.num_rows), lengths) * 3 + side) * shape.kinds + kind)
                key, n = np.concatenate(key), np.concatenate([np.ones(len(code), np.int64), n])
                key, back = np.unique(key, return_inverse=True)
                n = np.bincount(back, n, minlength=len(key))
                ends = np.searchsorted(key // shape.kinds // 3, np.arange(part.num_rows + 1))
                made = best(grid, part.column("kind").to_numpy().astype(np.int64), ends, key // shape.kinds % 3, key % shape.kinds, n, shape.classes)
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(made.astype(np.int32)), codes], names=["word", "n", "kind", "codes"])

    return rows.mapInArrow(lean(run), "word long, n long, kind int, codes array<int>")


def clustered(ids: DataFrame, lists: DataFrame, counts: DataFrame, head: Head, place: np.ndarray, shape: Shape) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """(classes of the head, (word, n, kind) of all other words, counts of pairs of classes) after the
    round whose classes are likeliest. ``ids``, ``lists``: as ``prepared``; ``place``: the head's classes at first."""
    size = len(head.words)
    least = int(head.counts[-1]) if size else 0
    others = counts.filter(F.col("n") < least if size else F.lit(True))
    codes = lists.filter("code IS NOT NULL").groupBy("word").agg(F.collect_list("code").alias("codes"))  # as many as the word occurs: fewer than a word of the head
    others = others.join(codes, "word", "left").select("word", "n", (F.col("ending") + shape.classes).alias("kind"), F.coalesce("codes", F.array().cast("array<int>")).alias("codes"))
    others = kept(others.withColumn("free", F.col("n") >= shape.least), "other-words")
    fixed, rows = others.filter("NOT free").drop("free"), others.filter("free").drop("free")
    links = lists.filter("code IS NULL").groupBy(F.col("word").alias("a"), F.col("other").alias("b")).agg(F.count("*").alias("n"))
    for word, kind in (("a", "fixed_a"), ("b", "fixed_b")):  # the classes that don't change
        links = links.join(fixed.select(F.col("word").alias(word), F.col("kind").alias(kind)), word, "left")
    links = kept(links, "other-pairs")
    free, place = head.counts >= shape.least, np.append(place, shape.kinds - 1).astype(np.uint16)
    found: list = []
    for turn in range(shape.rounds + 1):
        last, labelled = turn == shape.rounds, links
        for word, kind, own in (("a", "fixed_a", "x"), ("b", "fixed_b", "y")):
            labelled = labelled.join(rows.select(F.col("word").alias(word), F.col("kind").alias(own)), word, "left")
            labelled = labelled.withColumn(own, F.coalesce(own, kind))
        labelled = kept(labelled, "other-classes")
        blocks = _beside_head(ids, size, place, shape, not last)
        for part in (fixed, rows):
            blocks = blocks.unionByName(_beside_others(part, size, place, shape, not last))
        added = kept(_added(blocks, shape), "neighbour-classes")
        grid = _grid(labelled, shape)
        for r in added.filter("block < 0").select("keys").collect():
            grid += np.frombuffer(r["keys"], np.int64).reshape(grid.shape)
        if turn:  # before the first round, other words' classes are only endings
            found.append((likelihood(grid), turn, place, rows, grid))
        if not last:
            cells = labelled.select(F.inline(F.expr("""
                IF(a = b, array(named_struct('word', IF(fixed_a IS NULL, a, NULL), 'side', 2, 'y', y, 'n', n)),
                   array(named_struct('word', IF(fixed_a IS NULL, a, NULL), 'side', 0, 'y', y, 'n', n),
                         named_struct('word', IF(fixed_b IS NULL, b, NULL), 'side', 1, 'y', x, 'n', n)))"""))).filter("word IS NOT NULL")
            cells = cells.groupBy("word", "side", "y").agg(F.sum("n").alias("n"))
            rows, place = kept(_other_moves(rows, cells, grid, place, shape), "other-words"), _head_moves(added, grid, place, free, shape)
    place, rows, grid = max(found, key=lambda f: f[:2])[2:]
    return place[:-1].astype(np.int64), rows.select("word", "n", "kind").unionByName(fixed.select("word", "n", "kind")), grid


@dataclass
class Model:
    shape: Shape
    head: Head
    place: np.ndarray  # class of each word of the head
    moves: np.ndarray  # log10 probability of a class after another
    members: np.ndarray  # by class, log10 of the sum of its smoothed counts
    tokens: int  # N
    distinct: int  # V
    ends: int  # training texts


def fit(texts: DataFrame, text: str, shape: Shape = Shape()) -> tuple[Model, DataFrame]:
    """The model of all ``texts``, and the counts and classes of their words (word, n, kind)."""
    counts = kept(word_counts(texts, text, shape.endings), "word-counts")
    top, endings = commonest(counts, shape.head)
    head = Head(*top)
    numbered = kept(prepared(texts, text, head, shape), "numbered-words")
    ids, lists = numbered.filter("ids IS NOT NULL").select("ids"), numbered.filter("ids IS NULL").drop("ids")
    pairs = bigram_counts(ids, head, endings, shape)
    place, size = exchange(pairs, shape), shape.kinds
    first = np.arange(len(head.words)) < shape.first
    kind = np.where(first, place[np.minimum(np.arange(len(head.words)), shape.first)], shape.classes + endings)
    if shape.vocabulary is None and shape.rounds:
        kind, others, grid = clustered(ids, lists, counts, head, kind, shape)
        kinds = kept(_head_kinds(counts, head, kind).unionByName(others), "word-classes")
    else:
        kinds = kept(started(counts, head, place, shape), "word-classes")
        grid = np.zeros((size, size))
        for i in range(len(pairs)):
            grid[place[i]] += np.bincount(place, pairs[i], minlength=size)
    place = kind
    ends = int(grid[:, -1].sum())
    by_kind = kinds.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
    tokens, distinct = sum(r["n"] for r in by_kind) + ends, sum(r.distinct for r in by_kind) + (ends > 0)
    occurs = grid.sum(0)
    share = (occurs + DELTA) / (occurs.sum() + DELTA * size)
    moves = np.log10((grid + size * share) / (grid.sum(1, keepdims=True) + size))
    words = np.zeros(size)  # distinct ones of each class
    for r in by_kind:
        words[r.kind] = r.distinct
    words[-1] = ends > 0
    members = np.log10(occurs + DELTA * (words + 1))
    return Model(shape, head, place, moves, members, int(tokens), int(distinct), ends), kinds


_DOC = ("no long, key {}, n_tokens long, n_known long, sum_log double, moved double, members double, rare array<long>, endings array<int>, "
        "times array<int>, before array<int>, after array<int>")


def _local(rows: DataFrame, model: Model) -> DataFrame:
    """For each text what is known in its task: sums over its common words, class moves; and
    the words whose counts and classes have to be joined, with how often each occurs. Moves from
    or to these are listed: classes, or -1 - i for the word at i."""
    names = ["no", "key", "n_tokens", "n_known", "sum_log", "moved", "members", "rare", "endings", "times", "before", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, log_count = model.head.codes(), np.log10(np.append(model.head.counts, 0) + DELTA)
        end, last = np.log10(model.ends + DELTA), model.shape.kinds - 1
        for batch in batches:
            for part in steps(batch, "text", _STEP_BYTES):
                words, ending = _words(part, "text", model.shape.endings)
                texts = part.num_rows
                rank = codes.find(words.hashes)
                owner = np.repeat(np.arange(texts), np.diff(words.by_text))
                whose = np.repeat(np.arange(texts), np.diff(words.by_text) + 1)
                common = rank >= 0
                rare = np.flatnonzero(~common)
                rare = rare[np.lexsort((words.hashes[rare], owner[rare]))]
                new = np.append(True, (words.hashes[rare][1:] != words.hashes[rare][:-1]) | (owner[rare][1:] != owner[rare][:-1]))[: len(rare)]
                starts = np.flatnonzero(new)
                listed = np.searchsorted(owner[rare][starts], np.arange(texts + 1))
                kind = np.empty(len(rank), np.int64)
                kind[common] = model.place[rank[common]]
                kind[rare] = -1 - (np.cumsum(new) - 1 - listed[owner[rare]])
                kind, first = _with_ends(kind, words, last)
                before = _before(kind, first, last)
                sure, closed = kind >= 0, (kind >= 0) & (before >= 0)
                open_ = np.flatnonzero(~closed)
                joined = pa.array(np.searchsorted(whose[open_], np.arange(texts + 1)), pa.int32())
                listed = pa.array(listed, pa.int32())
                yield pa.RecordBatch.from_arrays([
                    part.column("no"), part.column("key"), pa.array(np.diff(words.by_text) + 1),
                    pa.array(np.bincount(owner[common], minlength=texts) + (model.ends > 0)),
                    pa.array(np.bincount(owner[common], log_count[rank[common]], minlength=texts) + end),
                    pa.array(np.bincount(whose[closed], model.moves[before[closed], kind[closed]], minlength=texts).astype(float)),
                    pa.array(np.bincount(whose[sure], model.members[kind[sure]], minlength=texts).astype(float)),
                    pa.ListArray.from_arrays(listed, pa.array(words.hashes[rare][starts].view(np.int64))),
                    pa.ListArray.from_arrays(listed, pa.array(ending[rare][starts].astype(np.int32))),
                    pa.ListArray.from_arrays(listed, pa.array(np.diff(np.append(starts, len(rare))).astype(np.int32))),
                    *(pa.ListArray.from_arrays(joined, pa.array(x[open_].astype(np.int32))) for x in (before, kind)),
                ], names=names)

    return rows.mapInArrow(lean(run), _DOC.format(rows.schema["key"].dataType.simpleString()))


def _joined(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``moved`` and ``members`` summed over all words: ``kinds`` has the classes of
    those that ``_local`` listed."""
    fields = [f for f in rows.schema.fields if f.name not in ("before", "after", "times", "kinds")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            moved, members = (batch.column(c).to_numpy().copy() for c in ("moved", "members"))
            for i, (listed, before, after, times) in enumerate(zip(*(batch.column(c) for c in ("kinds", "before", "after", "times")))):
                if listed.is_valid and len(listed):
                    at, kind = (f.to_numpy() for f in listed.values.flatten())
                    kinds = np.empty(len(kind), np.int64)
                    kinds[at] = kind
                    x, y = (z.values.to_numpy() for z in (before, after))
                    x, y = np.where(x < 0, kinds[-1 - np.minimum(x, -1)], x), np.where(y < 0, kinds[-1 - np.minimum(y, -1)], y)
                    moved[i] += model.moves[x, y].sum()
                    members[i] += model.members[kinds] @ times.values.to_numpy()
            made = {"moved": pa.array(moved), "members": pa.array(members)}
            yield pa.RecordBatch.from_arrays([made.get(f.name, batch.column(f.name)) for f in fields], names=[f.name for f in fields])

    return rows.mapInArrow(lean(run), T.StructType(fields))


def scored(df: DataFrame, key: str, text: str, train: Column, shape: Shape = Shape()) -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score) of each row of ``df``.

    Learns from the rows for which ``train`` holds. base_score: the sum over tokens of
    log10((c + 0.1) / (N + 0.1 * (V + 1))), with c the token's training count, N all of them, V the
    distinct ones. score: log10 probability under the model. Without any training row every
    word is unknown. ``df`` must be a stored table: it is read more than once.
    """
    chosen = df.filter(train).select(F.col(text).alias("text"))
    model, kinds = fit(chosen, "text", shape)
    rows = df.select(F.monotonically_increasing_id().alias("no"), F.col(key).alias("key"), F.col(text).alias("text"))
    docs = kept(_local(rows, model), "local-scores")
    rare = docs.select("no", F.posexplode(F.arrays_zip(F.col("rare").alias("rare"), F.col("endings").alias("ending"), F.col("times").alias("times"))).alias("at", "x"))
    rare = rare.select("no", "at", F.col("x.rare").alias("word"), F.col("x.ending").alias("ending"), F.col("x.times").alias("times"))
    n, kind = F.coalesce("n", F.lit(0)), F.coalesce("kind", F.col("ending") + F.lit(shape.classes))
    least = int(model.head.counts[-1]) if len(model.head.counts) else None
    others = kinds.filter(F.col("n") < least) if least is not None else kinds
    found = rare.join(others, "word", "left").groupBy("no").agg(
        F.sum(F.col("times") * F.log10(n + DELTA)).alias("rare_log"), F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("rare_known"),
        F.collect_list(F.struct("at", kind.alias("kind"))).alias("kinds"))
    whole = _joined(docs.drop("rare", "endings").join(found, "no", "left"), model)
    log = F.col("sum_log") + F.coalesce("rare_log", F.lit(0.0))
    base = float(np.log10(model.tokens + DELTA * (model.distinct + 1)))
    return whole.select(
        F.col("key").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"), (log - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (log + F.col("moved") - F.col("members")).alias("score"))
