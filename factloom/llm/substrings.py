"""Suffix-array deduplication: remove bytes of long strings that occurred before.

A string of ``length`` bytes starts at every place of every text. Two of them are compared only if
they may be equal, so texts are first reduced to anchors: the least hash among a string's
``GRAM``-byte parts. Equal strings have equal anchors, and strings that start side by side mostly share one, so
a run of them takes a row. Only runs whose anchor occurs elsewhere go on, with their bytes, and meet
under their anchor. There a Burrows-Wheeler transform of a block of runs tells which strings are
equal (``bwt``), and of equal ones the first stays. Texts are dealt out once, as a bucketed table; what is
joined to them later is places only.

Hot anchors: an anchor that a task sees many times leaves it once for the question whether it
is repeated, equal runs of a task are one row, and anchors of more than ``GROUP`` occurrences are
split by the runs' content; what is first in each part is then reduced to what is first of all.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import bwt
from factloom.llm.arrow import ends_of, flat, mixed, odd_numbers, ranges, steps
from factloom.llm.tables import kept, shared_path

LENGTH, GRAM = 100, 20
#: Occurrences of an anchor that are compared in one go, and bytes of runs in a block.
GROUP, BLOCK = 4096, 1 << 20

#: Strings of a run at most; a run is written as start * _RUN + strings.
_RUN = 128
_BASE = int(odd_numbers(1, 37)[0])
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * odd_numbers(1, 41)[0])
_FIRST = -(1 << 63)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _sliding(x: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` (minimum or maximum) of each ``width`` neighbours: of 1, 2, 4 ... and then of two such."""
    n, wide = len(x) - width + 1, 1
    while wide * 2 <= width:
        x = of(x[:-wide], x[wide:])
        wide *= 2
    return of(x[:n], x[width - wide: width - wide + n]) if wide < width else x


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string, strings, whether they may repeat one another) of the runs of strings
    that share an anchor; none crosses texts."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    # sums of letters times powers of an odd number: a part's hash is a difference, shifted back
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER[data] * _powers(_BASE, len(data)), dtype=np.uint64, out=total[1:])
    part, width = mixed((total[gram:] - total[:-gram]) * _powers(_INVERSE, len(data) - gram + 1)), length - gram + 1
    least = _sliding(part, width, np.minimum)
    # the parts that are some string's anchor; equal ones close together lie in periodic text, and
    # those ``width`` apart may still share a run: the strings at one and the next hold either
    beside = np.zeros(width - 1, np.uint64)
    held = np.flatnonzero(part == _sliding(np.concatenate([beside, least, beside]), width, np.maximum))
    held = held[np.argsort(part[held], kind="stable")]
    close = (part[held][1:] == part[held][:-1]) & (held[1:] - held[:-1] <= width)
    periodic = np.unique(part[held[1:][close]])
    ok = np.zeros(n + 1, bool)
    lengths = np.diff(offsets)
    ok[ranges(offsets[:-1], np.maximum(lengths - length + 1, 0))] = True
    ok = ok[:n]
    new = ok.copy()
    new[1:] &= ~ok[:-1] | (least[1:] != least[:-1])
    inner = offsets[(offsets > 0) & (offsets < n)]
    new[inner] |= ok[inner]
    first = np.flatnonzero(new)
    count = np.add.reduceat(ok.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    pieces = -(-count // (_RUN - 1))  # a long run of one anchor: periodic text
    start = np.repeat(first, pieces) + (_RUN - 1) * ranges(np.zeros(len(first), np.int64), pieces)
    end = np.repeat(first + count, pieces)
    anchor = np.repeat(least[first], pieces)
    return anchor, start, np.minimum(end - start, _RUN - 1), np.isin(anchor, periodic)


def _anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, turn, no, place, times): a row for each run. Of an anchor that a batch holds
    several times, the one of turn 0 stands for it; all of them are known to be repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, found = batch.column("no").to_numpy(), []
            row = 0
            for part in steps(batch, "text"):
                offsets, data = flat(part.column("text"))
                anchor, start, count, periodic = runs(data, offsets, length, gram)
                text = np.searchsorted(offsets, start, "right") - 1
                found.append((anchor, numbers[row + text], (start - offsets[text]) * _RUN + count, periodic))
                row += part.num_rows
            anchor, no, place, periodic = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(anchor, kind="stable")
            first = np.append(True, anchor[order][1:] != anchor[order][:-1])[: len(order)]
            group = np.cumsum(first) - 1
            turn = np.arange(len(order)) - np.flatnonzero(first)[group] if len(order) else order
            times = np.bincount(group, minlength=1)[group] if len(order) else order
            times = np.where(periodic[order], np.maximum(times, 2), times)
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor[order].view(np.int64)), pa.array(turn.astype(np.int32)), pa.array(no[order]), pa.array(place[order]),
                pa.array(times.astype(np.int64))], names=["anchor", "turn", "no", "place", "times"])

    return docs.select("no", "text").mapInArrow(run, "anchor long, turn int, no long, place long, times long")


def _fragments(docs: DataFrame, length: int) -> DataFrame:
    """Runs with their bytes: (anchor, part, bytes, doc, no, start). Of equal ones in a task the
    first stays. ``docs``: with arrays of anchors, places and parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in steps(batch, "text"):
                first: dict = {}
                texts = piece.column("text").cast(pa.binary()).to_pylist()
                for text, doc, no, hits in zip(texts, *(piece.column(c).to_pylist() for c in ("doc", "no", "hits"))):
                    for hit in hits:
                        start, count = divmod(hit["place"], _RUN)
                        key = (hit["anchor"], hit["parts"], text[start: start + count + length - 1])
                        new = (doc, no, start)
                        if key not in first or new < first[key]:
                            first[key] = new
                rows = [(a, (hash_of(b) % parts if parts > 1 else 0), parts, b, *where) for (a, parts, b), where in first.items()]
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                     names=["anchor", "part", "parts", "bytes", "doc", "no", "start"])

    return docs.mapInArrow(run, "anchor long, part int, parts int, bytes binary, doc long, no long, start long")


def hash_of(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def _periodic(data: bytes, length: int) -> bool:
    """Whether strings of a run may be equal: what all of them have in common then occurs again."""
    first, last = len(data) - length, length
    return first >= last or data.find(data[first:last], first + 1) >= 0


def _first_ones(rows: list[tuple], length: int) -> Iterator[tuple[int, int, int, bytes | None, int]]:
    """(no, place, doc, digest, start) of the strings of a block that no equal one precedes in it.

    As runs; one by one with a digest where their anchor is split into parts.
    """
    if not rows:
        return
    earliest: dict = {}
    for anchor, parts, data, *where in rows:
        key, new = (anchor, data), (*where, parts)
        if key not in earliest or new < earliest[key]:
            earliest[key] = new
    pieces = [data for _, data in earliest]
    doc, no, start, parts = (np.array(x, np.int64) for x in zip(*earliest.values()))
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces)) - length + 1
    # a run alone under its anchor is compared with nothing, unless it may repeat itself
    shared = Counter(anchor for anchor, _ in earliest)
    wanted = np.array([i for i, (anchor, data) in enumerate(earliest) if shared[anchor] > 1 or _periodic(data, length)], np.int64)
    piece, offset, group = bwt.repeated([pieces[i] for i in wanted], length)
    piece = wanted[piece]
    alive, ends = np.ones(int(counts.sum()), bool), ends_of(counts)
    order = np.lexsort((start[piece] + offset, no[piece], doc[piece], group))
    later = order[np.append(False, group[order][1:] == group[order][:-1])[: len(order)]]
    alive[ends[piece[later]] + offset[later]] = False
    edge = alive.copy()
    edge[1:] &= ~alive[:-1]
    inner = ends[:-1][counts > 0]
    edge[inner] |= alive[inner]
    first = np.flatnonzero(edge)
    size = np.add.reduceat(alive.astype(np.int64), first) if len(first) else first
    owner = np.searchsorted(ends, first, "right") - 1
    for f, p, n in zip(first.tolist(), owner.tolist(), size.tolist()):
        at = int(start[p]) + f - int(ends[p])
        if parts[p] == 1:
            yield int(no[p]), at * _RUN + n, int(doc[p]), None, at
        else:
            for i in range(n):
                o = f - int(ends[p]) + i
                yield int(no[p]), (at + i) * _RUN + 1, int(doc[p]), hashlib.blake2b(pieces[p][o: o + length], digest_size=16).digest(), at + i


def _survivors(fragments: DataFrame, length: int) -> DataFrame:
    """(no, place, doc, digest, start): ``_first_ones`` of all fragments, in blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

        def made() -> Iterator[pa.RecordBatch]:
            out = list(_first_ones(held, length))
            held.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["no", "place", "doc", "digest", "start"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "parts", "bytes", "doc", "no", "start"))):
                if size > BLOCK and row[:2] != last:
                    yield from made()
                    size = 0
                last = row[:2]
                size += len(row[3]) + 1
                held.append((row[0], *row[2:]))
        yield from made()

    together = fragments.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return together.mapInArrow(run, "no long, place long, doc long, digest binary, start long")


def _covered(size: int, hits: list[int], alive: list[int], length: int) -> np.ndarray:
    """Which bytes of a text go: those of all strings in ``hits`` but the ones in ``alive``."""
    change = np.zeros(size + 2, np.int64)

    def marked(places: list[int]) -> np.ndarray:
        change[:] = 0
        if places:
            start, count = np.divmod(np.array(places, np.int64), _RUN)
            np.add.at(change, start, 1)
            np.add.at(change, start + count, -1)
        return np.cumsum(change[:size]) > 0

    gone = np.flatnonzero(marked(hits) & ~marked(alive))
    change[:] = 0
    np.add.at(change, gone, 1)
    np.add.at(change, gone + length, -1)
    return np.cumsum(change[:size]) > 0


def _spans(covered: np.ndarray) -> np.ndarray:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return edges.reshape(-1, 2)


def repeats(df: DataFrame, key: str, text: str, length: int = LENGTH) -> DataFrame:
    """``df`` with ``hits`` and ``alive``: for each text the places of strings that may be
    repeated, and of those among them that are the first of their kind. Columns: no, doc, text,
    rest (a struct of the other columns), hits, alive; see ``removed`` and ``cleaned``.

    First is what starts in the smaller key, in the earlier row of equal keys, or earlier in the
    text. ``key`` is a whole number; null is smaller than all. Null texts count as empty.
    Texts shorter than ``length`` bytes have no strings. Rows that repeat are texts of their own.
    """
    spark = df.sparkSession
    gram = min(GRAM, length)
    others = [F.col(f"`{c}`") for c in df.columns if c != text]
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.monotonically_increasing_id().alias("no"), F.coalesce(F.col(key).cast("long"), F.lit(_FIRST)).alias("doc"),
                     F.col(text).alias("text"), F.struct(*others).alias("rest"))
    name = f"texts_{uuid.uuid4().hex}"
    (docs.repartition(buckets, "no").write.bucketBy(buckets, "no").format("parquet").option("compression", "zstd")
     .option("path", shared_path(spark, "texts")).saveAsTable(name))
    docs = spark.table(name)

    seen = _anchors(docs, length, gram).withColumn("held", F.expr("sum(times) OVER (PARTITION BY anchor, turn)"))
    hits = kept(seen.filter("held > 1").select("anchor", "turn", "no", "place", "held"), "repeated-anchors")
    # an anchor that may have more runs than a block takes is split
    hot = hits.filter(F.col("turn") == 0).filter(F.col("held") > GROUP).select("anchor", F.ceil(F.col("held") / GROUP).cast("int").alias("parts")).distinct()
    hits = hits.join(kept(hot, "hot-anchors"), "anchor", "left").select("no", "anchor", "place", F.coalesce("parts", F.lit(1)).alias("parts"))
    by_text = hits.groupBy("no").agg(F.collect_list(F.struct("anchor", "place", "parts")).alias("hits"))
    by_text = kept(by_text, "hits")
    fragments = _fragments(docs.select("no", "doc", "text").join(by_text, "no"), length)
    first = kept(_survivors(fragments, length), "first-strings")
    whole = first.filter("digest IS NULL").select("no", "place")
    split = first.filter("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc", "no", "start", "place")).alias("x"))
    alive = whole.union(split.select("x.no", "x.place")).groupBy("no").agg(F.collect_list("place").alias("alive"))
    places = kept(by_text.select("no", F.col("hits.place").alias("hits")).join(alive, "no", "left"), "places")
    return docs.join(places, "no", "left")


def removed(found: DataFrame, key: str, length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``repeats``."""
    schema = T.StructType([found.schema["rest"].dataType[key], T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = flat(batch.column("text"))
            out = []
            for i, (hits, alive) in enumerate(zip(batch.column("hits").to_pylist(), batch.column("alive").to_pylist())):
                text = data[offsets[i]: offsets[i + 1]]
                if hits:
                    gone = _covered(len(text), hits, alive or [], length)
                    out.append((len(text), int(gone.sum()), len(_spans(gone)), hashlib.sha256(text[~gone].tobytes()).hexdigest()))
                else:
                    out.append((len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()))
            if out:
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=schema.names)

    return found.select(F.col(f"rest.`{key}`").alias(key), "text", "hits", "alive").mapInArrow(run, schema)


def cleaned(found: DataFrame, columns: list[str], text: str, length: int = LENGTH) -> DataFrame:
    """The rows of ``repeats`` with their repeated bytes cut out of ``text``; columns as before.

    A character of which only some bytes would go stays whole. A null text stays null.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            for data, hits, alive in zip(texts, batch.column("hits").to_pylist(), batch.column("alive").to_pylist()):
                if data is not None and hits:
                    letters = np.frombuffer(data, np.uint8)
                    gone = _covered(len(data), hits, alive or [], length)
                    start = np.flatnonzero((letters & 0xC0) != 0x80)
                    whole = np.minimum.reduceat(gone, start) if len(start) else gone
                    data = letters[~np.repeat(whole, np.diff(np.append(start, len(letters))))].tobytes() if len(start) else data
                out.append(data)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, pa.binary()).cast(pa.string())], names=["rest", "text"])

    schema = T.StructType([found.schema["rest"], T.StructField("text", T.StringType())])
    made = found.select("rest", "text", "hits", "alive").mapInArrow(run, schema)
    return made.select(*[F.col("text").alias(text) if c == text else F.col(f"rest.`{c}`").alias(c) for c in columns])
