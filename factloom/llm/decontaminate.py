"""Benchmark decontamination: find the word windows of test items in training texts.

Words are runs of letters, digits and non-ASCII bytes, with A-Z in lower case. A window is
``WINDOW`` consecutive words of an item; a shorter item is one window. The hashes of all
windows are broadcast, in blocks of ``BLOCK_BYTES`` of item text. Where there are several, each block is a
job of its own whose hits are written down before its broadcast is destroyed and the next is made, so that what driver and
workers hold is bounded however many items there are. Texts are scanned whole, once for each block; a hash
that matches is verified word by word.

Null and empty texts have no words. Items without words have no windows. An item without an id
goes by the empty id; rows that share an id are one item. Texts are never joined, so a
window doesn't cross two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.arrow import ends_of, flat, ranges, steps
from factloom.llm.tables import kept
from factloom.llm.words import ALNUM, Words

WINDOW = 10
BLOCK_BYTES = 8 << 20

class Needles:
    """The windows of some items, to be looked up by hash."""

    def __init__(self, items: list[str], texts: list[str]):
        self.items = sorted(set(items))
        number = {w: i for i, w in enumerate(self.items)}
        offsets, data = flat(pa.array(texts, pa.string()))
        words = Words(data, offsets, ALNUM)
        sizes = np.diff(words.by_text)
        found: dict[int, dict[bytes, tuple[int, set]]] = {}
        for size in {int(s) for s in np.minimum(sizes, WINDOW)} - {0}:
            hashes, held = words.windows(size), found.setdefault(size, {})
            for t in np.flatnonzero(np.minimum(sizes, WINDOW) == size):
                for w in range(words.by_text[t], words.by_text[t + 1] - size + 1):
                    held.setdefault(words.text(w, size), (hashes[w], set()))[1].add(number[items[t]])
        self.by_size = {size: self._packed(held) for size, held in found.items()}

    @staticmethod
    def _packed(held: dict) -> tuple:
        texts = sorted(held, key=lambda t: held[t][0])
        hashes = np.array([held[t][0] for t in texts], np.uint64)
        owners = [sorted(held[t][1]) for t in texts]
        bits = max(10, int(np.ceil(np.log2(len(texts) * 32))))
        seen = np.zeros(1 << bits, bool)
        seen[hashes >> np.uint64(64 - bits)] = True
        return texts, hashes, ends_of(np.array([len(o) for o in owners])), np.array([i for o in owners for i in o], np.int64), seen, bits

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Verified occurrences: (first words, sizes), and (text, item) pairs as text << 32 | item."""
        at, sizes, pairs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (texts, hashes, ends, owners, seen, bits) in self.by_size.items():
            here = words.windows(size)
            maybe = np.flatnonzero(seen[here >> np.uint64(64 - bits)])
            text = np.searchsorted(words.by_text, maybe, "right") - 1
            whole = maybe + size <= words.by_text[text + 1]
            maybe, text = maybe[whole], text[whole]
            low, high = np.searchsorted(hashes, here[maybe], "left"), np.searchsorted(hashes, here[maybe], "right")
            good, needle = [], []
            for i in np.flatnonzero(low < high):
                said = words.text(maybe[i], size)
                for k in range(low[i], high[i]):  # more than one if hashes collide
                    if texts[k] == said:
                        good.append(i)
                        needle.append(k)
            good, needle = np.array(good, np.int64), np.array(needle, np.int64)
            at.append(maybe[good])
            sizes.append(np.full(len(good), size))
            counts = ends[needle + 1] - ends[needle]
            pairs.append(np.repeat(text[good], counts) << 32 | owners[ranges(ends[needle], counts)])
        return np.concatenate(at), np.concatenate(sizes), np.unique(np.concatenate(pairs))


def _spans(words: Words, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of hit words, none across texts: (first words, words after the last)."""
    n = len(words.starts)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + sizes, -1)
    hit = np.cumsum(change[:n]) > 0
    first = np.zeros(n + 1, bool)
    first[words.by_text] = True
    starts, ends = hit.copy(), hit.copy()
    starts[1:] &= ~hit[:-1] | first[1:n]
    ends[:-1] &= ~hit[1:] | first[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


_STATE = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType())),
          T.StructField("items", T.ArrayType(T.StringType())), T.StructField("cuts", T.ArrayType(T.LongType()))]


def _scan(df: DataFrame, needles: Broadcast | None, keep_text: bool) -> DataFrame:
    """(row, text[, spans, items]) to (row, [text,] n_words, spans, items, cuts).

    spans: first and last + 1 word of each hit run; cuts: the same as byte positions. Spans and items that
    are there already are added to; without needles nothing is.
    """
    before = "spans" in df.columns
    schema = T.StructType([df.schema["row"], *([df.schema["text"]] if keep_text else []), *_STATE])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = needles.value if needles is not None else Needles([], [])
        for batch in batches:
            for part in steps(batch, "text"):
                offsets, data = flat(part.column("text"))
                words = Words(data, offsets, ALNUM)
                at, sizes, pairs = held.hits(words)
                owner, names = pairs >> 32, [held.items[i] for i in pairs & 0xFFFFFFFF]
                if before:  # what earlier blocks have found
                    spans = part.column("spans")
                    pair = spans.flatten().to_numpy(zero_copy_only=False).reshape(-1, 2)
                    base = np.repeat(words.by_text[:-1], np.array([len(x) // 2 for x in spans], np.int64))
                    at, sizes = np.append(at, pair[:, 0] + base), np.append(sizes, pair[:, 1] - pair[:, 0])
                starts, ends = _spans(words, at, sizes)
                text = np.searchsorted(words.by_text, starts, "right") - 1
                counts = 2 * np.bincount(text, minlength=part.num_rows)
                listed = pa.array(ends_of(counts), pa.int32())
                spans = np.stack([starts, ends], 1) - words.by_text[text][:, None]
                cuts = np.stack([words.starts[starts], words.ends[ends - 1]], 1) - offsets[text][:, None]
                items: list = [[] for _ in range(part.num_rows)]
                for t, name in zip(owner.tolist(), names):
                    items[t].append(name)
                if before:
                    items = [sorted({*new, *old}) for new, old in zip(items, part.column("items").to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), *([part.column("text")] if keep_text else []), pa.array(np.diff(words.by_text), pa.int64()),
                    pa.ListArray.from_arrays(listed, pa.array(spans.ravel(), pa.int64())),
                    pa.array(items, pa.list_(pa.string())),
                    pa.ListArray.from_arrays(listed, pa.array(cuts.ravel(), pa.int64())),
                ], names=schema.names)

    return df.mapInArrow(run, schema)


def _parts(items: DataFrame, key: str, text: str) -> list[DataFrame]:
    """The items, ``BLOCK_BYTES`` of them at a time; one part at least."""
    items = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("key") + 16).cast("long")).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    return [items if blocks == 1 else items.filter(F.pmod(F.xxhash64("key", "text"), F.lit(blocks)) == i) for i in range(blocks)]


def _needles(part: DataFrame) -> Broadcast:
    rows = part.collect()
    return part.sparkSession.sparkContext.broadcast(Needles([r.key for r in rows], [r.text for r in rows]))


def scanned(df: DataFrame, text: str, items: DataFrame, item_key: str = "item_id", item_text: str = "text",
            keep_text: bool = False) -> DataFrame:
    """(row, [text,] n_words, spans, items, cuts) of each row of ``df``; ``row`` has its other columns."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text]).alias("row"), F.col(text).alias("text"))
    parts = _parts(items, item_key, item_text)
    if len(parts) == 1:
        return _scan(rows, _needles(parts[0]), keep_text)
    # rows are numbered once; of each block only rows with hits are written, and none of their text
    rows = kept(rows.withColumn("no", F.monotonically_increasing_id()), "scanned-rows")
    found = []
    for part in parts:
        needles = _needles(part)
        hit = _scan(rows.select(F.col("no").alias("row"), "text"), needles, False).filter(F.size("spans") > 0)
        found.append(kept(hit.select("row", "spans", "items"), "block-hits"))
        needles.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    merged = every.groupBy(F.col("row").alias("no")).agg(F.flatten(F.collect_list("spans")).alias("spans"),
                                                         F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    whole = rows.join(merged, "no", "left").select("row", "text", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"),
                                                   F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return _scan(whole, None, keep_text)


def hits(df: DataFrame, key: str, text: str, items: DataFrame) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated): one row per row of ``df``.

    Null and empty texts have 0 words and no hit, texts are scanned whole, null and repeated keys stay, a row each. Without items
    nothing is hit; an empty table gives no row. Other columns, whatever their names, aren't read.
    """
    found = scanned(df.select(key, text), text, items)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(F.col(f"row.{key}").alias(key), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def decontaminated(df: DataFrame, text: str, items: DataFrame, remove: str = "spans") -> DataFrame:
    """``df`` without contamination, its columns as they were.

    ``spans``: hit runs are cut out of the text, from the first byte of their first word to the
    last of their last one. ``documents``: rows with a hit go. A null text stays null.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove!r}")
    found = scanned(df, text, items, keep_text=True)
    if remove == "documents":
        found = found.filter(F.size("spans") == 0)
        clean = F.col("text")
    else:
        # text pieces: before the first cut, between cuts, after the last one
        raw = F.col("text").cast("binary")
        edges = F.concat(F.array(F.lit(0).cast("long")), F.col("cuts"), F.array(F.octet_length("text").cast("long")))
        pieces = F.transform(F.sequence(F.lit(0), F.size("cuts"), F.lit(2)), lambda i: F.substring(
            raw, (edges[i] + 1).cast("int"), (edges[i + 1] - edges[i]).cast("int")).cast("string"))
        clean = F.when(F.size("cuts") == 0, F.col("text")).otherwise(F.array_join(pieces, ""))
    return found.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns])
