"""MinHash near-duplicates with b-bit signatures.

A text's set are its distinct ``SIZE``-word shingles, as 52-bit hashes. ``HASHES`` minima of the set
are cut into bands of ``ROWS``; texts that share a band are candidates. Of each minimum the
``BITS`` low bits are kept and packed; the share of equal ones, corrected for chance collisions,
estimates the similarity of a candidate pair by bit counts, and pairs clearly below the threshold
go. What remains is confirmed on the full sets.

A pair of similarity 0.75 shares no band with probability (1 - 0.75^4)^36, about 1e-6, and falls
below the estimate's floor (five standard deviations) with about 3e-7.

Groups of copies are never expanded. Texts with equal sets are one class from the start. In
each band bucket all classes are compared with the smallest one. Where a bucket then still
holds several components, its members meet in blocks, and of the pairs across components only
the links that join them leave the task. What is never looked at lies within one component, and a
bucket of thousands of near copies takes about a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.arrow import ends_of, flat, mixed, odd_numbers, steps
from factloom.llm.components import components
from factloom.llm.tables import kept
from factloom.llm.words import SOLID, Words

SIZE = 5
HASHES, ROWS, BITS = 144, 4, 4
#: Similarity of linked texts, in hundredths.
PERCENT = 75
#: Members of a bucket that meet in one go, or twice as many from two blocks.
BLOCK = 512

_SEEDS = odd_numbers(HASHES, 17)
_HASH_BITS = np.uint64(52)
#: Texts of a step at most, so that a text's number fits above the hash.
_STEP_TEXTS = 1 << 12


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each text one after the other, offsets).

    A text of fewer words is one shingle, one without words has none.
    """
    words = Words(data, offsets, SOLID)
    by_text = words.by_text
    counts = np.diff(by_text)
    hashes, owner = [], []
    for length in range(1, size + 1):
        texts = np.flatnonzero(counts >= size if length == size else counts == length)
        if not len(texts):
            continue
        here = words.windows(length)
        if length == size:
            text = np.repeat(np.arange(len(counts)), counts)
            at = np.flatnonzero(np.arange(len(text)) + size <= by_text[1:][text])
            hashes.append(here[at])
            owner.append(text[at])
        else:
            hashes.append(mixed(here[by_text[texts]] + np.uint64(length)))
            owner.append(texts)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(counts) + 1, np.int64)
    keys = np.concatenate(owner).astype(np.uint64) << _HASH_BITS | np.concatenate(hashes) >> np.uint64(12)
    keys.sort()
    keys = keys[np.append(True, keys[1:] != keys[:-1])]
    sizes = np.bincount((keys >> _HASH_BITS).astype(np.int64), minlength=len(counts))
    return keys & np.uint64((1 << 52) - 1), ends_of(sizes)


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    for part in steps(batch, column):
        for start in range(0, part.num_rows, _STEP_TEXTS):
            yield part.slice(start, _STEP_TEXTS)


def _signatures(shingles: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Minima of each set, one row per text; those of empty sets mean nothing."""
    starts, full = ends[:-1], np.flatnonzero(np.diff(ends))
    out = np.zeros((len(starts), HASHES), np.uint32)
    if len(full):
        spread = mixed(shingles + np.uint64(1))
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat((spread * _SEEDS[k] >> np.uint64(32)).astype(np.uint32), starts[full])
    return out


def _packed(minima: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 / BITS of them in each 64-bit number."""
    per = 64 // BITS
    low = (minima & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(minima), -1, per)
    return (low << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def _list(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1).view(np.int64), pa.int64()))


def signed(rows: DataFrame) -> DataFrame:
    """(no, key, text) to (no, key, n, digest, bands, bits): set size, digest of the set, a key for
    each band, packed low bits."""
    schema = f"no long, key {rows.schema['key'].dataType.simpleString()}, n long, digest binary, bands array<long>, bits array<long>"
    names = ["no", "key", "n", "digest", "bands", "bits"]
    two, mix = odd_numbers(2, 19), odd_numbers(ROWS, 23)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text"):
                offsets, data = flat(part.column("text"))
                shingles, ends = shingle_sets(data, offsets)
                minima = _signatures(shingles, ends)
                sums = [np.diff(np.append(np.uint64(0), np.cumsum(mixed(shingles * m + m)))[ends]) for m in two]
                digest = np.stack(sums, 1).astype(">u8").tobytes()
                grouped = minima.reshape(len(minima), -1, ROWS).astype(np.uint64)
                bands = mixed((grouped * mix).sum(axis=2, dtype=np.uint64) + np.arange(HASHES // ROWS, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([
                    part.column("no"), part.column("key"), pa.array(np.diff(ends), pa.int64()),
                    pa.array([digest[i: i + 16] for i in range(0, len(digest), 16)], pa.binary()), _list(bands), _list(_packed(minima)),
                ], names=names)

    return rows.mapInArrow(run, schema)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits: equal groups of bits, counted as bits, without the share
    that is equal by chance."""
    def differ(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        shift = 1
        while shift < BITS:
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
            shift *= 2
        return F.bit_count(z.bitwiseAND(F.lit(sum(1 << i for i in range(0, 64 - BITS, BITS)))))

    # the topmost group is looked at by itself: its mask doesn't fit a signed literal
    def top(x: Column, y: Column) -> Column:
        return (F.shiftrightunsigned(x.bitwiseXOR(y), 64 - BITS) != 0).cast("int")

    other = F.aggregate(F.zip_with(a, b, lambda x, y: differ(x, y) + top(x, y)), F.lit(0), lambda s, x: s + x)
    chance = 2.0 ** -BITS
    return ((1 - other / HASHES) - chance) / (1 - chance)


def _floor(percent: int) -> float:
    """The least estimate that a linked pair can be expected to have."""
    chance, true = 2.0 ** -BITS, percent / 100
    equal = true + (1 - true) * chance
    return true - 5 * (equal * (1 - equal) / HASHES) ** 0.5 / (1 - chance)


def _plausible(percent: int) -> Column:
    """Of a pair's set sizes (n, m) and low bits (bits, other)."""
    small, large = F.least("n", "m"), F.greatest("n", "m")
    return (small * 100 >= large * percent) & (estimate(F.col("bits"), F.col("other")) >= _floor(percent))


def _texts_of(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """(no, text) of some rows. Joined by merging at every size: ``ids`` grow with the corpus."""
    return kept(rows.select("no", "text").join(ids.distinct().hint("merge"), "no", "left_semi"), name)


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles that two sets share."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = _common(x, y)
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) those whose full sets are similar enough; ``rows``: (no, text)."""
    texts = _texts_of(rows, pairs.select(F.col("a").alias("no")).union(pairs.select("b")), "candidate-texts")
    both = (pairs.join(texts.select(F.col("no").alias("b"), F.col("text").alias("text_b")), "b")
            .join(texts.select(F.col("no").alias("a"), F.col("text").alias("text_a")), "a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "text_b"):
                numbers, first, mine = np.unique(part.column("a").to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
                sets, ends = shingle_sets(*flat(part.column("text_a").take(pa.array(first)))[::-1])
                others, other_ends = shingle_sets(*flat(part.column("text_b"))[::-1])
                good = pa.array([_alike(sets[ends[m]: ends[m + 1]], others[other_ends[i]: other_ends[i + 1]], percent) for i, m in enumerate(mine)], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _joining(table: pa.Table, percent: int) -> tuple[list[int], list[int]]:
    """Links that join the components of a block's members (b, root, slot, n, bits, text).

    Pairs of different components and plausible similarity are confirmed, the most similar
    first, until none is left whose components haven't been joined meanwhile.
    """
    number, root, slot, n = (table.column(c).to_numpy() for c in ("b", "root", "slot", "n"))
    bits = table.column("bits").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(number), -1)
    groups = np.array([int("1" * BITS, 2) << i for i in range(0, 64, BITS)], np.uint64)
    one, other, guess = [], [], []
    for i in range(len(number)):
        j = np.arange(i + 1, len(number))
        small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        j = j[(root[i] != root[j]) & (small * 100 >= large * percent) & ((slot[i] != slot[j]) | (slot.min() == slot.max()))]
        x = bits[i] ^ bits[j]
        equal = sum(((x & g) == 0).sum(1) for g in groups) / HASHES
        value = (equal - 2.0**-BITS) / (1 - 2.0**-BITS)
        good = value >= _floor(percent)
        one.append(np.full(good.sum(), i))
        other.append(j[good])
        guess.append(value[good])
    one, other, guess = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, other, guess))
    if not len(one):
        return [], []
    offsets, data = flat(table.column("text"))
    sets = []
    for start in range(0, len(number), _STEP_TEXTS):
        cut = offsets[start: start + _STEP_TEXTS + 1]
        made, ends = shingle_sets(data[cut[0]: cut[-1]], cut - cut[0])
        sets += [made[a:b] for a, b in zip(ends, ends[1:])]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    a, b, root = [], [], root.tolist()
    for p in np.argsort(-guess, kind="stable").tolist():
        i, j = int(one[p]), int(other[p])
        x, y = top(root[i]), top(root[j])
        if x != y and _alike(sets[i], sets[j], percent):
            parent[max(x, y)] = min(x, y)
            a.append(int(number[i]))
            b.append(int(number[j]))
    return a, b


def _placed(rows: DataFrame, percent: int) -> DataFrame:
    """(no, key, n, root) of ``rows`` (no, key, text): set size, and one number per component."""
    every = kept(signed(rows), "signatures")
    classes = kept(every.filter("n > 0").groupBy("digest").agg(F.min("no").alias("class")), "classes")
    reps = kept(every.join(classes.select(F.col("class").alias("no")), "no").select("no", "n", "bands", "bits"), "class-signatures")

    members = reps.select("no", F.explode("bands").alias("band"))
    firsts = kept(members.groupBy("band").agg(F.min("no").alias("a"), F.count("*").alias("size")).filter("size > 1"), "bands")
    members = kept(members.join(firsts, "band").select("band", "a", F.col("no").alias("b")), "band-members")
    signs = reps.select(F.col("no").alias("a"), F.col("n").alias("m"), F.col("bits").alias("other"))
    own = reps.select(F.col("no").alias("b"), "n", "bits")
    stars = members.filter("a != b").select("a", "b").distinct().join(own, "b").join(signs, "a").filter(_plausible(percent))
    stars = kept(stars.select("a", "b"), "star-pairs")
    linked = kept(confirmed(stars, rows, percent), "star-links")
    roots = components(linked)

    # buckets that are still more than one component, each set of members once. The members of the
    # first component are joined already; only the others meet one another and them, in blocks.
    labelled = kept(members.join(roots.select(F.col("node").alias("b"), "root"), "b", "left")
                    .select("band", "b", F.coalesce("root", "b").alias("root")), "labelled")
    buckets = labelled.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"),
                                           F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("sum"))
    open_ = buckets.filter("low != high AND size > 2").groupBy("size", "sum").agg(F.min(F.struct("band", "low")).alias("x"))
    inside = kept(labelled.join(open_.select("x.*"), "band").select("band", "b", "root", (F.col("root") == F.col("low")).alias("joined")), "open-buckets")
    sizes = inside.groupBy("band").agg(*[F.ceil(F.count_if(c) / BLOCK).cast("int").alias(n) for n, c in (("joined_slots", F.col("joined")), ("slots", ~F.col("joined")))])
    texts = _texts_of(rows, inside.select(F.col("b").alias("no")), "open-texts").withColumnRenamed("no", "b")
    whole = inside.join(sizes, "band").join(own, "b").join(texts, "b")
    hashed, last = F.xxhash64("b"), F.col("joined_slots") + F.col("slots") - 1
    slot = F.when(F.col("joined"), F.pmod(hashed, "joined_slots")).otherwise(F.col("joined_slots") + F.pmod(hashed, "slots")).cast("int")
    meets = F.sequence(F.when(F.col("joined"), F.col("joined_slots")).otherwise(F.lit(0)), last)
    whole = whole.withColumn("slot", slot).withColumn("meets", F.explode(meets))
    whole = whole.select("band", F.least("slot", "meets").alias("i"), F.greatest("slot", "meets").alias("j"), "b", "root", "slot", "n", "bits", "text")

    def block(members: pa.Table) -> pa.Table:
        a, b = _joining(members, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    more = whole.groupBy("band", "i", "j").applyInArrow(block, "a long, b long")
    roots = kept(components(linked.union(kept(more, "block-links"))), "roots")

    placed = every.select("no", "key", "n", "digest").join(classes, "digest", "left").select("no", "key", "n", F.col("class").alias("node"))
    return kept(placed.join(roots, "node", "left").select("no", "key", "n", F.coalesce("root", "node", "no").alias("root")), "placed")


def _numbered(df: DataFrame, columns: list[str]) -> DataFrame:
    """(no, row: struct of ``columns``), written down: another job may split ``df`` in another way
    and number its rows anew."""
    return kept(df.select(F.monotonically_increasing_id().alias("no"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")), "numbered-rows")


def _rows(numbered: DataFrame, key: str, text: str) -> DataFrame:
    row = F.col("row")
    return numbered.select("no", row.getField(key).alias("key"), F.coalesce(row.getField(text), F.lit("")).alias("text"))


def near_duplicates(df: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row of ``df``.

    Texts whose sets have 100 * common >= percent * union are linked; component_id is the
    smallest key that a row reaches, itself included; kept where that is its own. Null and empty
    texts, and texts without words, have no shingles and are linked with nothing. Rows are told
    apart by place, so keys may repeat or be null (a null key is no component_id unless all keys
    of a component are null). ``df`` is read once. Other columns aren't read.
    """
    placed = _placed(_rows(_numbered(df, [key, text]), key, text), percent)
    smallest = kept(placed.groupBy("root").agg(F.min("key").alias("component_id")), "component-ids")
    return placed.join(smallest, "root").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(df: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """One row of each component of ``near_duplicates``: that with the smallest key, the first in
    the table of equal keys, null last. Columns as in ``df``."""
    numbered = _numbered(df, df.columns)
    placed = _placed(_rows(numbered, key, text), percent)
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "no")).alias("first")
    stay = placed.groupBy("root").agg(first).select(F.col("first.no").alias("no"))
    return numbered.join(stay.hint("merge"), "no", "left_semi").select("row.*")
