"""Token ids in raw shards, and a minimal perfect hash index that finds a document's ids by key.

``write`` sorts documents by key, encodes them, ends each with one id and packs them into shards:
files of raw ids, whole documents, with a directory of keys and lengths behind the ids. The index
is made from what the shards say of themselves: entries are dealt to buckets by their key's hash, and
each bucket is a minimal perfect hash (bit arrays in levels; a key's slot is the rank of its first bit
that no other key of its level shares) over parallel arrays of fingerprint, shard, offset and length. A key is
found by one hash, one rank and one comparison, however many documents there are: ``lookup`` joins keys to buckets,
``fetch`` joins places to shards and slices the ids. A key that was never written is told by its 32-bit fingerprint.

Null texts are empty and hold the end id alone. A null key comes first and is a key like others. Documents
that share a key are its copies 0, 1, ... in the order of their rows; each copy has its own entry, so a key that
many rows share is spread over tasks, shards and buckets. Only the two named columns are read, whatever others there are.
A text is encoded whole; a shard closes after ``shard_ids`` ids, so one longer text is a shard by itself. An
empty table makes an empty store. Ids are unsigned little-endian numbers of 2 bytes, or 4 where the vocabulary needs them.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.arrow import ends_of, flat, lean, mixed, ranges, steps
from factloom.llm.tables import kept

#: Ids of a shard, entries of an index bucket, bytes of text of a task.
SHARD_IDS, BUCKET, TASK_BYTES = 4 << 20, 1 << 15, 16 << 20
#: Tasks at most that share the sorted documents; beyond them, tasks get longer, not more.
TASKS = 20_000
#: Names of shards, or of buckets, up to which a search opens just those files.
FEW = 1_000
#: Distinct words that an encoder remembers, and that it hands to the library at once.
MEMORY, CHUNK = 1 << 20, 1 << 16
#: Bytes of text encoded at once: a worker holds about 20 times as many.
STEP = 4 << 20

_TAIL, _MAGIC = struct.Struct("<QQQQ"), b"FLIDS01\n"


# --- encoding ---------------------------------------------------------------------------

#: Punctuation that is cut off behind a letter or digit.
_ENDS = ".,!?;:"


def by_words(path: str) -> tuple[bool, bool]:
    """Of the tokenizer of ``path``: whether it encodes the pieces between ASCII white space independently, also where punctuation at
    their end is cut off (nothing it normalises, keeps or adds spans such a place); and whether letter case is lost."""
    import regex

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = spec["normalizer"] or {}
    normal = normal.get("normalizers", [normal] if normal else [])
    pre = spec["pre_tokenizer"] or {}
    first = pre.get("pretokenizers", [pre])[0]
    pattern = first.get("pattern", {}).get("Regex")
    apart = bool(
        all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in normal)
        and first["type"] == "Split" and first["behavior"] == "Removed" and first["invert"] and pattern
        and not any(s in m.group() for s in " \t\n\r\v\f" for a in ("", "a", ".", "1") for m in regex.finditer(pattern, f"{a}{s}{a}"))
        and not any(m.start() < len(a) < m.end() for p in _ENDS for a in ("a", "Ab", "1", "a1", "1a", "x's") for m in regex.finditer(pattern, f"{a}{p}{p}"))
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or "<" not in t["content"] or any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
        and not pre.get("add_prefix_space") and not spec.get("truncation") and not spec.get("padding"))
    return apart, any(n["type"] == "Lowercase" for n in normal)


class Encoder:
    """The ids of texts as the tokenizers library gives them, without added special tokens. Where a
    tokenizer takes words apart from each other, the library sees each distinct word once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.words, self.lower = by_words(path)
        self.width = 2 if self.model.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._clear()

    def _clear(self) -> None:
        self.code: dict[str, int] = {}
        self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, words: list[str]) -> None:
        sizes, ids = [self.sizes], [self.ids]
        for i in range(0, len(words), CHUNK):
            some = words[i: i + CHUNK]
            made = self.model.encode(some, is_pretokenized=True, add_special_tokens=False)
            sizes.append(np.bincount(np.array(made.word_ids, np.int64), minlength=len(some)))
            ids.append(np.array(made.ids, np.uint32))
        for w in words:
            self.code[w] = len(self.code)
        self.sizes, self.ids = np.concatenate(sizes), np.concatenate(ids)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each word, counted; all ids), from the pieces that many words share."""
        simple = pc.and_(pc.string_is_ascii(words), pc.invert(pc.match_substring(words, "<")))
        if self.lower:
            words = pc.if_else(simple, pc.ascii_lower(words), words)
        pieces = pc.ascii_split_whitespace(pc.replace_substring_regex(words, f"^([^<]*[A-Za-z0-9])([{_ENDS}]+)$", r"\1 \2"))
        offsets = np.asarray(pieces.offsets).astype(np.int64)
        coded = pieces.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.code) > MEMORY:
            self._clear()
        self._learn([w for w in distinct if w not in self.code])
        code = np.fromiter((self.code[w] for w in distinct), np.int64, len(distinct))[np.asarray(coded.indices)]
        sizes = self.sizes[code]
        return np.diff(ends_of(sizes)[offsets - offsets[0]]), self.ids[ranges(ends_of(self.sizes)[code], sizes)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of each text, counted; all ids)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.words:
            made = [x.ids for x in self.model.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.array([len(x) for x in made], np.int64), np.array([i for x in made for i in x], np.uint32)
        words = pc.ascii_split_whitespace(texts)
        offsets = np.asarray(words.offsets).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        sizes, ids = self._distinct(coded.dictionary)
        code = np.asarray(coded.indices)
        each = sizes[code]
        return np.diff(ends_of(each)[offsets - offsets[0]]), ids[ranges(ends_of(sizes)[code], each)]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, with the words it has seen."""
    return Encoder(path)


def encoded(encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], batch: pa.RecordBatch, size: int = STEP
            ) -> Iterator[tuple[list[str | None], np.ndarray, np.ndarray]]:
    """(keys, ids of each text, counted; all ids) of about ``size`` bytes of text at a time."""
    for step in steps(batch, "text", size):
        yield step.column("key").to_pylist(), *encode(step.column("text"))


# --- shards -----------------------------------------------------------------------------

def packed(ids: list[np.ndarray], sizes: list[int], keys: list[str | None], width: int) -> bytes:
    """A shard's bytes, but for the line end that the writer adds: ids, then keys and sizes, then how many of each."""
    data = [b"" if k is None else k.encode() for k in keys]
    lengths = np.array([-1 if k is None else len(d) for k, d in zip(keys, data)], "<i8")
    names = b"".join(data)
    body = np.concatenate(ids).astype(f"<u{width}").tobytes() if ids else b""
    return b"".join([body, np.array(sizes, "<i8").tobytes(), lengths.tobytes(), names,
                     _TAIL.pack(len(body) // width, len(keys), len(names), width), _MAGIC[:-1]])


def opened(data: bytes) -> tuple[np.ndarray, np.ndarray, list[str | None]]:
    """(ids, sizes of documents, their keys) of a shard; ValueError where it isn't whole."""
    at = len(data) - len(_MAGIC) - _TAIL.size
    if at < 0 or data[-len(_MAGIC):] != _MAGIC:
        raise ValueError("not the end of a shard")
    n_ids, n_docs, n_bytes, width = _TAIL.unpack_from(data, at)
    if at != n_ids * width + 16 * n_docs + n_bytes:
        raise ValueError("the shard isn't as long as it says")
    ids = np.frombuffer(data, f"<u{width}", n_ids)
    sizes = np.frombuffer(data, "<i8", n_docs, n_ids * width)
    lengths = np.frombuffer(data, "<i8", n_docs, n_ids * width + 8 * n_docs)
    if sizes.sum() != n_ids or np.maximum(lengths, 0).sum() != n_bytes:
        raise ValueError("the shard's directory doesn't match its ids")
    names, ends = data[at - n_bytes: at], ends_of(np.maximum(lengths, 0))
    return ids, sizes, [None if n < 0 else names[a: a + n].decode() for a, n in zip(ends[:-1].tolist(), lengths.tolist())]


def write(df: DataFrame, key: str, text: str, path: str, end: int, folder: str, shard_ids: int = SHARD_IDS,
          task_bytes: int = TASK_BYTES, bucket: int = BUCKET) -> None:
    """Write the ids of every text of ``df``, in ascending order of ``key``, to new shards below ``folder``, and their index."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(TASKS, total // task_bytes + 1)
    # the row's place makes equal keys many: they are sorted, split and numbered like others
    rows = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, "key", "place").sortWithinPartitions("key", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        ids, sizes, keys, held = [], [], [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"shard": [f"s{part:06d}-{shard:06d}"], "payload": pa.array([packed(ids, sizes, keys, encode.width)], pa.binary())})

        for batch in batches:
            for names, counts, made in encoded(encode, batch, min(task_bytes, STEP)):
                ends = ends_of(counts)
                for i, name in enumerate(names):
                    ids += [made[ends[i]: ends[i + 1]], np.array([end], np.uint32)]
                    sizes.append(int(counts[i]) + 1)
                    keys.append(name)
                    held += sizes[-1]
                    if held >= shard_ids:
                        yield closed()
                        ids, sizes, keys, held, shard = [], [], [], 0, shard + 1
        if keys:
            yield closed()

    made = rows.select(F.col("key").cast("string").alias("key"), "text").mapInArrow(lean(run), "shard string, payload binary")
    # rows of the text writer are bytes as they come and one line end, which is the shard's last byte
    made.select("shard", F.col("payload").cast("string").alias("value")).write.partitionBy("shard").text(f"{folder}/shards")
    _indexed(df.sparkSession, folder, bucket)


def _files(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    """(shard, content) of the shards, or of those named."""
    paths = [f"{folder}/shards"] if names is None else [f"{folder}/shards/shard={n}" for n in names]
    if names == []:
        return spark.createDataFrame([], "shard string, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(paths).select(
        F.regexp_extract("path", "shard=([^/]+)", 1).alias("shard"), "content")


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, number, key, offset, n) of every document, as the shards say themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not shard:
                    continue  # what the writer leaves for an empty table
                _, sizes, keys = opened(content.as_py())
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(keys), pa.string()), "number": pa.array(np.arange(len(keys))),
                                                  "key": pa.array(keys, pa.string()), "offset": pa.array(ends_of(sizes)[:-1]), "n": pa.array(sizes.astype(np.int64))})

    return _files(spark, folder).mapInArrow(run, "shard string, number long, key string, offset long, n long")


# --- the index --------------------------------------------------------------------------

def _level(h: np.ndarray, level: int, size: int) -> np.ndarray:
    step = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return (mixed(h + step) % np.uint64(size)).astype(np.int64)


def perfect(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sizes of the levels, words of their bits) of a minimal perfect hash of distinct 64-bit hashes."""
    sizes, words, rest = [], [], h
    while len(rest):
        if len(sizes) == 128:
            raise ValueError("two keys have the same hash")
        size = max(64, -(-2 * len(rest) // 64) * 64)
        at = _level(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        rest = rest[~alone[at]]
    return np.array(sizes, np.int64), np.concatenate([*words, np.zeros(0, "<u8")]).astype(np.uint64)


def slots(h: np.ndarray, sizes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Each hash's slot; -1 where no level has a bit for it. Any other hash than those indexed may get any slot."""
    out, rest, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    ranks = ends_of(np.bitwise_count(words))
    for level, size in enumerate(sizes.tolist()):
        at = _level(h[rest], level, size) + base
        word, bit = words[at >> 6], (at & 63).astype(np.uint64)
        hit = (word >> bit & np.uint64(1)).astype(bool)
        below = word & ((np.uint64(1) << bit) - np.uint64(1))
        out[rest[hit]] = (ranks[at >> 6] + np.bitwise_count(below))[hit]
        rest, base = rest[~hit], base + size
    return out


def _hashes(buckets: int) -> list[Column]:
    """Bucket, hash within it and fingerprint of (key, copy)."""
    parts = ["copy", F.coalesce(F.col("key"), F.lit("")), F.col("key").isNull()]
    own = F.xxhash64(F.lit(1), *parts)
    return [F.pmod(F.xxhash64(F.lit(0), *parts), F.lit(buckets)).cast("int").alias("bucket"), own.alias("h"),
            F.xxhash64(F.lit(2), *parts).bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark")]


_ENTRIES = "bucket int, n int, sizes binary, words binary, marks binary, names array<string>, name_of binary, offsets binary, lengths binary"


def _bucket(rows: pa.Table) -> pa.Table:
    h = rows["h"].to_numpy().astype(np.int64).view(np.uint64)
    sizes, words = perfect(h)
    place = np.argsort(slots(h, sizes, words))
    names = rows["shard"].combine_chunks().dictionary_encode()
    if isinstance(names, pa.ChunkedArray):
        names = names.combine_chunks()
    made = {"bucket": pa.array([rows["bucket"][0].as_py()], pa.int32()), "n": pa.array([len(h)], pa.int32()), "sizes": [sizes.tobytes()], "words": [words.tobytes()],
            "marks": [rows["mark"].to_numpy()[place].astype("<u4").tobytes()], "names": pa.array([names.dictionary.to_pylist()], pa.list_(pa.string())),
            "name_of": [np.asarray(names.indices)[place].astype("<u4").tobytes()], "offsets": [rows["offset"].to_numpy()[place].astype("<i8").tobytes()],
            "lengths": [rows["n"].to_numpy()[place].astype("<i8").tobytes()]}
    return pa.table({c: v if isinstance(v, pa.Array) else pa.array(v, pa.binary()) for c, v in made.items()})


def _indexed(spark: SparkSession, folder: str, bucket: int) -> None:
    entries = kept(directory(spark, folder), "ids-directory")
    # where each shard begins among all ids and documents: its task's beginning, then its own within the task
    held = kept(entries.groupBy("shard").agg(F.sum("n").alias("n_ids"), F.count("*").alias("n_docs")).withColumn("part", F.substring("shard", 1, 7)), "ids-shards")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = held.groupBy("part").agg(F.sum("n_ids").alias("i"), F.sum("n_docs").alias("d")).select(  # TASKS rows at most
        "part", F.coalesce(F.sum("i").over(before), F.lit(0)).alias("i"), F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumns({"a": F.coalesce(F.sum("n_ids").over(inside), F.lit(0)), "b": F.coalesce(F.sum("n_docs").over(inside), F.lit(0))})
    held.join(parts, "part").select("shard", "n_ids", "n_docs", (F.col("i") + F.col("a")).alias("first_id"), (F.col("d") + F.col("b")).alias("first_doc")
                                    ).write.parquet(f"{folder}/starts")
    starts = shards(spark, folder)
    entries = entries.join(starts.select("shard", "first_doc"), "shard").withColumn("doc", F.col("first_doc") + F.col("number"))
    # documents are in order of their keys: those of one key lie side by side
    again = kept(entries.groupBy("key").agg(F.min("doc").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "ids-copies")
    entries = entries.join(again.select(F.col("key").alias("again"), "first"), F.col("key").eqNullSafe(F.col("again")), "left")
    entries = entries.withColumn("copy", F.coalesce(F.col("doc") - F.col("first"), F.lit(0)))
    buckets = (starts.agg(F.sum("n_docs")).first()[0] or 0) // bucket + 1
    made = entries.select(*_hashes(buckets), "shard", "offset", "n").groupBy("bucket").applyInArrow(_bucket, _ENTRIES)
    made.withColumn("buckets", F.lit(buckets)).write.parquet(f"{folder}/index")


def shards(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, n_ids, n_docs, first_id, first_doc) of each shard."""
    return spark.read.schema("shard string, n_ids long, n_docs long, first_id long, first_doc long").parquet(f"{folder}/starts")


def _few(df: DataFrame, name: str) -> list | None:
    """The distinct values of a column if they are FEW, else None."""
    found = [r[0] for r in df.filter(F.col(name).isNotNull()).select(name).distinct().limit(FEW + 1).collect()]
    return found if len(found) <= FEW else None


_PLACES = "key string, copy long, shard string, offset long, n long"


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """(key, copy, shard, offset, n) of each row of ``keys`` (key string, copy long): where its ids are; nulls where
    the store has no such copy. A row that repeats is answered once."""
    spark = keys.sparkSession
    index = spark.read.schema(f"{_ENTRIES}, buckets int").parquet(f"{folder}/index")
    head = index.select("buckets").first()
    if head is None:
        return keys.select("key", "copy").distinct().selectExpr("key", "copy", "cast(null as string) AS shard", "cast(null as bigint) AS offset", "cast(null as bigint) AS n")
    asked = keys.select("key", F.col("copy").cast("long").alias("copy")).distinct()
    asked = kept(asked.select("key", "copy", *_hashes(head[0])), "ids-asked")
    few = _few(asked, "bucket") if head[0] > FEW else None
    index = index if few is None else index.filter(F.col("bucket").isin(few))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n, h = left.num_rows, left["h"].to_numpy().astype(np.int64).view(np.uint64)
        shard, offset, size = [None] * n, np.zeros(n, np.int64), np.zeros(n, np.int64)
        found = np.zeros(n, bool)
        if right.num_rows:
            at = {c: right[c][0].as_py() for c in right.column_names}
            slot = slots(h, np.frombuffer(at["sizes"], np.int64), np.frombuffer(at["words"], np.uint64))
            marks = np.frombuffer(at["marks"], "<u4")
            found = (slot >= 0) & (marks[np.maximum(slot, 0)] == left["mark"].to_numpy().astype(np.uint32))
            slot = np.maximum(slot, 0)
            name = np.frombuffer(at["name_of"], "<u4")[slot].tolist()
            shard = [at["names"][c] for c in name]
            offset, size = np.frombuffer(at["offsets"], "<i8")[slot], np.frombuffer(at["lengths"], "<i8")[slot]
        gone = ~found
        return pa.table({"key": left["key"], "copy": left["copy"], "shard": pa.array([s if f else None for s, f in zip(shard, found.tolist())], pa.string()),
                         "offset": pa.array(offset, pa.int64(), mask=gone), "n": pa.array(size, pa.int64(), mask=gone)})

    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(run, _PLACES)


def fetch(places: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """(key, copy, shard, offset, n, crc32[, ids]) of each place that ``lookup`` found: its ids as they are in the
    shard (``payload``), and the CRC-32 of them as unsigned 32-bit numbers. Only the shards asked for are opened where they are few."""
    places = kept(places.filter("shard IS NOT NULL"), "ids-places")
    files = _files(places.sparkSession, folder, _few(places, "shard"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        offset, size = left["offset"].to_numpy(), left["n"].to_numpy()
        if left.num_rows and not right.num_rows:
            raise ValueError(f"no shard {left['shard'][0]}")
        ids = opened(right["content"][0].as_py())[0] if left.num_rows else np.zeros(0, "<u2")
        cut = [ids[a: a + n].astype("<u4").tobytes() for a, n in zip(offset.tolist(), size.tolist())]
        out = {c: left[c] for c in ("key", "copy", "shard", "offset", "n")} | {"crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64())}
        return pa.table(out | ({"ids": pa.array(cut, pa.large_binary()).cast(pa.binary())} if payload else {}))

    return places.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(run, f"{_PLACES}, crc32 long" + ", ids binary" * payload)
