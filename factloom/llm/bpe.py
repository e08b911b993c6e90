"""Byte-level BPE: speculate and verify.

A word is first cut greedily into the longest tokens of the vocabulary. Such a proposal is
the true encoding exactly when each adjacent pair of tokens is compatible, that is, when the
merges that build the two tokens would never have merged anything across their border. All
adjacent pairs of a batch are tested at once; only words with a failing pair go through the
merges one by one. Decoding looks tokens up in a flat byte table.

The vocabulary file (``tokenizers`` JSON of a byte-level BPE) is read by each Python worker.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from factloom.llm.arrow import ends_of, flat, ranges, steps
from factloom.llm.pretoken import HASHED_BYTES, Codes, borders, hashes, per_text

#: Distinct words whose encodings a Python worker keeps; beyond it the worker starts afresh.
KEPT_WORDS = 400_000

_NEVER = np.int64(1) << 40


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, all other bytes follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """Rows of varying length, one after the other in one array that grows."""

    def __init__(self, dtype):
        self.flat, self.starts, self.used, self.rows = np.zeros(1 << 12, dtype), np.zeros(1 << 10, np.int64), 0, 0

    def append(self, values: np.ndarray, lengths: np.ndarray) -> None:
        need, rows = self.used + len(values), self.rows + len(lengths)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(need, len(self.flat)), self.flat.dtype)])
        if rows + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(rows, len(self.starts)), np.int64)])
        self.flat[self.used: need] = values
        self.starts[self.rows + 1: rows + 1] = self.used + np.cumsum(lengths)
        self.used, self.rows = need, rows

    def gather(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, lengths) of the picked rows."""
        starts = self.starts[picked]
        lengths = self.starts[picked + 1] - starts
        return self.flat[ranges(starts, lengths)], lengths


class ByteBPE:
    """Encoder and decoder of one vocabulary file.

    Inside, tokens are numbered by the order in which merges make them (bytes first), so a
    smaller number is always merged earlier; ``outer`` has the file's ids.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, letters = held["model"], _byte_letters()
        pre, special = held.get("pre_tokenizer") or {}, held.get("added_tokens") or []
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or held.get("normalizer"):
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in special):
            raise ValueError(f"{path} has added tokens that take in their surroundings")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        order = sorted(letters, key=letters.get) + [a + b for a, b in merges]
        inner = {t: i for i, t in enumerate(order)}
        self.left = np.arange(len(order), dtype=np.int64)
        self.right = self.left.copy()
        for i, (a, b) in enumerate(merges):
            self.left[256 + i], self.right[256 + i] = inner[a], inner[b]
        self.pairs = {(inner[a], inner[b]): 256 + i for i, (a, b) in enumerate(merges)}
        keys = np.fromiter((a << 32 | b for a, b in self.pairs), np.int64, len(self.pairs))
        by = np.argsort(keys)
        self.keys, self.made = keys[by], np.fromiter(self.pairs.values(), np.int64, len(keys))[by]
        words = [bytes(letters[c] for c in t) for t in order]
        self.outer = np.array([model["vocab"][t] for t in order], np.int64)

        # a token may be proposed if its own two halves would never merge otherwise
        mergeable = np.arange(256, len(order))
        sound = self.compatible(self.left[256:], self.right[256:], mergeable)
        self.proposed = {w: i for i, w in enumerate(words[:256])} | {words[i]: int(i) for i in mergeable[sound]}
        self.reach: dict[bytes, int] = {}  # by its first two bytes, the longest token
        for w in self.proposed:
            if self.reach.get(w[:2], 0) < len(w):
                self.reach[w[:2]] = len(w)

        self.special = {t["content"].encode(): t["id"] for t in special}
        self.border = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if special else None
        self.width = {i: len(w) for w, i in self.special.items()}
        top = max([int(self.outer.max()), *self.special.values()]) + 1
        text = [b""] * top
        for i, w in enumerate(words):
            text[self.outer[i]] = w
        for w, i in self.special.items():
            text[i] = w
        self.bytes, self.decimals = Table(np.uint8), Table(np.uint8)
        for made, rows in ((self.bytes, text), (self.decimals, [b"%d," % i for i in range(top)])):
            made.append(np.frombuffer(b"".join(rows), np.uint8), np.fromiter(map(len, rows), np.int64, top))
        self._fresh()

    def _fresh(self) -> None:
        self.codes, self.ids = Codes(), Table(np.int32)

    # the method ------------------------------------------------------------

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match, as inner numbers."""
        out, at, n, held, reach = [], 0, len(word), self.proposed, self.reach
        while at < n:
            size = min(n - at, reach.get(word[at: at + 2], 1))
            while (token := held.get(word[at: at + size])) is None:
                size -= 1
            out.append(token)
            at += size
        return out

    def made_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What merging each pair makes; beyond all tokens where there is no such merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair, whether ``a`` and ``b`` stay two tokens beside each other.

        Undoes merges backwards in time, the later of the two pieces at the border first. A
        merge of the two pieces at hand that comes before either went into something larger
        (``limit``) would have happened instead. Of equal merges the left one comes first.
        """
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        limit = np.full(len(a), _NEVER) if limit is None else np.array(limit, np.int64)
        out, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            broken = self.made_of(x, y) < most
            out[live[broken]] = False
            going = ~broken & (np.maximum(x, y) >= 256)
            live, x, y = live[going], x[going], y[going]
            left = x > y
            limit[live] = np.where(left, x, y + 1)
            a[live] = np.where(left, self.right[x], x)
            b[live] = np.where(left, y, self.left[y])
        return out

    def merged(self, words: list[bytes]) -> list[list[int]]:
        """The merges themselves: in each round every word does its earliest one, the leftmost
        of equals, until no word has any left."""
        out: list = [None] * len(words)
        owner = [i for i, w in enumerate(words) if len(w) <= 256]
        for i, w in enumerate(words):
            if len(w) > 256:
                out[i] = self._merged_long([*w])
        lengths = np.array([len(words[i]) for i in owner], np.int64)
        parts = np.frombuffer(b"".join(words[i] for i in owner), np.uint8).astype(np.int64)
        owner, ends = np.array(owner, np.int64), ends_of(lengths)
        made = np.full(len(parts), _NEVER)
        inside = np.ones(len(parts), bool)
        inside[ends[1:] - 1] = False
        inside = np.flatnonzero(inside)
        made[inside] = self.made_of(parts[inside], parts[inside + 1])
        while len(owner):
            best = np.minimum.reduceat(made * (1 << 20) + (np.arange(len(parts)) - np.repeat(ends[:-1], lengths)), ends[:-1])
            at, best = ends[:-1] + (best & ((1 << 20) - 1)), best >> 20
            done = best >= _NEVER
            for w in np.flatnonzero(done):
                out[owner[w]] = parts[ends[w]: ends[w + 1]].tolist()
            at, best, going = at[~done], best[~done], np.flatnonzero(~done)
            parts[at] = best
            follows = at + 2 < ends[going + 1]
            made[at] = _NEVER
            made[at[follows]] = self.made_of(best[follows], parts[at[follows] + 2])
            leads = at > ends[going]
            made[at[leads] - 1] = self.made_of(parts[at[leads] - 1], best[leads])
            stay = np.repeat(~done, lengths)
            stay[at + 1] = False
            parts, made = parts[stay], made[stay]
            owner, lengths = owner[going], lengths[going] - 1
            ends = ends_of(lengths)
        return out

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same with a heap of pairs over a linked list, for very long words."""
        import heapq

        n, pairs = len(parts), self.pairs
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(pairs[p], i, *p) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
        heapq.heapify(heap)
        while heap:
            made, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (new := pairs.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (new, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each word): propose, verify, repair."""
        made = [self.propose(w) for w in words]
        counts = np.fromiter(map(len, made), np.int64, len(made))
        tokens = np.fromiter((t for m in made for t in m), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(made)), counts)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        failing = inside[~self.compatible(tokens[inside], tokens[inside + 1])]
        if len(failing):
            failing = np.unique(owner[failing])
            for w, exact in zip(failing, self.merged([words[w] for w in failing])):
                made[w] = exact
            counts = np.fromiter(map(len, made), np.int64, len(made))
            tokens = np.fromiter((t for m in made for t in m), np.int64, int(counts.sum()))
        return self.outer[tokens], counts

    # texts -----------------------------------------------------------------

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of each word in ``self.ids``, offsets of the texts in their words)."""
        if self.codes.used > KEPT_WORDS or self.ids.rows > 2 * KEPT_WORDS:
            self._fresh()
        starts = borders(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        keys = hashes(data, starts, lengths)
        found = self.codes.find(keys)
        long = lengths > HASHED_BYTES
        found[long] = -1
        new = np.flatnonzero(found < 0)
        if len(new):
            brief = new[~long[new]]
            _, first, back = np.unique(keys[brief], return_index=True, return_inverse=True)
            long = np.flatnonzero(long)
            todo, text = np.concatenate([brief[first], long]), data.tobytes()
            rows = self.ids.rows + np.arange(len(todo))
            self.ids.append(*self.encode_words([text[a: a + n] for a, n in zip(starts[todo].tolist(), lengths[todo].tolist())]))
            self.codes.add(keys[brief[first]], rows[: len(first)])
            found[brief], found[long] = rows[back], rows[len(first):]
        return found, per_text(starts, offsets)

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the special tokens in ``data``: (first bytes, ids). None spans two texts."""
        text = data.tobytes()
        if self.border is None or not any(w in text for w in self.special):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = [(m.start() + int(a), self.special[m.group()]) for a, b in zip(offsets, offsets[1:]) for m in self.border.finditer(text[a:b])]
        return np.array([f[0] for f in found], np.int64), np.array([f[1] for f in found], np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(token ids one after the other, offsets of the texts in them) of UTF-8 texts.

        A special token's text counts as that token wherever it stands.
        """
        at, special = self._pieces(data, offsets)
        cuts = offsets
        if len(at):  # pieces: what stands between the texts' ends and the special tokens
            cuts = np.unique(np.concatenate([offsets, at, at + [self.width[s] for s in special]]))
        rows, by_cut = self.rows(data, cuts)
        ids, counts = self.ids.gather(rows)
        by_cut = ends_of(counts)[by_cut]
        if len(at):
            piece = np.searchsorted(cuts, at)
            keep = np.ones(len(ids), bool)
            keep[ranges(by_cut[piece] + 1, np.diff(by_cut)[piece] - 1)] = False
            ids[by_cut[piece]] = special
            ids, by_cut = ids[keep], np.append(0, np.cumsum(keep))[by_cut]
        return ids, by_cut[np.searchsorted(cuts, offsets)]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        if len(self._pieces(data, offsets)[0]):
            return np.diff(self.encode(data, offsets)[1])
        rows, by_text = self.rows(data, offsets)
        return np.diff(ends_of(self.ids.starts[rows + 1] - self.ids.starts[rows])[by_text])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts of token ids; bytes that aren't UTF-8 become U+FFFD."""
        data, lengths = self.bytes.gather(ids)
        ends = ends_of(lengths)[offsets]
        data = data.tobytes()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]

    def decimal(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each text in decimal, joined by commas."""
        data, lengths = self.decimals.gather(ids)
        ends = ends_of(lengths)[offsets]
        data = data.tobytes()
        return [data[a: max(a, b - 1)] for a, b in zip(ends, ends[1:])]


@functools.lru_cache(maxsize=4)
def loaded(path: str) -> ByteBPE:
    return ByteBPE(path)


def encoded(df: DataFrame, text: str, path: str, ids: str = "ids", verify: str | None = None) -> DataFrame:
    """``df`` with an array column ``ids`` of the token ids of ``text``; with ``verify``, also a
    boolean column of that name: whether decoding the ids gives the text back.

    Null and empty texts get an empty array. Columns of those names are replaced; all others
    stay, repeated rows too. Texts of any length are encoded whole.
    """
    fields = [f for f in df.schema.fields if f.name not in (ids, verify)]
    checked = [T.StructField(verify, T.BooleanType())] if verify else []
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType())), *checked])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in steps(batch, text):
                ends, data = flat(part.column(text))
                found, offsets = bpe.encode(data, ends)
                made = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found, pa.int32()))]
                if verify:
                    back, raw = bpe.decode(found, offsets), data.tobytes()
                    made.append(pa.array([b.encode() == raw[x:y] for b, x, y in zip(back, ends, ends[1:])], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=schema.names)

    return df.mapInArrow(run, schema)


def decoded(df: DataFrame, ids: str, path: str, text: str = "decoded") -> DataFrame:
    """``df`` with a column ``text`` that holds the decoded ``ids``; null ids give an empty text."""
    fields = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField(text, T.StringType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            lists = batch.column(ids)
            lengths = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            made = bpe.decode(lists.flatten().to_numpy(zero_copy_only=False), ends_of(lengths))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(made, pa.string())], names=[*names, text])

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded.

    The digests are lower-case hex of the comma-joined decimal ids and of the decoded text in
    UTF-8. Null texts count as empty: no tokens, digests of nothing. One row per input row.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in steps(batch, text):
                ids, offsets = bpe.encode(*flat(part.column(text))[::-1])
                yield pa.RecordBatch.from_arrays([
                    part.column(key), pa.array(np.diff(offsets), pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in bpe.decimal(ids, offsets)], pa.string()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in bpe.decode(ids, offsets)], pa.string()),
                ], names=schema.names)

    return df.select(key, text).mapInArrow(run, schema)


def counted(df: DataFrame, text: str, path: str, count: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` but with the number of its tokens; null counts as empty."""
    fields = [f for f in df.schema.fields if f.name not in (text, count)]
    schema = T.StructType([*fields, T.StructField(count, T.LongType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in steps(batch, text):
                offsets, data = flat(part.column(text))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(bpe.count(data, offsets), pa.int64())], names=[*names, count])

    return df.mapInArrow(run, schema)


