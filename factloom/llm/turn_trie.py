"""The prefix trie of conversations, from vertical bitmaps.

Conversations in order of their ids are cut into shards of ``SHARD`` neighbours, and their turns into slices of
``SLICE`` positions. A task has one slice of one shard: its postings map (position, turn) to the bitset of the conversations that have that
turn there, and a depth-first walk intersects a node's bitset with the postings of the next position, which gives its children, their counts
by popcount and the list of those that end. A node is the same in all shards by its prefix: the exclusive or of 128-bit hashes of (position,
turn), so a slice needs of the slices above it only each conversation's hash so far. Shards' nodes are added up by that hash. Since shards are in
order of ids, a node's ends are its shards' lists one after the other.

What a subtree adds up to follows from its members: each node belongs to its smallest member, so a subtree holds all that its members own, but
for what its own smallest member owns above it. A second walk adds up the members' shares, again by popcounts: of the bitset of those that own a leaf, and of bit planes of
what they own.

Null roles and texts are empty; rows without a conversation id take no part. Turns are in order of ``turn``, null first, then role and text; rows that repeat are turns of their own.
A conversation without turns ends at the root. Texts count whole, whatever their length. An empty table has no node. Only the four named columns are
read, whatever others there are. A conversation that holds a third of all turns, or a turn that a third of all conversations begin with, is spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.tables import crc32_mod, kept

#: Conversations of a shard and positions of a slice: what one task's bitmaps span.
SHARD, SLICE = 1024, 64
#: Bytes of turns that a sorting task is dealt, and tasks at most.
TASK_BYTES, TASKS = 16 << 20, 20_000


# --- turns in order ---------------------------------------------------------------------

def turns(df: DataFrame, conv: str, turn: str, role: str, text: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(conv, ord, pos, a, b, size): each turn's position, its conversation's place among all, its hashes and its text's bytes. Stored."""
    said = df.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    total = said.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    said = said.withColumns({"place": F.monotonically_increasing_id(), "a": F.xxhash64(F.lit(1), "role", "text"), "b": F.xxhash64(F.lit(2), "text", "role"),
                             "size": F.octet_length("text").cast("long")})
    order = ["conv", "turn", "role", "text", "place"]
    said = said.repartitionByRange(min(TASKS, total // task_bytes + 1), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, place, pos = TaskContext.get().partitionId(), None, -1, 0
        for batch in batches:
            c = batch.column(0).to_numpy()
            if not len(c):
                continue
            new = np.concatenate([[last is None or c[0] != last], c[1:] != c[:-1]])
            places = place + np.cumsum(new)
            row = np.arange(len(c))
            begun = np.maximum.accumulate(np.where(new, row, -1))  # -1: in an earlier batch
            at = np.where(begun >= 0, row - begun, row + pos)
            last, place, pos = c[-1], int(places[-1]), int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), part, np.int32)), batch.column(0), pa.array(places), pa.array(at), *batch.columns[1:]],
                                             names=["part", "conv", "ord", "pos", "a", "b", "size"])

    held = kept(said.select("conv", "a", "b", "size").mapInArrow(run, "part int, conv long, ord long, pos long, a long, b long, size long"), "trie-order")
    # a conversation may go on in the next task: one row a task says how far each came
    ends = held.groupBy("part").agg(F.min("conv").alias("first"), F.max("conv").alias("last"), F.max("ord").alias("ord"), F.max_by("pos", F.struct("ord", "pos")).alias("pos"))
    shifts, before, places, positions = [], None, 0, 0
    for r in sorted(ends.collect()):  # TASKS rows at most
        goes_on = r.first == before
        shifts.append((r.part, places - goes_on, positions if goes_on else 0))
        places += r.ord + 1 - goes_on
        positions = r.pos + 1 + (positions if goes_on and r.ord == 0 else 0)
        before = r.last
    shift = df.sparkSession.createDataFrame(shifts, "part int, ord_shift long, pos_shift long")
    return held.join(shift, "part").select("conv", (F.col("ord") + F.col("ord_shift")).alias("ord"),
                                           (F.col("pos") + F.when(F.col("ord") == 0, F.col("pos_shift")).otherwise(0)).alias("pos"), "a", "b", "size")


def paths(said: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns with their conversation's length ``n``; conv, ord, n of each conversation): what ``trie`` takes."""
    convs = said.groupBy("conv").agg(F.min("ord").alias("ord"), (F.max("pos") + 1).alias("n"))
    return said.join(convs.select("conv", "n"), "conv"), convs


def spliced(said: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """``paths`` of rebuilt conversations: the first crc32(id) mod ``most`` turns of c come from conversation c - c mod ``group``, as far as it
    has them, the others are its own after as many."""
    h = crc32_mod("conv", most)
    convs = said.groupBy("conv").agg(F.min("ord").alias("ord"), (F.max("pos") + 1).alias("own"))
    convs = kept(convs.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": h}), "trie-conversations")
    bases = convs.filter("conv = base").select("base", F.col("own").alias("base_own"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = convs.withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    convs = kept(convs.select("conv", "ord", "base", "h", "taken", "n"), "trie-rebuilt")
    heads = said.filter((F.col("conv") % group == 0) & (F.col("pos") < most - 1)).select(F.col("conv").alias("base"), "pos", "a", "b", "size")
    given = convs.join(heads, "base").filter("pos < taken").select("conv", "ord", "pos", "a", "b", "size", "n")
    own = said.filter(F.col("pos") >= h).join(convs.select("conv", "h", "taken", "n"), "conv")
    own = own.select("conv", "ord", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "a", "b", "size", "n")
    return own.unionByName(given), convs.select("conv", "ord", "n")


# --- bitmaps ----------------------------------------------------------------------------

_ROWS = "shard long, slice long, conv long, pos long, a long, b long, size long, last boolean"


def sliced(path: DataFrame, convs: DataFrame, shard: int, width: int) -> DataFrame:
    """A row of ``_ROWS`` for each turn, and one with pos = -1 for each conversation and slice: its prefix hash where the slice begins. Stored."""
    shards = F.expr(f"ord div {shard}").alias("shard")
    mixed = path.withColumns({"shard": shards, "slice": F.expr(f"pos div {width}"), "a": F.xxhash64(F.lit(3), "pos", "a", "b"), "b": F.xxhash64(F.lit(4), "b", "pos", "a")})
    rows = mixed.select("shard", "slice", "conv", "pos", "a", "b", "size", (F.col("pos") == F.col("n") - 1).alias("last"))
    heads = rows.select("shard", "slice", "conv", "a", "b", F.lit(False).alias("last")).unionByName(
        convs.select(shards, F.lit(0).cast("long").alias("slice"), "conv", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), (F.col("n") == 0).alias("last")))
    heads = heads.groupBy("shard", "slice", "conv").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.max("last").alias("last"))
    above = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumns({c: F.coalesce(F.bit_xor(c).over(above), F.lit(0).cast("long")) for c in "ab"})
    heads = heads.select("shard", "slice", "conv", F.lit(-1).cast("long").alias("pos"), "a", "b", F.lit(0).cast("long").alias("size"), "last")
    return kept(rows.unionByName(heads), "trie-slices")


class _Slice:
    """The bitmaps of one slice of one shard, and the walk over them. Bit i stands for the i-th smallest of its conversations."""

    def __init__(self, rows: pa.Table, width: int):
        col = {c: rows[c].to_numpy(zero_copy_only=False) for c in ("conv", "pos", "a", "b", "size", "last")}
        head = col["pos"] < 0
        order = np.argsort(col["conv"][head], kind="stable")
        self.conv, self.none = col["conv"][head][order], col["last"][head][order]  # none: without any turn
        self.entry = list(zip(col["a"][head][order].tolist(), col["b"][head][order].tolist()))
        self.number, self.first = rows["slice"][0].as_py(), rows["slice"][0].as_py() * width
        bit, pos = np.searchsorted(self.conv, col["conv"][~head]), col["pos"][~head] - self.first
        order = np.lexsort((pos, bit))
        bit, self.a, self.b, self.size = bit[order], col["a"][~head][order], col["b"][~head][order], col["size"][~head][order]
        self.begin = np.searchsorted(bit, np.arange(len(self.conv) + 1))  # a conversation's positions of a slice are without gaps
        self.lengths = np.diff(self.begin)
        pair = np.empty(len(bit), [("a", np.int64), ("b", np.int64)])
        pair["a"], pair["b"] = self.a, self.b
        _, code, count = np.unique(pair, return_inverse=True, return_counts=True)
        self.code = code.tolist()
        # postings of turns that several share; any other's is the bit of its one conversation
        self.posting: dict[int, int] = {}
        for k in np.flatnonzero(count[code] > 1).tolist():
            c = self.code[k]
            self.posting[c] = self.posting.get(c, 0) | 1 << int(bit[k])
        # by position: who goes on, who ends there
        deepest = int(self.lengths.max()) if len(self.lengths) else 0
        self.on = [self._set(self.lengths > d) for d in range(deepest + 1)]
        ends = np.zeros(len(self.conv), bool)
        ends[bit[col["last"][~head][order]]] = True
        self.ended = ends
        self.over = [self._set(ends & (self.lengths == d)) for d in range(deepest + 1)]

    @staticmethod
    def _set(where: np.ndarray) -> int:
        return int.from_bytes(np.packbits(where, bitorder="little").tobytes(), "little")

    def roots(self) -> dict[tuple[int, int], int]:
        out: dict[tuple[int, int], int] = {}
        for i, entry in enumerate(self.entry):
            out[entry] = out.get(entry, 0) | 1 << i
        return out

    def walk(self) -> Iterator[tuple[int, int, int, int, int, int, int]]:
        """(bitset, depth, a, b, parent's a, parent's b, size) of each node below the roots, depth first. A set
        of one is yielded where its conversation branches off: the rest is that conversation's own (``chain``)."""
        stack = [(bits, 0, a, b) for (a, b), bits in self.roots().items()]
        a_of, b_of, size_of, begin = self.a.tolist(), self.b.tolist(), self.size.tolist(), self.begin.tolist()
        while stack:
            bits, depth, a, b = stack.pop()
            rest = bits & self.on[depth] if depth < len(self.on) else 0
            while rest:
                i = (rest & -rest).bit_length() - 1
                k = begin[i] + depth
                child = bits & self.posting.get(self.code[k], 1 << i)
                rest &= ~child
                made = a ^ a_of[k], b ^ b_of[k]
                yield child, depth + 1, *made, a, b, size_of[k]
                if child & (child - 1):
                    stack.append((child, depth + 1, *made))

    def chain(self, i: int, depth: int, a: int, b: int) -> tuple[np.ndarray, ...]:
        """(a, b, size) of the nodes of conversation i below a node at ``depth`` that is its alone."""
        k = slice(self.begin[i] + depth, self.begin[i + 1])
        return np.bitwise_xor.accumulate(self.a[k]) ^ np.int64(a), np.bitwise_xor.accumulate(self.b[k]) ^ np.int64(b), self.size[k]

    def names(self, bits: int) -> str:
        held = np.unpackbits(np.frombuffer(bits.to_bytes(-(-len(self.conv) // 8), "little"), np.uint8), bitorder="little")[: len(self.conv)]
        return ",".join(map(str, self.conv[held.astype(bool)].tolist()))


_NODES = "shard long, a long, b long, pa long, pb long, depth long, n long, first long, size long, ends string"


def _nodes(width: int):
    def run(rows: pa.Table) -> pa.Table:
        s, out, parts = _Slice(rows, width), [], []
        shard = rows["shard"][0].as_py()
        names = [f.split()[0] for f in _NODES.split(", ")]
        if s.number == 0:
            everyone = (1 << len(s.conv)) - 1
            out.append((shard, 0, 0, None, None, 0, len(s.conv), int(s.conv[0]), 0, s.names(s._set(s.none)) or None))
            assert s.roots() == {(0, 0): everyone}
        for bits, depth, a, b, pa_, pb_, size in s.walk():
            i = (bits & -bits).bit_length() - 1
            over = bits & s.over[depth]
            alone = not bits & (bits - 1)
            out.append((shard, a, b, pa_, pb_, s.first + depth, bits.bit_count(), int(s.conv[i]), size, (str(s.conv[i]) if alone else s.names(over)) if over else None))
            if alone and s.lengths[i] > depth:
                ca, cb, sizes = s.chain(i, depth, a, b)
                m = len(ca)
                ends = np.full(m, None, object)
                if s.ended[i]:
                    ends[-1] = str(s.conv[i])
                parts.append(pa.table({"shard": np.full(m, shard), "a": ca, "b": cb, "pa": np.r_[np.int64(a), ca[:-1]], "pb": np.r_[np.int64(b), cb[:-1]],
                                       "depth": s.first + depth + 1 + np.arange(m), "n": np.ones(m, np.int64), "first": np.full(m, s.conv[i]), "size": sizes,
                                       "ends": pa.array(ends, pa.string())}))
        kinds = [pa.string() if n == "ends" else pa.int64() for n in names]
        columns = zip(*out) if out else [[]] * len(names)
        return pa.concat_tables([pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=names), *parts])

    return run


def _planes(values: np.ndarray) -> list[int]:
    return [_Slice._set((values >> k & 1).astype(bool)) for k in range(int(values.max()).bit_length() if len(values) else 0)]


_SHARES = "a long, b long, leaves long, share long"


def _shares(width: int):
    """Of each node, what its members in this shard own: leaves and saved bytes (columns ``leaf`` and ``owned`` of the heads)."""

    def run(rows: pa.Table) -> pa.Table:
        s = _Slice(rows, width)
        head = rows["pos"].to_numpy() < 0
        order = np.argsort(rows["conv"].to_numpy()[head], kind="stable")
        leaf, owned = rows["leaf"].to_numpy()[head][order], rows["owned"].to_numpy()[head][order]
        leaves, planes = s._set(leaf > 0), _planes(owned)
        out, parts = ([], [], [], []), []

        def add(bits: int, a: int, b: int) -> None:
            for held, v in zip(out, (a, b, (bits & leaves).bit_count(), sum((bits & p).bit_count() << k for k, p in enumerate(planes)))):
                held.append(v)

        if s.number == 0:
            add((1 << len(s.conv)) - 1, 0, 0)
        for bits, depth, a, b, *_ in s.walk():
            add(bits, a, b)
            i = (bits & -bits).bit_length() - 1
            if not bits & (bits - 1) and s.lengths[i] > depth:
                ca, cb, _ = s.chain(i, depth, a, b)
                parts.append(pa.table({"a": ca, "b": cb, "leaves": np.full(len(ca), leaf[i]), "share": np.full(len(ca), owned[i])}))
        return pa.concat_tables([pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b", "leaves", "share"]), *parts])

    return run


def _digests(lists: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of (a, b, shard, ends): a node's lists in order of its shards, hashed as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for a, b, ends in zip(*(c.to_pylist() for c in batch.columns)):
                if (a, b) != now:
                    if now:
                        done.append((*now, state.hexdigest()))
                    now, state = (a, b), hashlib.sha256(ends.encode())
                else:
                    state.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["a", "b", "ends_sha256"])
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=["a", "b", "ends_sha256"])

    lists = lists.repartition("a", "b").sortWithinPartitions("a", "b", "shard")
    return lists.select("a", "b", "ends").mapInArrow(run, "a long, b long, ends_sha256 string")


def _same(a: str, b: str) -> Column:
    return (F.col("a") == F.col(a)) & (F.col("b") == F.col(b))


def trie(path: DataFrame, convs: DataFrame, shard: int = SHARD, width: int = SLICE) -> DataFrame:
    """(a, b, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node.

    ``a, b``: hash of the node's turns. ``conv_id``: its smallest member. ``saved_tokens``: over its subtree, the bytes of a node's last text
    for each member beyond the first.
    """
    rows = sliced(path, convs, shard, width)
    found = kept(rows.groupBy("shard", "slice").applyInArrow(_nodes(width), _NODES), "trie-shard-nodes")
    nodes = found.groupBy("a", "b").agg(F.min("first").alias("conv_id"), F.min("depth").alias("depth"), F.min("pa").alias("pa"), F.min("pb").alias("pb"),
                                        F.sum("n").alias("n_convs"), ((F.sum("n") - 1) * F.max("size")).alias("saved"))
    nodes = kept(nodes, "trie-nodes")
    kids = nodes.filter("pa IS NOT NULL").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb")).agg(F.count("*").alias("n_children"))
    nodes = kept(nodes.join(kids, _same("ka", "kb"), "left").drop("ka", "kb").fillna(0, ["n_children"]), "trie-children")

    owned = nodes.groupBy("conv_id").agg(F.sum("saved").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    heads = rows.filter("pos < 0").join(owned.withColumnRenamed("conv_id", "conv"), "conv", "left").fillna(0, ["owned", "leaf"])
    others = rows.filter("pos >= 0").withColumns({c: F.lit(0).cast("long") for c in ("owned", "leaf")})
    shares = heads.unionByName(others).groupBy("shard", "slice").applyInArrow(_shares(width), _SHARES)
    shares = shares.groupBy(F.col("a").alias("sa"), F.col("b").alias("sb")).agg(F.sum("leaves").alias("n_leaves"), F.sum("share").alias("share"))

    # what a node's smallest member owns above it: slices of its chain first, then within the slice
    links = nodes.select("a", "b", "conv_id", "depth", "saved", F.expr(f"depth div {width}").alias("slice"))
    sums = links.groupBy("conv_id", "slice").agg(F.sum("saved").alias("saved"))
    higher = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv_id", "slice", F.coalesce(F.sum("saved").over(higher), F.lit(0)).alias("before"))
    inside = Window.partitionBy("conv_id", "slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    above = links.join(sums, ["conv_id", "slice"]).select(F.col("a").alias("oa"), F.col("b").alias("ob"),
                                                         (F.col("before") + F.coalesce(F.sum("saved").over(inside), F.lit(0))).alias("above"))

    ends = _digests(found.filter("ends IS NOT NULL").select("a", "b", "shard", "ends"))
    ends = ends.select(F.col("a").alias("ea"), F.col("b").alias("eb"), "ends_sha256")
    parents = nodes.select(F.col("a").alias("ga"), F.col("b").alias("gb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(shares, _same("sa", "sb")).join(above, _same("oa", "ob")).join(ends, _same("ea", "eb"), "left")
    out = out.join(parents, (F.col("pa") == F.col("ga")) & (F.col("pb") == F.col("gb")), "left")
    return out.select("a", "b", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("share") - F.col("above")).alias("saved_tokens"),
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
