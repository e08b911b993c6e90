"""A tree of digests over a stored table, which finds the rows in which two tables differ.

A leaf holds the rows whose key hash begins with its digits, in a folder of its own; a node's digest is the sum of
its children's, so every level is one more aggregate of the leaves.  Two trees of one depth are compared from the
root: only children of nodes that differ are looked at, and only rows of leaves that differ are read.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.hashing import SLICES, with_slices
from factloom.operators.quality import row_diff
from factloom.schema import HASH_COLUMNS, NATURAL_KEY

#: Binary digits of a level, and levels at most: 65,536 leaves.
DIGITS, DEPTH = 4, 4
ROWS_PER_LEAF = 1 << 16

_SUMS = [f"h{i}" for i in range(SLICES)]
_NODES = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("n", T.LongType()),
                       *[T.StructField(h, T.DecimalType(38, 0)) for h in _SUMS], T.StructField("level", T.IntegerType())])


def depth_for(rows: int, rows_per_leaf: int = ROWS_PER_LEAF) -> int:
    """Levels below the root for so many rows."""
    depth = 0
    while depth < DEPTH and rows > rows_per_leaf << DIGITS * depth:
        depth += 1
    return depth


class DigestTree:
    """The rows and the digests of one table below ``folder``; never changed once built."""

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, depth: int):
        self.spark, self.schema, self.depth = spark, schema, depth
        self._rows, self._nodes = posixpath.join(folder, "rows"), posixpath.join(folder, "nodes")

    @classmethod
    def build(cls, rows: DataFrame, folder: str, depth: int, key: Sequence[str] = NATURAL_KEY,
              columns: Sequence[str] = HASH_COLUMNS) -> DigestTree:
        """Store ``rows`` by leaf, and the digests of all levels.  The key decides the leaf, ``columns`` the digest."""
        if not 0 <= depth <= DEPTH:
            raise ValueError(f"depth must be from 0 to {DEPTH}")
        made = cls(rows.sparkSession, folder, rows.schema, depth)
        # a NULL in the key has its own mark: it would not change the hash
        marked = F.xxhash64(*[c for k in key for c in (F.col(k).isNull(), F.col(k))])
        leaf = F.shiftrightunsigned(marked, 64 - DIGITS * depth).cast("int") if depth else F.lit(0)
        rows.withColumn("_leaf", leaf).hint("rebalance", "_leaf").write.partitionBy("_leaf").parquet(made._rows)
        stored = with_slices(made._stored(), columns)
        sums = stored.groupBy(F.col("_leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(h).cast("decimal(38,0)").alias(h) for h in _SUMS])
        levels = F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright("node", DIGITS * (depth - i)).alias("node")) for i in range(depth + 1)])
        every = sums.withColumn("_at", F.explode(levels)).groupBy("_at.level", "_at.node").agg(
            F.sum("n").alias("n"), *[F.sum(h).cast("decimal(38,0)").alias(h) for h in _SUMS])
        every.select("node", "n", *_SUMS, "level").repartition("level").write.partitionBy("level").parquet(made._nodes)
        return made

    def _stored(self, leaves: list[int] | None = None) -> DataFrame:
        fields = [*self.schema.fields, T.StructField("_leaf", T.IntegerType())]
        if leaves == []:
            return self.spark.createDataFrame([], T.StructType(fields))
        reader = self.spark.read.schema(T.StructType(fields)).option("basePath", self._rows)
        if leaves is None:
            return reader.parquet(self._rows)
        # a leaf that holds no row has no folder
        known = {r["node"] for r in self.nodes(self.depth).filter(F.col("node").isin(leaves)).select("node").collect()}
        paths = [posixpath.join(self._rows, f"_leaf={x}") for x in leaves if x in known]
        return reader.parquet(*paths) if paths else self._stored([])

    def nodes(self, level: int) -> DataFrame:
        """(node, n, h0, h1) of one level."""
        return self.spark.read.schema(_NODES).parquet(self._nodes).filter(F.col("level") == level).drop("level")

    def differing(self, other: DigestTree) -> list[int]:
        """The leaves in which the trees differ; 16^depth at most."""
        if self.depth != other.depth:
            raise ValueError("trees of different depths")
        bad = [0]
        for level in range(self.depth + 1):
            # level 0 is the root; below, children of what differs
            near = F.shiftright("node", DIGITS).isin(bad) if level else F.lit(True)
            left, right = (t.nodes(level).filter(near) for t in (self, other))
            right = right.select(F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in ("n", *_SUMS)])
            same = F.lit(True)
            for c in ("n", *_SUMS):
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            found = left.join(right, F.col("node") == F.col("_node"), "full").filter(~same)
            bad = sorted(r[0] for r in found.select(F.coalesce("node", "_node")).collect())
            if not bad:
                break
        return bad

    def differences(self, other: DigestTree) -> DataFrame:
        """Rows (with multiplicity) that only one of the tables holds: ``surplus`` is positive for this one's."""
        bad = self.differing(other)
        return row_diff(self._stored(bad).drop("_leaf"), other._stored(bad).drop("_leaf"))
