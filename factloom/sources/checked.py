"""Ledger tables whose rows must have their parents.

Tables are bucketed and sorted by the key their children refer to, so a batch of children is
checked against all parents by shuffling the batch alone.  One writer at a time.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.operators.quality import GateError
from factloom.sources.ledger import conform
from factloom.sources.shared import settled

BUCKETS = 64


@dataclass(frozen=True)
class Parent:
    """A table that a column refers to, and the column there: its bucket key."""

    table: str
    column: str


class CheckedTables:
    """Tables below ``root``; opened again, they hold what was appended before."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root, buckets
        self._prefix = f"checked_{hashlib.sha256(root.encode()).hexdigest()[:16]}"
        self._schemas: dict[str, T.StructType] = {}

    def _name(self, table: str) -> str:
        return f"{self._prefix}_{table}"

    def declare(self, table: str, schema: T.StructType, key: str) -> None:
        """A table with these columns, bucketed by ``key``."""
        self._schemas[table] = schema
        place = posixpath.join(self.root, table).replace("'", "\\'")
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._name(table)} ({columns}) USING parquet CLUSTERED BY (`{key}`) "
                       f"SORTED BY (`{key}`) INTO {self.buckets} BUCKETS LOCATION '{place}'")

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self._name(table))

    def orphans(self, rows: DataFrame, column: str, parent: Parent) -> DataFrame:
        """(key, orphan_rows) of the rows whose parent isn't there.  A NULL refers to nothing.

        The batch is reduced to its distinct keys first, so a hot key is one row of the shuffle.
        """
        keys = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("orphan_rows"))
        parents = self.read(parent.table).select(F.col(parent.column).alias("key"))
        return keys.join(parents.hint("merge"), "key", "left_anti")

    def append(self, table: str, rows: DataFrame, parents: Mapping[str, Parent] | None = None, shown: int = 20) -> int:
        """Append a batch, or nothing of it: a NULL in a required column or a row without its parent refuses it.
        Returns how many rows there were."""
        batch = settled(conform(rows, self._schemas[table]), f"batch-{table}")
        for column, parent in (parents or {}).items():
            lost = self.orphans(batch, column, parent).orderBy("key").limit(shown).collect()
            if lost:
                raise GateError(f"{table}.{column}: no {parent.table} for {[r['key'] for r in lost]}")
        batch.write.insertInto(self._name(table))
        return batch.count()
