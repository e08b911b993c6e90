"""Pages of a stored table by position or by key, without sorting it again.

``PageIndex.build`` sorts a table once into files of ``rows_per_file`` rows and writes down, for each
file, its first key and how many rows come before it.  A page opens only the files that hold it: at most two
where a file has as many rows as the page (the last file of a task, of which each writes many, may have fewer).  Rows that are equal in the key are in the order of their hash, so every
page of a table is the same each time.  Keys order as Spark orders them: NULL first.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.schema import DEFAULT_PAGE_LIMIT

ROWS_PER_FILE, FILES = 1 << 18, 20_000
#: Rows that a task sorts, about, and tasks at most: every task costs the driver a sample of its keys.
TASK_ROWS, TASKS = 1 << 19, 1 << 16
#: Files of a task, in a file's number: FILES and the last at most.
_FILE_BITS = 15
#: Row numbers within a file, in ``monotonically_increasing_id``.
_ROW_BITS = 33


class PageIndex:
    """Sorted files of one table below ``folder``; never changed once built."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], schema: T.StructType):
        self.spark, self.keys, self.schema = spark, list(keys), schema
        self._rows, self._index = posixpath.join(folder, "rows"), posixpath.join(folder, "index")

    @classmethod
    def build(cls, rows: DataFrame, folder: str, keys: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> PageIndex:
        """Sort ``rows``, which are read twice, into new files below ``folder``."""
        made = cls(rows.sparkSession, folder, keys, rows.schema)
        held = rows.count()
        # not more files than FILES and one a task; whole files a task
        size = max(1, rows_per_file, -(-held // FILES))
        tasks = min(TASKS, held // max(TASK_ROWS, size) + 1)
        tie = F.xxhash64(*rows.columns)
        order = [*(F.col(k) for k in keys), tie]
        place = F.monotonically_increasing_id()
        placed = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_place", place)
        row = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        file = F.shiftleft(F.shiftright("_place", _ROW_BITS), _FILE_BITS) + F.floor(row / size)
        placed = placed.withColumns({"_file": file.cast("int"), "_row": row % size}).drop("_place")
        placed.write.partitionBy("_file").parquet(made._rows)
        held = made._stored().groupBy("_file").agg(F.min(F.struct(*keys)).alias("first"), F.count(F.lit(1)).alias("n"))
        counted = sorted(held.collect(), key=lambda r: r["_file"])  # a row a file: FILES at most
        out, before = [], 0
        for r in counted:
            out.append((r["_file"], r["first"], r["n"], before))
            before += r["n"]
        made.spark.createDataFrame([(*r, before) for r in out], made._index_schema()).coalesce(1).write.parquet(made._index)
        return made

    def _index_schema(self) -> T.StructType:
        first = T.StructType([self.schema[k] for k in self.keys])
        return T.StructType([T.StructField("_file", T.IntegerType()), T.StructField("first", first), T.StructField("n", T.LongType()),
                             T.StructField("start", T.LongType()), T.StructField("total", T.LongType())])

    def _stored(self, files: list[int] | None = None) -> DataFrame:
        """All rows, or those of some files: no other folder is even listed."""
        fields = [*self.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_file", T.IntegerType())]
        if files == []:
            return self.spark.createDataFrame([], T.StructType(fields))
        paths = [self._rows] if files is None else [posixpath.join(self._rows, f"_file={f}") for f in files]
        return self.spark.read.schema(T.StructType(fields)).option("basePath", self._rows).parquet(*paths)

    def index(self) -> DataFrame:
        return self.spark.read.schema(self._index_schema()).parquet(self._index)

    def total(self) -> int:
        head = self.index().select("total").first()
        return head["total"] if head else 0

    def _key(self, after: dict) -> Column:
        missing = set(self.keys) - set(after)
        if missing:
            raise ValueError(f"after needs every key column, missing {sorted(missing)}")
        return F.struct(*[F.lit(after[k]).cast(self.schema[k].dataType).alias(k) for k in self.keys])

    def page(self, limit: int = DEFAULT_PAGE_LIMIT, offset: int = 0, after: dict | None = None) -> DataFrame:
        """``limit`` rows from ``offset`` on, or behind the key ``after`` (and then ``offset`` more), in order, with the ``total``."""
        if limit < 0 or offset < 0:
            raise ValueError("limit and offset must not be negative")
        index = self.index()
        seen = None if after is None else self._key(after)
        base = 0
        if seen is not None:
            # the last file that begins at or before the key has the first row behind it, or the next file begins with it
            found = index.filter(F.col("first") <= seen).agg(F.max("start").alias("start")).first()["start"]
            begun = 0 if found is None else found
            near = self._files(index.filter(F.col("start") == begun))
            passed = near.filter(F.struct(*self.keys) <= seen).count() if found is not None else 0
            base = begun + passed
        low, high = base + offset, base + offset + limit
        rows = self._files(index.filter((F.col("start") < high) & (F.col("start") + F.col("n") > low)))
        rows = rows.filter((F.col("_at") >= low) & (F.col("_at") < high))
        return rows.orderBy("_at").select(*self.schema.fieldNames(), F.lit(self.total()).cast("bigint").alias("total"))

    def _files(self, index: DataFrame) -> DataFrame:
        """The rows of the chosen files, each with its position ``_at`` in the table."""
        chosen = {r["_file"]: r["start"] for r in index.select("_file", "start").collect()}
        rows = self._stored(list(chosen))
        start = F.lit(0).cast("bigint")
        for file, before in chosen.items():
            start = F.when(F.col("_file") == file, F.lit(before).cast("bigint")).otherwise(start)
        return rows.withColumn("_at", start + F.col("_row"))
