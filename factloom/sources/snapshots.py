"""Immutable snapshots of the fact table.

A snapshot is one Parquet folder of facts plus one header row.  The facts are
computed and written once; their digest is then read from the stored row hashes,
so it describes what is really on disk.  The header is appended last and is the
commit: a folder without one (a failed or repeated ingest) is never read.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.hashing import SLICES, digest_text, hash_slices, row_hash
from factloom.schema import DEFAULT_PAGE_LIMIT, FACT_COLUMNS, FACTS, NATURAL_KEY, SNAPSHOTS, WINDOW_MODES
from factloom.sources.pages import ROWS_PER_FILE, TASK_ROWS, TASKS, PageIndex

_HEADER = T.StructType(SNAPSHOTS.fields + [T.StructField("folder", T.StringType(), False)])
_PAGED = T.StructType([T.StructField("dataset_id", T.LongType(), False), T.StructField("folder", T.StringType(), False)])
_STORED = T.StructType(FACTS.fields + [T.StructField("row_hash", T.StringType(), False)])
#: Facts are reloaded in the order of their key; those that share one in the order of their other columns.
RELOAD_ORDER = (*NATURAL_KEY, *(c for c in FACT_COLUMNS if c not in NATURAL_KEY))


@dataclass(frozen=True)
class Written:
    dataset_id: int
    inserted: int
    content_digest: str


def _parquet_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # nothing has been written there yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)


def _digest(hashed: DataFrame) -> Row:
    """``n`` and the digest ``d`` of facts with their ``row_hash``."""
    sums = [F.sum(s).alias(f"h{i}") for i, s in enumerate(hash_slices(F.col("row_hash")))]
    return hashed.agg(F.count(F.lit(1)).alias("n"), *sums).select(
        "n", digest_text(F.col("n"), [F.col(f"h{i}") for i in range(SLICES)]).alias("d")).first()


class SnapshotStore:
    """Snapshots below one root folder; one writer at a time."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self._headers = posixpath.join(root, "snapshots")
        self._facts = posixpath.join(root, "facts")
        self._paged = posixpath.join(root, "paged")

    def headers(self) -> DataFrame:
        return _parquet_or_empty(self.spark, self._headers, _HEADER)

    def find(self, digest: str) -> int | None:
        """Newest live snapshot with this digest."""
        return find_snapshot(self.headers(), digest).first()["dataset_id"]

    def write(self, facts: DataFrame, period_label: str, window_mode: str,
              source_files: list[str], normaliser_ver: str) -> Written:
        """Store the facts as a new snapshot, or return the one that holds them.

        Facts as many as those of a live snapshot are hashed before anything is written, so facts that are
        known leave nothing behind; all others are new, and hashed once, as they are written.  Give facts that are
        cheap to read twice (``folded``): their tasks write a file for each year they hold, so no year is one task's.
        """
        if window_mode not in WINDOW_MODES:
            raise ValueError(f"unknown window mode {window_mode!r}")
        rows = facts.select(*FACT_COLUMNS)
        hashed = rows.withColumn("row_hash", row_hash(rows))
        counts = [r[0] for r in self.headers().filter(F.col("superseded_by").isNull()).select("fact_count").distinct().collect()]
        if counts and rows.count() in counts:  # a digest is of the count too: others can't be the same
            done = _digest(hashed)
            known = self.find(done["d"])
            if known is not None:
                return Written(known, 0, done["d"])
        folder = posixpath.join(self._facts, uuid.uuid4().hex)
        # most bytes are those of hashes, which the default codec leaves as they are
        hashed.write.partitionBy("fy").option("compression", "zstd").parquet(folder)
        done = _digest(self.spark.read.schema(_STORED).parquet(folder))
        newest = self.headers().agg(F.max("dataset_id")).first()[0]
        dataset_id = (newest or 0) + 1
        header = self.spark.range(1).select(
            F.lit(dataset_id).cast("bigint").alias("dataset_id"),
            F.lit(period_label).alias("period_label"), F.lit(window_mode).alias("window_mode"),
            F.array(*map(F.lit, source_files)).alias("source_files"),
            F.lit(normaliser_ver).alias("normaliser_ver"), F.lit(done["d"]).alias("content_digest"),
            F.lit(done["n"]).cast("bigint").alias("fact_count"),
            F.lit(None).cast("bigint").alias("superseded_by"),
            F.current_timestamp().alias("created_at"), F.lit(folder).alias("folder"))
        header.write.mode("append").parquet(self._headers)
        return Written(dataset_id, done["n"], done["d"])

    def load(self, dataset_id: int, ordered: bool = True) -> DataFrame:
        """Facts of one snapshot in reload order, or as they are stored for readers that sum or sort them
        themselves; a year filter prunes to that year's files."""
        header = self.headers().filter(F.col("dataset_id") == dataset_id).first()
        if header is None:
            raise KeyError(f"no snapshot {dataset_id}")
        stored = self.spark.read.schema(_STORED).parquet(header["folder"])
        facts = stored.select(F.lit(dataset_id).cast("bigint").alias("dataset_id"),
                              *_STORED.fieldNames())
        return ordered_facts(facts, min(TASKS, header["fact_count"] // TASK_ROWS + 1)) if ordered else facts

    def pages(self, dataset_id: int, rows_per_file: int = ROWS_PER_FILE) -> PageIndex:
        """The page index of a snapshot, built when it is first asked for."""
        held = _parquet_or_empty(self.spark, self._paged, _PAGED).filter(F.col("dataset_id") == dataset_id).first()
        facts = self.load(dataset_id, ordered=False).select(*FACT_COLUMNS)
        if held is not None:
            return PageIndex(self.spark, held["folder"], NATURAL_KEY, facts.schema)
        made = posixpath.join(self._facts, f"pages-{uuid.uuid4().hex}")
        index = PageIndex.build(facts, made, NATURAL_KEY, rows_per_file)
        # appended last: an index whose build failed is never read
        self.spark.createDataFrame([(dataset_id, made)], _PAGED).write.mode("append").parquet(self._paged)
        return index

    def page(self, dataset_id: int, limit: int = DEFAULT_PAGE_LIMIT, offset: int = 0, after: dict | None = None) -> DataFrame:
        """One page of a snapshot in natural-key order, with its ``total``."""
        return self.pages(dataset_id).page(limit, offset, after)


def find_snapshot(headers: DataFrame, digest: str) -> DataFrame:
    """One row: the newest snapshot with the digest that is not superseded."""
    live = headers.filter((F.col("content_digest") == digest) & F.col("superseded_by").isNull())
    return live.agg(F.max("dataset_id").alias("dataset_id"))


def current_snapshots(headers: DataFrame) -> DataFrame:
    """Latest snapshot of each period label by creation time."""
    picked = F.max_by(F.struct(*headers.columns), F.struct("created_at", "dataset_id"))
    return headers.groupBy("period_label").agg(picked.alias("_h")).select("_h.*")


def ordered_facts(facts: DataFrame, tasks: int | None = None) -> DataFrame:
    """Stored facts in reload order, NULL first; ``tasks`` of them sort a range each, and follow one another."""
    if tasks is None:
        return facts.orderBy(*RELOAD_ORDER)
    return facts.repartitionByRange(tasks, *RELOAD_ORDER).sortWithinPartitions(*RELOAD_ORDER)
