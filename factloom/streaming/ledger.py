"""Streams over the JSON event log."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from factloom.functions.periods import epoch_micros
from factloom.sources.ledger import EVENTS, TS_FORMAT


def ledger_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New files of the event log as a stream; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(EVENTS).option("timestampNTZFormat", TS_FORMAT)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet, taking what is there now; exactly once per checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


_COMMITS = T.StructType([T.StructField("batch_id", T.LongType(), False), T.StructField("folder", T.StringType(), False)])


class OnceTable:
    """A table that takes every micro-batch once, whichever checkpoint it comes from.

    A batch's rows go to a folder of its own; the row that names the folder and the batch is
    appended last and is the commit.  A folder without one, of a run that failed, is never read, and
    a batch that is committed is not written again.  One stream writes a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.schema = spark, schema
        self._data, self._commits = posixpath.join(path, "data"), posixpath.join(path, "commits")

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as exc:  # nothing has been written there yet
            if "PATH_NOT_FOUND" not in str(exc):
                raise
            return self.spark.createDataFrame([], schema)

    def commits(self) -> DataFrame:
        return self._read(self._commits, _COMMITS)

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Whether the batch was new."""
        if not self.commits().filter(F.col("batch_id") == batch_id).isEmpty():
            return False
        folder = uuid.uuid4().hex
        rows.select(*self.schema.fieldNames()).write.parquet(posixpath.join(self._data, f"_folder={folder}"))
        self._commit(batch_id, folder)
        return True

    def _commit(self, batch_id: int, folder: str) -> None:
        self.spark.createDataFrame([(batch_id, folder)], _COMMITS).write.mode("append").parquet(self._commits)

    def read(self) -> DataFrame:
        """The rows of all committed batches."""
        rows = self._read(self._data, T.StructType([*self.schema.fields, T.StructField("_folder", T.StringType())]))
        done = self.commits().select(F.col("folder").alias("_folder"))
        return rows.join(done, "_folder", "left_semi").drop("_folder")


def append_once(stream: DataFrame, table: OnceTable, checkpoint: str) -> StreamingQuery:
    """Append a stream to ``table``, taking what is there now."""
    return stream.writeStream.foreachBatch(lambda rows, batch_id: table.append(rows, batch_id) and None).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, width: str = "1 day", delay: str = "1 hour",
                    kind: str = "op") -> DataFrame:
    """Events per window and kind.  A window is emitted once the watermark passes
    its end, so the open last window is held back; late events are dropped."""
    timed = stream.withColumn("_ts", F.timestamp_micros(epoch_micros(F.col("ts"))))
    counts = timed.withWatermark("_ts", delay).groupBy(F.window("_ts", width), kind).agg(
        F.count(F.lit(1)).alias("n"))
    return counts.select(F.unix_micros("window.start").alias("window_start"), kind, "n")
