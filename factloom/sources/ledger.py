"""Ledger tables and the JSON event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S = T.StringType()
CORRUPT = "corrupt_line"
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

# One line of the event log; arguments and results stay JSON text.
EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("artifact_id", T.LongType()),
    T.StructField("event", _S),
    T.StructField("tool", _S),
    T.StructField("op", _S),
    T.StructField("args", _S),
    T.StructField("result", _S),
])
_READ = T.StructType(EVENTS.fields + [T.StructField(CORRUPT, _S)])


def _json(reader_or_writer):
    return reader_or_writer.option("timestampNTZFormat", TS_FORMAT)


def ledger_append(events: DataFrame, path: str) -> None:
    """Append events as JSON lines.  Columns the log does not know are dropped and
    missing ones are null, so an odd event never fails the job that logs it."""
    known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in events.columns
             else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENTS.fields]
    _json(events.select(*known).write.mode("append")).json(path)


def ledger_read(spark: SparkSession, path: str) -> DataFrame:
    """Events of the log; a line that is not an event is kept as ``corrupt_line``."""
    return _json(spark.read.schema(_READ)).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT).json(path)


def conform(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema``, cast; a NULL in a required column fails the job."""
    out = []
    for field in schema.fields:
        column = F.col(field.name).cast(field.dataType)
        if not field.nullable:
            problem = F.raise_error(F.lit(f"{field.name} must not be null"))
            column = F.coalesce(column, problem.cast(field.dataType))
        out.append(column.alias(field.name))
    return rows.select(*out)


def append_rows(rows: DataFrame, path: str, schema: T.StructType) -> None:
    """Append artifacts, ops or tool calls to their table."""
    conform(rows, schema).write.mode("append").parquet(path)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)
