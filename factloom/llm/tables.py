"""Reading the tables of a folder, and keeping intermediate results in the shared one."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``,
    and where that is unset (tests) a folder below the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_shared")
    return posixpath.join(folder, f"{name}-{uuid.uuid4().hex}")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, and still there
    when an executor is lost."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc32_mod(column: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo ``divisor``; null where the column is."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor
