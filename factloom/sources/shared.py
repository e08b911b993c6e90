"""The folder all executors share, for checkpoints and intermediate tables."""

from __future__ import annotations

import posixpath
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one below the
    warehouse, which every session has and all executors reach."""
    folder = _setting(spark)
    return folder or posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_factloom")


def _setting(spark: SparkSession) -> str | None:
    return spark.conf.get(_KEY, None)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return posixpath.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written out and read back: computed once, lineage cut, and safe from
    executor loss because the files live in the shared folder."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
