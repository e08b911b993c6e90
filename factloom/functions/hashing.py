"""Row hashes and order-free content digests.

A digest is the row count plus the sums of two 60-bit slices of each row hash.
Sums (unlike xor) keep multiplicity, merge in any order and combine map-side, so
a digest of any size is one ordinary aggregate and digests of parts add up to the
digest of the whole.  It shows that data changed; it is no defence against someone
who constructs rows to collide.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import HASH_COLUMNS

SLICES = 2
_HEX = 15  # hex digits per slice: 60 bits, so a slice fits a bigint


def _field(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def canonical_line(df: DataFrame, columns: Iterable[str]) -> Column:
    """One text per row; each field carries its length, NULL is ``-``."""
    types = dict(df.dtypes)
    fields = []
    for name in columns:
        column = F.col(name)
        if types[name] in ("double", "float"):
            column = column.cast("decimal(38,9)")
        fields.append(_field(column))
    return F.concat(*fields)


def row_hash(df: DataFrame, columns: Iterable[str] = HASH_COLUMNS) -> Column:
    return F.sha2(canonical_line(df, columns), 256)


def hash_slices(hashed: Column) -> list[Column]:
    return [
        # by way of a bigint, which it fits: much cheaper than reading a decimal from text
        F.conv(F.substring(hashed, 1 + i * _HEX, _HEX), 16, 10).cast("bigint").cast("decimal(38,0)")
        for i in range(SLICES)
    ]


def with_slices(df: DataFrame, columns: Iterable[str] = HASH_COLUMNS,
                where: Column | None = None) -> DataFrame:
    """Add ``h0``, ``h1``, the slices whose sums make the digest; NULL (and no
    hashing) for rows outside ``where``."""
    hashed = row_hash(df, columns)
    hashed = df.withColumn("_hash", hashed if where is None else F.when(where, hashed))
    parts = {f"h{i}": part for i, part in enumerate(hash_slices(F.col("_hash")))}
    return hashed.withColumns(parts).drop("_hash")


def digest_text(count: Column, sums: Iterable[Column]) -> Column:
    """Digest of a row set from its count and slice sums (empty sets included)."""
    parts = [F.coalesce(count, F.lit(0)).cast("string")]
    parts += [F.coalesce(s, F.lit(0)).cast("decimal(38,0)").cast("string") for s in sums]
    return F.sha2(F.concat_ws(":", *parts), 256)


def content_digest(df: DataFrame, columns: Iterable[str] = HASH_COLUMNS,
                   by: Iterable[str] = ()) -> DataFrame:
    """Row count and digest of the table, or of each group of ``by``."""
    by = list(by)
    sums = [F.sum(f"h{i}").alias(f"h{i}") for i in range(SLICES)]
    totals = with_slices(df, columns).groupBy(*by).agg(
        F.count(F.lit(1)).alias("row_count"), *sums)
    return totals.select(
        *by, "row_count",
        digest_text(F.col("row_count"), [F.col(f"h{i}") for i in range(SLICES)])
        .alias("content_digest"))
