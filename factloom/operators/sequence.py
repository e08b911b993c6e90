"""Latest rows and running numbers that survive a hot key."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.shared import settled

#: Row numbers within a part, in ``monotonically_increasing_id``.
_ROW_BITS = 33


def latest_by_key(rows: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """Last row of each key by ``order``; an aggregate, so it combines map-side."""
    keys, order = list(keys), list(order)
    rest = [c for c in rows.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*rows.columns)


def numbered(rows: DataFrame, keys: Iterable[str], order: Iterable[str], slice_by: Column,
             name: str = "seq") -> DataFrame:
    """``row_number()`` per key without sorting a whole key in one task.

    ``slice_by`` must not decrease along ``order`` within a key (a coarser form
    of its first column).  Rows are numbered inside each (key, slice); the sizes
    of a key's earlier slices, a small table, give the offset.
    """
    keys, order = list(keys), list(order)
    # one struct key: window, size count and join share its hash partitioning,
    # and NULL parts compare equal inside a struct
    celled = rows.withColumn("_cell", F.struct(*keys, slice_by.alias("_slice")))
    sizes = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*[F.col("_cell")[k] for k in keys]).orderBy(
        F.col("_cell")["_slice"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_cell").alias("_of"),
                           F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    local = F.row_number().over(Window.partitionBy("_cell").orderBy(*order))
    return celled.withColumn("_local", local).join(
        offsets, F.col("_cell") == F.col("_of")).select(
        *rows.columns, (F.col("_offset") + F.col("_local")).alias(name))


def placed(ordered: DataFrame, name: str = "place") -> DataFrame:
    """Rows that come in order, with their place from 1 on; they are written out once, as they come.

    Rows of a part are numbered in it; parts follow one another, so the sizes of those before, a row a
    task, give the offset.
    """
    rows = settled(ordered.withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", _ROW_BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n")).collect()
    starts, before = [], 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        starts.append((r["_part"], before))
        before += r["n"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part bigint, _offset bigint")
    local = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return rows.withColumn("_part", part).join(offsets, "_part").select(
        *ordered.columns, (F.col("_offset") + local).alias(name))
