"""Per-key quota in fixed windows anchored at the first event of each window.

A window starts at the first event that finds none open and lasts ``window``;
the next event at or after its end starts the next one.  That is sequential per
key, so a key with a third of all events must not become one task:

1. timelines are reduced to distinct instants, and every instant points to the one
   that would start the next window if it started one itself.  Instants and the
   ends of their windows are sorted together by range, whatever their keys; a pointer
   is found by an ordered window inside a range, or, for keys that go on over a range's
   border, from the first instant of the ranges after it;
2. an instant after a pause of a whole window surely starts one.  What is reached from
   those along the pointers are the starts; they are found by doubling the pointers,
   in as many joins as the longest stretch without such a pause has binary digits.

No group of a task is a key's: ranges split a key, even inside one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.sequence import numbered
from factloom.schema import QUOTA_LIMIT, QUOTA_WINDOW_SECONDS
from factloom.sources.shared import settled

#: Rows of a range at most, about; and ranges at most.
ROWS_PER_RANGE, RANGES = 1 << 20, 20_000


def _pointers(instants: DataFrame, window: int, rows_per_range: int) -> tuple[DataFrame, DataFrame]:
    """(k, src, dst): where the window that each instant would start hands over; (k, t): instants after a pause."""
    rows = 2 * instants.count()
    ends = instants.select("k", (F.col("t") + window).alias("at"), F.col("t").alias("src"))
    both = instants.select("k", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("src")).unionByName(ends)
    both = both.repartitionByRange(min(RANGES, rows // rows_per_range + 1), "k", "at")
    both = settled(both.withColumn("part", F.spark_partition_id()), "quota-ranges")
    mark = F.when(F.col("src").isNull(), F.col("at"))

    # keys that lie in several ranges: a row for each of the two or more, so at most two a range
    spans = both.groupBy("k", "part").agg(F.min(mark).alias("first"), F.max(mark).alias("last"))
    spans = settled(spans, "quota-spans")
    several = spans.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k")
    line = Window.partitionBy("k").orderBy("part")
    spans = spans.join(several, "k", "left_semi").select(
        "k", "part", F.min("first").over(line.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
        F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    spans = settled(spans, "quota-borders")

    # at one instant, instants come before ends: an end there hands over there
    down = Window.partitionBy("part", "k").orderBy(F.col("at").desc(), F.col("src").asc_nulls_first()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    up = Window.partitionBy("part", "k").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumns({"_dst": F.min(mark).over(down), "_before": F.max(mark).over(up)}).join(spans, ["k", "part"], "left")
    found = settled(found.select("k", "at", "src", F.coalesce("_dst", "later").alias("dst"),
                                 F.coalesce("_before", "earlier").alias("before")), "quota-pointers")
    after_pause = F.coalesce(F.col("at") - F.col("before") >= window, F.lit(True))
    fresh = found.filter(F.col("src").isNull() & after_pause).select("k", F.col("at").alias("t"))
    return found.filter("src IS NOT NULL AND dst IS NOT NULL").select("k", "src", "dst"), fresh


def _reached(first: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries reachable from ``first`` (k, t) along ``edges`` (k, src, dst)."""
    reach, jump = first, edges
    while not jump.isEmpty():
        step = jump.select(F.col("k").alias("_k"), F.col("src").alias("_src"), "dst")
        new = reach.join(step, (F.col("k") == F.col("_k")) & (F.col("t") == F.col("_src"))).select(
            "k", F.col("dst").alias("t"))
        reach = settled(reach.unionByName(new), "quota-reach")
        far = jump.select(F.col("k").alias("_k"), F.col("src").alias("_src"),
                          F.col("dst").alias("_dst"))
        jump = settled(
            jump.join(far, (F.col("k") == F.col("_k")) & (F.col("dst") == F.col("_src"))).select(
                "k", "src", F.col("_dst").alias("dst")), "quota-jump")
    return reach


def window_starts(events: DataFrame, key: str, micros: Column, window: int,
                  rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Rows (k, start): every window start, in microseconds.

    ``k`` is the key in a struct: NULL keys are equal there, so their events have
    windows of their own.  Events without a time start none.
    """
    timed = events.select(F.struct(F.col(key)).alias("k"), micros.alias("t")).filter("t IS NOT NULL")
    instants = settled(timed.distinct(), "quota-instants")
    pointers, fresh = _pointers(instants, window, rows_per_range)
    fresh = settled(fresh, "quota-fresh")
    # a pointer to an instant after a pause adds nothing
    edges = settled(pointers.join(fresh.select("k", F.col("t").alias("dst")), ["k", "dst"], "left_anti").select(
        "k", "src", "dst"), "quota-edges")
    return _reached(fresh, edges).select("k", F.col("t").alias("start"))


def quota_flags(events: DataFrame, key: str, micros: Column, tie: str,
                limit: int = QUOTA_LIMIT, window_seconds: float = QUOTA_WINDOW_SECONDS,
                rows_per_range: int = ROWS_PER_RANGE, slices: int = 64) -> DataFrame:
    """Add window_start (us), n_in_window, allowed, remaining and retry_after (s).

    Every event stays: a NULL key is a key like others, and an event without a
    time has NULL in all five.  Numbers within a window are taken in ``slices``
    equal parts of it, so no task sorts a whole window of a busy key.
    """
    window = int(round(window_seconds * 1_000_000))
    if window <= 0 or rows_per_range < 1 or slices < 1:
        raise ValueError("window, range and slices must be positive")
    starts = settled(window_starts(events, key, micros, window, rows_per_range), "quota-starts")

    # Each event belongs to the last start at or before it.  A window is found
    # from the slot (one window long) of the event: its own or the one before.
    slot = F.floor(F.col("start") / window)
    held = starts.select(F.col("k").alias("_k"), "start", F.explode(
        F.array(slot, slot + 1)).alias("_slot"))
    placed = events.withColumn("_t", micros).withColumn(
        "_at", F.floor(F.col("_t") / window)).join(
        held, (F.struct(F.col(key)) == F.col("_k")) & (F.col("_at") == F.col("_slot"))
        & (F.col("start") <= F.col("_t")) & (F.col("_t") < F.col("start") + window), "left")
    # events without a window are dealt out by their tie-break: they get no number
    fine = F.when(F.col("start").isNull(), F.pmod(F.xxhash64(tie), F.lit(slices))).otherwise(
        F.floor((F.col("_t") - F.col("start")) * slices / window))
    counted = numbered(placed.drop("_k", "_slot", "_at"), [key, "start"], ["_t", tie], fine,
                       "n_in_window")
    allowed = F.col("n_in_window") <= limit
    wait = (F.col("start") + window - F.col("_t")) / 1e6
    placed = F.col("start").isNotNull()
    return counted.select(
        *events.columns, F.col("start").alias("window_start"),
        F.when(placed, F.col("n_in_window")).alias("n_in_window"),
        F.when(placed, allowed).alias("allowed"),
        F.when(placed, F.when(allowed, limit - F.col("n_in_window")).otherwise(0)).alias("remaining"),
        F.when(placed, F.when(allowed, F.lit(0.0)).otherwise(wait)).alias("retry_after"))
