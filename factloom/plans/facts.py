"""Canonical facts from order-level records.

One order is one request.  Orders are folded to one row of counters per entity
and period *before* any dimension is joined, so the wide joins move aggregates,
never raw orders, and a customer with a third of all orders is reduced map-side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.periods import (
    fiscal_quarter, fiscal_start_year, in_fiscal_years, start_label)
from factloom.schema import FACT_COLUMNS, MEASURE_GROUP, MEASURES, TOTAL_KEY, TOTAL_NAME, WINDOW_MODES
from factloom.sources.shared import settled

URGENT = ("1-URGENT", "2-HIGH")
CLOSED = ("F", "P")
ABANDONED = "4-NOT SPECIFIED"
STATUTORY_DAYS = 30
#: Fact rows of a task, about, where the counters they are made of are counted; counters of a task at least.
TASK_ROWS, TASK_COUNTERS = 1 << 19, 1 << 11


def _flags() -> dict[str, Column]:
    closed = F.col("o_orderstatus").isin(*CLOSED)
    decided = closed & (F.col("o_orderpriority") != ABANDONED)
    partial = decided & (F.col("o_orderstatus") == "P")
    return {
        "received": F.lit(True),
        "finalised": closed,
        "decided": decided,
        "within_statutory": decided
        & (F.datediff(F.col("first_ship"), F.col("o_orderdate")) <= STATUTORY_DAYS),
        "granted_full": decided & (F.col("o_orderstatus") == "F"),
        "granted_part": partial & F.col("personal"),
        "refused": partial & ~F.col("personal"),
        "withdrawn": closed & (F.col("o_orderpriority") == ABANDONED),
    }


def request_rows(orders: DataFrame, lineitem: DataFrame, measures: Iterable[str],
                 fys: Iterable[str] | None = None) -> DataFrame:
    """One row per order with its period, its bucket and one flag per measure.

    The year stays its starting number here; labels are made after aggregation.

    ``lineitem`` is only touched when timeliness is asked for: its earliest ship
    date per order meets the orders on the shared order key, one shuffle a side.
    """
    if fys is not None:
        orders = orders.filter(in_fiscal_years(F.col("o_orderdate"), fys))
    date = F.col("o_orderdate")
    rows = orders.withColumns({
        "start_year": fiscal_start_year(date), "quarter": fiscal_quarter(date),
        "personal": F.col("o_orderpriority").isin(*URGENT)})
    if "within_statutory" in measures:
        shipped = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.min("l_shipdate").alias("first_ship"))
        rows = rows.join(shipped, "o_orderkey", "left")
    flags = _flags()
    return rows.select("o_custkey", "start_year", "quarter", "personal",
                       *[flags[m].alias(m) for m in measures])


def _counters(measures: Iterable[str]) -> list[Column]:
    personal, other = F.col("personal"), ~F.col("personal")
    out = [F.count_if(personal).alias("n_personal"), F.count_if(other).alias("n_other")]
    for m in measures:
        out.append(F.count_if(F.col(m) & personal).alias(f"{m}_personal"))
        out.append(F.count_if(F.col(m) & other).alias(f"{m}_other"))
    return out


def _refolded(counters: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Counters summed up to fewer keys."""
    names = ["n_personal", "n_other", *_counter_names(measures)]
    return counters.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])


def quarter_counters(tables, measures: Iterable[str], fys: Iterable[str] | None = None) -> DataFrame:
    """Orders folded to one row of counters per entity and quarter, written out: every level,
    the headline and whatever else is asked of the facts is summed up from these."""
    rows = request_rows(tables.orders, tables.lineitem, measures, fys)
    folded = rows.groupBy("o_custkey", "start_year", "quarter").agg(*_counters(measures))
    return settled(folded, "counters")


def year_counters(tables, measures: Iterable[str], fys: Iterable[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Orders folded in one pass to one row of counters per entity and year, and one per quarter of all
    entities, written out: what annual facts and the headline are made of, and no row per entity and quarter."""
    rows = request_rows(tables.orders, tables.lineitem, measures, fys)
    sets = rows.groupingSets([["o_custkey", "start_year"], ["start_year", "quarter"]], "o_custkey", "start_year", "quarter")
    folded = settled(sets.agg(*_counters(measures), F.grouping_id().alias("_set")), "year-counters")
    # a set's number has a digit for each column, 1 where the column is summed over
    return (folded.filter("_set = 1").drop("quarter", "_set"), folded.filter("_set = 4").drop("o_custkey", "_set"))


def _counter_names(measures: Iterable[str]) -> list[str]:
    return [f"{m}_{b}" for m in measures for b in ("personal", "other")]


def _tasks(counters: DataFrame, fan_out: int) -> int:
    """Tasks that make about TASK_ROWS facts each of ``counters``.  Left to themselves, tasks are measured by the
    few bytes of the counters, and grow with the input until their facts fit no task's memory."""
    held = counters.count()
    cores = counters.sparkSession.sparkContext.defaultParallelism
    return max(held * fan_out // TASK_ROWS, min(held // TASK_COUNTERS, cores)) + 1


def _levels(rows: DataFrame, measures: list[str], levels: set[str], folded: bool = False) -> DataFrame:
    """Counters per entity and period, at every level asked for.  ``rows``: requests, or if ``folded``
    their counters: by year for annual facts alone, by quarter for all others.

    A bucket is present in a period only where an order fell into it; presence is
    carried by ``n_personal``/``n_other`` so that missing never becomes 0.
    """
    names = _counter_names(measures)
    if levels == {"fy"}:
        annual = rows if folded else rows.groupBy("o_custkey", "start_year").agg(*_counters(measures))
        return annual.withColumns(
            {"quarter": F.lit(None).cast("int"), "window_mode": F.lit("fy")})

    quarterly = rows if folded else rows.groupBy("o_custkey", "start_year", "quarter").agg(*_counters(measures))
    if levels == {"single_quarter"}:
        return quarterly.withColumn("window_mode", F.lit("single_quarter"))

    # At most four rows per (entity, year): running and whole-year sums share
    # one exchange on that key.
    year = Window.partitionBy("o_custkey", "start_year")
    running = year.orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    presence = ["n_personal", "n_other"]
    added = {"_last": F.col("quarter") == F.max("quarter").over(year)}
    for n in names:
        added[f"run_{n}"] = F.sum(n).over(running)
    for n in names + presence:
        added[f"all_{n}"] = F.sum(n).over(year)
    wide = quarterly.withColumns(added)

    def level(mode, quarter, prefix, presence_prefix, kept):
        return F.struct(
            quarter.alias("quarter"), F.lit(mode).alias("window_mode"), kept.alias("_kept"),
            *[F.col(presence_prefix + p).alias(p) for p in presence],
            *[F.col(prefix + n).alias(n) for n in names])

    quarter, always = F.col("quarter"), F.lit(True)
    parts = {
        "single_quarter": level("single_quarter", quarter, "", "", always),
        "cumulative": level("cumulative", quarter, "run_", "", always),
        "fy": level("fy", F.lit(None).cast("int"), "all_", "all_", F.col("_last")),
    }
    chosen = F.array(*[parts[m] for m in WINDOW_MODES if m in levels])
    return wide.select("o_custkey", "start_year", F.inline(chosen)).filter("_kept").drop("_kept")


def _long(wide: DataFrame, ids: list[str], measures: list[str], buckets) -> DataFrame:
    """Counters to (measure, bucket, value) rows; absent buckets give no row."""
    cells = []
    for m in measures:
        personal, other = F.col(f"{m}_personal"), F.col(f"{m}_other")
        values = {
            "personal": F.when(F.col("n_personal") > 0, personal),
            "other": F.when(F.col("n_other") > 0, other),
            "total": personal + other,
        }
        for b in buckets:
            cells += [F.lit(m), F.lit(b), values[b].cast("double")]
    count = F.lit(len(measures) * len(buckets))
    return wide.select(*ids, F.stack(count, *cells).alias("measure", "bucket", "value")).filter(
        F.col("value").isNotNull())


def entity_dimension(customer: DataFrame, nation: DataFrame, region: DataFrame,
                     unmapped: Iterable[str] = ("MIDDLE EAST",)) -> DataFrame:
    """Entity name and portfolio per customer; some regions have no portfolio."""
    places = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey", "r_name")
    return (
        customer.join(places, customer.c_nationkey == places.n_nationkey)
        .select(
            F.col("c_custkey").alias("o_custkey"),
            F.col("c_name").alias("entity_name"),
            F.when(~F.col("r_name").isin(*unmapped), F.col("r_name")).alias("portfolio"),
        )
    )


def build_facts(tables, measures: Iterable[str] = MEASURES,
                levels: Iterable[str] = ("fy",), headline: bool = False,
                fys: Iterable[str] | None = None, buckets=("personal", "other", "total"),
                folded: bool = False) -> DataFrame:
    """Canonical fact rows; only the measures, levels and years asked for.

    With a headline, or if ``folded`` because the facts are read more than once, orders and
    line items are read once and folded to counters, per entity and quarter only where quarters are asked for.
    """
    measures = [m for m in MEASURES if m in set(measures)]
    levels = set(levels)
    if not measures or not levels or not levels <= set(WINDOW_MODES):
        raise ValueError("unknown measure or level")
    folded = folded or headline
    if folded and levels == {"fy"}:
        rows, quarters = year_counters(tables, measures, fys)
    elif folded:
        rows = quarters = quarter_counters(tables, measures, fys)
    else:
        rows = request_rows(tables.orders, tables.lineitem, measures, fys)
    entity = entity_dimension(tables.customer, tables.nation, tables.region)
    if folded:
        tasks = _tasks(rows, len(measures) * len(buckets) * len(levels))
        rows = rows.repartition(tasks, "o_custkey")
    # Both sides grow with the data and the rows fan out right after this join, so
    # it is a merge join: broadcasting either side would leave the fan-out with the
    # few partitions of the other.
    named = _levels(rows, measures, levels, folded).join(entity.hint("merge"), "o_custkey").withColumns({
        "entity_key": F.col("o_custkey").cast("string"),
        "fy": start_label(F.col("start_year"))})
    if folded:  # the join may have had more partitions
        named = named.coalesce(tasks)
    ids = ["entity_key", "entity_name", "fy", "quarter", "window_mode", "portfolio"]
    facts = _finish(_long(named, ids, measures, buckets), derived=False)
    if headline:
        facts = facts.unionByName(_headline(_refolded(quarters, ["start_year", "quarter"], measures), measures))
    return facts


def headline_facts(tables, measures: Iterable[str] = MEASURES,
                   fys: Iterable[str] | None = None) -> DataFrame:
    """Single-quarter totals straight from the orders, as the entity ``Total``."""
    measures = list(measures)
    rows = request_rows(tables.orders, tables.lineitem, measures, fys)
    return _headline(rows.groupBy("start_year", "quarter").agg(*_counters(measures)), measures)


def _headline(counters: DataFrame, measures: list[str]) -> DataFrame:
    wide = counters.withColumns({
        "fy": start_label(F.col("start_year")),
        "entity_key": F.lit(TOTAL_KEY),
        "entity_name": F.lit(TOTAL_NAME),
        "window_mode": F.lit("single_quarter"),
        "portfolio": F.lit(None).cast("string"),
    })
    ids = ["entity_key", "entity_name", "fy", "quarter", "window_mode", "portfolio"]
    return _finish(_long(wide, ids, measures, ("total",)), derived=True)


def _finish(long: DataFrame, derived: bool) -> DataFrame:
    return long.withColumns({
        "measure_group": F.lit(MEASURE_GROUP),
        "derived": F.lit(derived),
    }).select(*FACT_COLUMNS)
