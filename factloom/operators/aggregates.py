"""Sums, trends, comparisons, ratios and correlations over facts.

Every operator reduces map-side before its one shuffle; what comes back per
fiscal year or per measure is bounded by the calendar and the closed domains.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import half_even, percent
from factloom.operators.filters import ANNUAL, at_level, exclude_pseudo, filter_facts, not_pseudo
from factloom.schema import UNMAPPED, WINDOW_MODES
from factloom.sources.shared import settled


def basis() -> Column:
    """Window basis of the rows summed: their one mode, else ``mixed``.

    Modes are collected as bits: a number buffer keeps the aggregate hash-based.
    """
    bit = F.lit(0)
    for i, mode in enumerate(WINDOW_MODES):
        bit = F.when(F.col("window_mode") == mode, 1 << i).otherwise(bit)
    seen, name = F.bit_or(bit), F.lit("mixed")
    for i, mode in enumerate(WINDOW_MODES):
        name = F.when(seen == 1 << i, mode).otherwise(name)
    return F.when(seen.isNotNull(), name).alias("basis")


def sum_measure(facts: DataFrame, measure: str = "received", bucket: str = "total") -> DataFrame:
    """Sum over the rows given; no rows sum to 0 and never widen the selection."""
    rows = facts.filter((F.col("measure") == measure) & (F.col("bucket") == bucket))
    return rows.agg(half_even(F.coalesce(F.sum("value"), F.lit(0.0))).alias("value"))


def _entity_rows(facts, level, fy=None, measure=None, bucket="total"):
    return exclude_pseudo(filter_facts(facts, level=level, fy=fy, measure=measure, bucket=bucket))


def summarize_entities(facts: DataFrame, measure=None, bucket="total",
                       level: str | None = ANNUAL) -> DataFrame:
    """Row count and total.  ``bucket=None`` also adds parts to their totals."""
    return _entity_rows(facts, level, measure=measure, bucket=bucket).agg(
        F.count(F.lit(1)).alias("row_count"),
        half_even(F.coalesce(F.sum("value"), F.lit(0.0))).alias("total"), basis())


def entity_sums(facts: DataFrame, fy=None, measure=None, bucket="total",
                level: str | None = ANNUAL) -> DataFrame:
    return _entity_rows(facts, level, fy, measure, bucket).groupBy("entity_name").agg(
        F.sum("value").alias("value"), basis())


def entity_totals(facts: DataFrame, fy=None, measure=None, bucket="total",
                  level: str | None = ANNUAL) -> DataFrame:
    sums = entity_sums(facts, fy, measure, bucket, level)
    return sums.withColumn("value", half_even(F.col("value")))


def distinct_entities(facts: DataFrame, approximate: bool = False, **selection) -> DataFrame:
    """How many entities a selection holds."""
    rows = exclude_pseudo(filter_facts(facts, **selection))
    count = F.approx_count_distinct if approximate else F.count_distinct
    return rows.agg(count("entity_name").alias("entities"))


def by_portfolio(facts: DataFrame, fy=None, measure=None, bucket="total",
                 level: str | None = ANNUAL) -> DataFrame:
    name = F.coalesce(F.nullif(F.col("portfolio"), F.lit("")), F.lit(UNMAPPED))
    rows = _entity_rows(facts, level, fy, measure, bucket)
    return rows.groupBy(name.alias("portfolio")).agg(
        half_even(F.sum("value")).alias("value"), basis()
    ).orderBy(F.desc("value"), "portfolio")


def fy_series(facts: DataFrame, measures: Iterable[str], pseudo: bool = True) -> DataFrame:
    """One row per annual year, one rounded total per measure.

    The axis is every year with annual rows; a measure without rows in a year is
    NULL there, never 0.  Axis and values come from a single aggregate.
    """
    rows = at_level(facts)
    counted = F.col("bucket") == "total"
    if not pseudo:
        counted = counted & not_pseudo()
    return rows.groupBy("fy").agg(*[
        half_even(F.sum(F.when(counted & (F.col("measure") == m), F.col("value")))).alias(m)
        for m in measures])


def _published(series: DataFrame, column: str) -> DataFrame:
    """No rows at all when no year has a value (the axis is one row per year)."""
    whole = Window.partitionBy(F.lit(0))
    return series.withColumn("_any", F.count(column).over(whole)).filter(
        F.col("_any") > 0).drop("_any")


def trend(facts: DataFrame, measure: str = "received") -> DataFrame:
    series = fy_series(facts, [measure], pseudo=False)
    return _published(series.select("fy", F.col(measure).alias("value"), F.lit(ANNUAL).alias("basis")), "value")


def ratio(parts: Iterable[str], whole: str, places: int) -> Column:
    """100 x (sum of parts) / whole over series columns; NULL parts stay NULL."""
    total = None
    for p in parts:
        total = F.col(p) if total is None else total + F.col(p)
    return percent(total, F.col(whole), places)


def ratio_trend(facts: DataFrame, parts: Iterable[str], whole: str = "decided",
                places: int = 1) -> DataFrame:
    """Yearly percentage of one or several measures in another, e.g. refused of decided."""
    parts = list(parts)
    series = fy_series(facts, dict.fromkeys([*parts, whole]))
    return series.select("fy", ratio(parts, whole, places).alias("value"), F.lit(ANNUAL).alias("basis"))


def zip_series(facts: DataFrame, left: str, right: str) -> DataFrame:
    """Two yearly series side by side with their element-wise ratio."""
    series = fy_series(facts, dict.fromkeys([left, right]))
    return series.select("fy", F.col(left).alias("left_value"), F.col(right).alias("right_value"),
                         F.try_divide(F.col(left), F.col(right)).alias("ratio"),
                         F.lit(ANNUAL).alias("basis"))


def multi_measure_trend(facts: DataFrame, measures: Iterable[str] = (
        "granted_full", "granted_part", "refused", "withdrawn")) -> DataFrame:
    return fy_series(facts, measures).withColumn("basis", F.lit(ANNUAL))


def compare_periods(facts: DataFrame, fy_a: str, fy_b: str, measure: str = "received",
                    level: str | None = ANNUAL) -> DataFrame:
    """Totals of two years, change and percentage; a missing year, or none given, counts as 0
    and a zero base has no percentage."""
    rows = _entity_rows(facts, level, measure=measure).filter(F.col("fy").isin(fy_a, fy_b))

    def total(fy):
        return F.coalesce(F.sum(F.when(F.col("fy") == F.lit(fy).cast("string"), F.col("value"))), F.lit(0.0))

    sums = rows.agg(total(fy_a).alias("a"), total(fy_b).alias("b"), basis())
    change = F.col("b") - F.col("a")
    return sums.select(
        F.lit(fy_a).cast("string").alias("fy_a"), F.lit(fy_b).cast("string").alias("fy_b"),
        half_even(F.col("a")).alias("value_a"), half_even(F.col("b")).alias("value_b"),
        half_even(change).alias("change"), percent(change, F.col("a")).alias("change_pct"), "basis")


def period_change(facts: DataFrame, measure: str = "received", level: str = ANNUAL) -> DataFrame:
    """Each period's total, that of the period just before it, and the change: year on
    year for annual rows, quarter on quarter for single quarters.  Where the period
    before has no rows there is nothing to compare with, and both are NULL."""
    rows = _entity_rows(facts, level, measure=measure)
    totals = rows.groupBy("fy", "quarter").agg(F.sum("value").alias("_v"), basis())
    year = F.substring("fy", 1, 4).cast("int")
    totals = totals.withColumn("_at", F.coalesce(year * 4 + F.col("quarter"), year))
    before = Window.partitionBy("basis").orderBy("_at")  # a row per period
    follows = F.col("_at") - F.lag("_at").over(before) == 1
    change = F.col("_v") - F.col("_p")
    return totals.withColumn("_p", F.when(follows, F.lag("_v").over(before))).select(
        "fy", "quarter", half_even(F.col("_v")).alias("value"), half_even(F.col("_p")).alias("previous"),
        half_even(change).alias("change"), percent(change, F.col("_p"), 1).alias("change_pct"), "basis")


def _entity_changes(facts, fy_a, fy_b, measure, level):
    """Change of every entity with rows in either year; the other one then counts as 0."""
    rows = _entity_rows(facts, level, measure=measure).filter(F.col("fy").isin(fy_a, fy_b))
    signed = F.when(F.col("fy") == fy_b, F.col("value")).otherwise(-F.col("value"))
    return rows.groupBy("entity_name").agg(F.sum(signed).alias("change"), basis())


def change_contributions(facts: DataFrame, fy_a: str, fy_b: str, measure: str = "received",
                         level: str = ANNUAL) -> DataFrame:
    """What part of the whole change between two years each entity makes up, in per cent;
    NULL where the whole doesn't change.  The facts are read once, for changes that are kept."""
    changes = settled(_entity_changes(facts, fy_a, fy_b, measure, level), "entity-changes")
    whole = changes.agg(F.sum("change").alias("whole"))
    return changes.select("entity_name", half_even(F.col("change")).alias("change"),
                          percent(F.col("change"), whole.scalar(), 1).alias("share_pct"), "basis")


def change_counts(facts: DataFrame, fy_a: str, fy_b: str, measure: str = "received",
                  level: str = ANNUAL) -> DataFrame:
    """How many entities went up, down or stayed between two years."""
    changes = _entity_changes(facts, fy_a, fy_b, measure, level)
    change = F.col("change")
    return changes.agg(F.count_if(change > 0).alias("up"), F.count_if(change < 0).alias("down"),
                       F.count_if(change == 0).alias("same"))


def pearson(x: Column, y: Column, places: int = 3) -> Column:
    """Pearson coefficient over complete pairs; NULL below two pairs or when a
    series is constant.

    The pairs of a group, one per year, are listed in order and summed about
    their means: large values don't cancel, and the order of rows doesn't matter.
    """
    pair = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    pairs = F.array_sort(F.collect_list(F.when(x.isNotNull() & y.isNotNull(), pair)))
    n = F.size(pairs)

    def total(term):
        return F.aggregate(pairs, F.lit(0.0), lambda s, p: s + term(p))

    means = {c: F.try_divide(total(lambda p, c=c: p[c]), n) for c in "xy"}

    def spread(a, b):
        return total(lambda p: (p[a] - means[a]) * (p[b] - means[b]))

    varies = (F.array_min(pairs["x"]) < F.array_max(pairs["x"])) & (
        F.array_min(pairs["y"]) < F.array_max(pairs["y"]))
    r = F.try_divide(spread("x", "y"), F.sqrt(spread("x", "x")) * F.sqrt(spread("y", "y")))
    return F.when((n >= 2) & varies, half_even(r, places))


def pearson_trend(facts: DataFrame, x: str = "within_statutory", y: str = "received") -> DataFrame:
    """Correlation of two yearly series."""
    return fy_series(facts, [x, y]).agg(pearson(F.col(x), F.col(y)).alias("value"))


def pearson_by_entity(facts: DataFrame, x: str = "within_statutory",
                      y: str = "received") -> DataFrame:
    """The same correlation for every entity over its own years."""
    rows = exclude_pseudo(at_level(facts)).filter(
        (F.col("bucket") == "total") & F.col("measure").isin(x, y))

    def of(m):
        return F.sum(F.when(F.col("measure") == m, F.col("value")))

    yearly = rows.groupBy("entity_name", "fy").agg(of(x).alias("x"), of(y).alias("y"))
    return yearly.groupBy("entity_name").agg(
        F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("years"),
        pearson(F.col("x"), F.col("y")).alias("r"))


def quarter_headline(facts: DataFrame, fy: str, quarter: int) -> DataFrame:
    """Published single-quarter totals per measure (the derived rows only, so the
    entities' own quarters are not added on top)."""
    rows = filter_facts(facts, level="single_quarter", fy=fy, quarter=quarter,
                        bucket="total").filter("derived")
    return rows.groupBy("measure").agg(half_even(F.sum("value")).alias("value"),
                                       F.count(F.lit(1)).alias("source_rows"))


def quarter_share(facts: DataFrame, fy: str, quarter: int, parts: Iterable[str],
                  whole: str = "decided") -> DataFrame:
    """Whole-number percentage of each part in ``whole`` for one quarter."""
    parts = list(parts)
    rows = filter_facts(facts, level="single_quarter", fy=fy, quarter=quarter,
                        bucket="total").filter("derived")
    sums = rows.agg(*[
        half_even(F.sum(F.when(F.col("measure") == m, F.col("value")))).alias(m)
        for m in dict.fromkeys([*parts, whole])])
    cells = []
    for p in parts:
        cells += [F.lit(p), percent(F.col(p), F.col(whole))]
    return sums.select(F.stack(F.lit(len(parts)), *cells).alias("measure", "share"))


def period_movers(facts: DataFrame, fy_a: str, fy_b: str, part: str = "refused",
                  whole: str = "decided") -> DataFrame:
    """Entities' rate in two years and its change; both years need a positive
    denominator.  One conditional aggregate instead of a self-join."""
    rows = filter_facts(facts, level=ANNUAL, bucket="total").filter(
        F.col("fy").isin(fy_a, fy_b) & F.col("measure").isin(part, whole))

    def of(fy, m):
        return F.coalesce(F.sum(F.when((F.col("fy") == fy) & (F.col("measure") == m),
                                       F.col("value"))), F.lit(0.0))

    sums = rows.groupBy("entity_name").agg(
        of(fy_a, part).alias("pa"), of(fy_a, whole).alias("wa"),
        of(fy_b, part).alias("pb"), of(fy_b, whole).alias("wb"))
    rate_a = F.lit(100.0).cast("double") * F.col("pa") / F.col("wa")
    rate_b = F.lit(100.0).cast("double") * F.col("pb") / F.col("wb")
    return sums.filter((F.col("wa") > 0) & (F.col("wb") > 0)).select(
        "entity_name", half_even(rate_a, 1).alias("fy_a_rate"),
        half_even(rate_b, 1).alias("fy_b_rate"), half_even(rate_b - rate_a, 1).alias("change"),
        F.lit(ANNUAL).alias("basis"))


def presence_check(figures: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Whether each series of the catalogue (figure_key, series) has rows in a figure
    table, and any value among them; series that a table lacks are there too."""
    found = figures.groupBy("figure_key", "series").agg(F.count("value").alias("_values"))
    return catalogue.join(found, ["figure_key", "series"], "left").select(
        "figure_key", "series", F.col("_values").isNotNull().alias("has_data"),
        (F.coalesce("_values", F.lit(0)) > 0).alias("has_values"))
