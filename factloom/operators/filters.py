"""Fact filters and catalogue listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import BUCKETS, TOTAL_NAME, WINDOW_MODES

ANNUAL = "fy"


def at_level(facts: DataFrame, level: str | None = ANNUAL) -> DataFrame:
    """Rows of one window basis.  Levels overlap, so every sum must name one."""
    if level is None:
        return facts
    if level not in WINDOW_MODES:
        raise ValueError(f"unknown level {level!r}; one of {WINDOW_MODES}")
    return facts.filter(F.col("window_mode") == level)


def annual_rows(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("quarter").isNull())


def not_pseudo() -> Column:
    return F.lower("entity_name") != TOTAL_NAME.lower()


def exclude_pseudo(facts: DataFrame) -> DataFrame:
    """Drop the ``Total`` pseudo-entity, which no per-entity answer may hold."""
    return facts.filter(not_pseudo())


def filter_facts(facts: DataFrame, *, fy=None, quarter=None, measure=None, bucket=None,
                 entity=None, level=None) -> DataFrame:
    """Exact-match conjunction; None is no constraint.

    ``quarter=None`` therefore cannot pick annual rows: use ``level='fy'``.
    """
    out = at_level(facts, level)
    wanted = {"fy": fy, "quarter": quarter, "measure": measure, "bucket": bucket,
              "entity_name": entity}
    for column, value in wanted.items():
        if value is not None:
            out = out.filter(F.col(column) == value)
    return out


def search_facts(facts: DataFrame, *, fy=None, quarter=None, measure=None, bucket=None,
                 entity=None, level=None) -> DataFrame:
    """As :func:`filter_facts`, but ``entity`` is a literal, case-blind substring
    and empty texts are no constraint."""
    out = filter_facts(facts, fy=fy or None, quarter=quarter, measure=measure or None,
                       bucket=bucket or None, level=level)
    if entity:
        out = out.filter(F.contains(F.lower("entity_name"), F.lit(entity.lower())))
    return out


def list_entities(facts: DataFrame, ordered: bool = False) -> DataFrame:
    """Distinct entity names without note rows and totals."""
    names = exclude_pseudo(facts).filter(~F.col("entity_name").startswith("x")).select(
        "entity_name").distinct()
    return names.orderBy("entity_name") if ordered else names


def list_groups(facts: DataFrame) -> DataFrame:
    return facts.select("measure_group").distinct()


def measures_by_group(facts: DataFrame) -> DataFrame:
    """Sorted measures of each group; both domains are small and closed."""
    return facts.groupBy("measure_group").agg(
        F.sort_array(F.collect_set("measure")).alias("measures"))


def dataset_profile(facts: DataFrame, keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(attribute, value) rows: measures, groups, years, fact count, key lists."""
    # counted per small cell first, so that the set building sees few rows
    cells = facts.groupBy("measure_group", "measure", "fy").agg(F.count(F.lit(1)).alias("n"))
    sets = cells.agg(
        F.collect_set("measure").alias("measure"),
        F.collect_set("measure_group").alias("measure_group"),
        F.collect_set("fy").alias("fy"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("string").alias("n"))
    listed = {"measure": F.col("measure"), "measure_group": F.col("measure_group"),
              "fy": F.col("fy"), "fact_count": F.array("n"),
              "window_mode": F.array(*map(F.lit, WINDOW_MODES))}
    for name, values in (keys or {}).items():
        listed[name] = F.array(*map(F.lit, values))

    def pairs(attribute, values):
        return F.transform(values, lambda v: F.struct(F.lit(attribute).alias("attribute"),
                                                      v.alias("value")))

    return sets.select(F.inline(F.concat(*[pairs(a, v) for a, v in listed.items()])))


def filter_options(facts: DataFrame) -> DataFrame:
    """Distinct (dimension, option) pairs for selectors, in one pass."""
    return facts.select(F.stack(
        F.lit(3), F.lit("entity"), F.col("entity_name"), F.lit("bucket"), F.col("bucket"),
        F.lit("fy"), F.col("fy")).alias("dimension", "option")).distinct()


def present_buckets(facts: DataFrame) -> DataFrame:
    """The known buckets that occur, with their display order."""
    order = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col("bucket")).cast("int")
    return facts.filter(F.col("bucket").isin(*BUCKETS)).groupBy("bucket").agg(
        F.first(order).alias("ord"))
