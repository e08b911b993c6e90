"""Top lists, pages and bar scales.  Ties break on the name, ascending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.numbers import half_even
from factloom.operators.aggregates import entity_sums, period_movers
from factloom.operators.filters import ANNUAL, filter_facts
from factloom.schema import DEFAULT_PAGE_LIMIT, DEFAULT_TOP_N, NATURAL_KEY
from factloom.sources.shared import settled


def top_entities(facts: DataFrame, measure: str, fy: str, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Largest entities of one year; partial top-n per task, merged on the driver side."""
    rows = filter_facts(facts, level=ANNUAL, fy=fy, measure=measure, bucket="total")
    return rows.groupBy("entity_name").agg(F.sum("value").alias("_sum")).orderBy(
        F.desc("_sum"), "entity_name").limit(n).select(
        "entity_name", half_even(F.col("_sum")).alias("value"))


def top_contributors(facts: DataFrame, fy=None, measure=None, bucket="total",
                     n: int = DEFAULT_TOP_N, level: str | None = ANNUAL) -> DataFrame:
    """Top entities plus the number of entities before the cut; the facts are read once, for sums
    that are kept."""
    sums = settled(entity_sums(facts, fy, measure, bucket, level), "entity-sums")
    entities = sums.agg(F.count(F.lit(1)).alias("entities"))
    top = sums.orderBy(F.desc("value"), "entity_name").limit(n)
    return top.withColumns({"value": half_even(F.col("value")), "entities": entities.scalar()})


def top_movers(facts: DataFrame, fy_a: str, fy_b: str, n: int = DEFAULT_TOP_N) -> DataFrame:
    """Largest rate changes, ranked on the rounded change."""
    return period_movers(facts, fy_a, fy_b).orderBy(
        F.desc(F.abs("change")), "entity_name").limit(n)


def page_facts(facts: DataFrame, limit: int = DEFAULT_PAGE_LIMIT, offset: int = 0,
               after: dict | None = None) -> DataFrame:
    """One page in natural-key order with the ``total`` before paging.

    ``offset`` counts from the start and suits the first pages: a page costs
    offset + limit rows in the last step.  Deep pages pass ``after``, the key of
    the last row seen, which prunes by comparison and costs ``limit`` rows.
    """
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    keys = [F.col(c) for c in NATURAL_KEY]
    total = facts.agg(F.count(F.lit(1)).alias("total"))
    rows = facts
    if after is not None:
        missing = set(NATURAL_KEY) - set(after)
        if missing:
            raise ValueError(f"after needs every key column, missing {sorted(missing)}")
        types = dict(facts.dtypes)
        seen = F.struct(*[F.lit(after[c]).cast(types[c]).alias(c) for c in NATURAL_KEY])
        rows = rows.filter(F.struct(*keys) > seen)
    return rows.orderBy(*keys).offset(offset).limit(limit).withColumn("total", total.scalar())


def bar_scale(figures: DataFrame) -> DataFrame:
    """Value as a percentage of the largest in its figure; NULL stays NULL and a
    true 0 stays 0.  A figure is one row per year or top entity, so its rows fit a
    window."""
    peak = F.max("value").over(Window.partitionBy("figure_key"))
    scaled = F.try_divide(F.lit(100.0).cast("double") * F.col("value"), peak)
    return figures.withColumn(
        "height", F.when(F.col("value").isNotNull(), F.coalesce(scaled, F.lit(0.0))))
