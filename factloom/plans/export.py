"""Per-page figure bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.numbers import number_label
from factloom.operators.ranking import bar_scale
from factloom.plans.stats import CAPTIONS, PAGE_FIGURES
from factloom.schema import FACTS

_BUNDLE = "page string, figure_key string, caption string, series string, category string, " \
          "value double, height double, label string"


def page_figures(figures: DataFrame) -> DataFrame:
    """Figure rows for every page that shows them, scaled and labelled."""
    pairs = F.array(*[
        F.struct(F.lit(p).alias("page"), F.lit(k).alias("_key"),
                 F.lit(CAPTIONS.get(k)).alias("caption"))
        for p, keys in PAGE_FIGURES.items() for k in keys])
    pages = figures.sparkSession.range(1).select(F.inline(pairs))
    scaled = bar_scale(figures).withColumn("label", number_label(F.col("value")))
    return scaled.join(pages, F.col("figure_key") == F.col("_key")).select(
        "page", "figure_key", "caption", "series", "category", "value", "height", "label")


def export_figures(figures: DataFrame, facts: DataFrame, options: DataFrame, path: str) -> None:
    """Write figures by page, and the facts and filter options once for all pages.

    Figures are small (one row per year or top entity), so each page is one file;
    the facts are not repeated per page.
    """
    page_figures(figures).repartition("page").write.partitionBy("page").json(f"{path}/figures")
    facts.write.json(f"{path}/facts")
    options.write.json(f"{path}/filters")


def read_exported_figures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_BUNDLE).json(f"{path}/figures")


def read_exported(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of a bundle: figures, facts and filters."""
    read = lambda name, schema: spark.read.schema(schema).json(f"{path}/{name}")
    return {"figures": read_exported_figures(spark, path), "facts": read("facts", FACTS), "filters": read("filters", "dimension string, option string")}
