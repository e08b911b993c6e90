"""Wide sheets to canonical rows, and the name clean-up that goes with it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.numbers import parse_number
from factloom.schema import (
    BUCKETS, FACT_COLUMNS, MEASURE_GROUP, POSITIONAL_TRIPLES, TOTAL_KEY, TOTAL_NAME, UNMAPPED,
)


def _melt(sheet: DataFrame, ids: list[str], triples: Mapping[str, tuple[int, int, int]],
          on_bad: str) -> DataFrame:
    names = sheet.columns
    cells = []
    for measure, triple in triples.items():
        for bucket, position in zip(BUCKETS, triple):
            cells += [F.lit(measure), F.lit(bucket),
                      parse_number(F.col(f"`{names[position]}`"), on_bad)]
    count = F.lit(len(triples) * len(BUCKETS))
    return sheet.select(*ids, F.stack(count, *cells).alias("measure", "bucket", "value"))


def melt_positional(sheet: DataFrame, ids: list[str],
                    triples: Mapping[str, tuple[int, int, int]] = POSITIONAL_TRIPLES,
                    on_bad: str = "null") -> DataFrame:
    """Fixed column triples (personal, other, total) to rows."""
    widest = max(max(t) for t in triples.values())
    if widest >= len(sheet.columns):
        raise ValueError(f"sheet has {len(sheet.columns)} columns, position {widest} needed")
    return _melt(sheet, ids, triples, on_bad)


def header_triples(headers: list[str], prefixes: Mapping[str, str]) -> dict[str, tuple[int, int, int]]:
    """Where each measure's triple starts: the first header with its prefix."""
    found: dict[str, tuple[int, int, int]] = {}
    for measure_prefix, measure in prefixes.items():
        for i, header in enumerate(headers):
            if header.lower().startswith(measure_prefix):
                found[measure] = min(found.get(measure, (i, i + 1, i + 2)), (i, i + 1, i + 2))
                break
    return found


def melt_by_header(sheet: DataFrame, ids: list[str], prefixes: Mapping[str, str],
                   on_bad: str = "null") -> DataFrame:
    """As :func:`melt_positional`, the triples being found by header text."""
    triples = header_triples(sheet.columns, prefixes)
    if not triples:
        raise ValueError("no header starts with a known prefix")
    return melt_positional(sheet, ids, triples, on_bad)


def _trimmed(name: str) -> Column:
    return F.regexp_replace(F.col(name), r"^\s+|\s+$", "")


def drop_note_rows(rows: DataFrame, name: str = "entity_name") -> DataFrame:
    """Drop rows without a name and footnotes (a lower-case ``x`` leads the name)."""
    text = _trimmed(name)
    return rows.withColumn(name, text).filter(
        F.col(name).isNotNull() & (F.col(name) != "") & ~F.col(name).startswith("x"))


def is_total(name: str = "entity_name") -> Column:
    return F.lower(_trimmed(name)) == TOTAL_NAME.lower()


def drop_total_rows(rows: DataFrame, name: str = "entity_name") -> DataFrame:
    return rows.filter(~is_total(name))


def control_rows(rows: DataFrame, name: str = "entity_name") -> DataFrame:
    """The published totals of a sheet, to reconcile against."""
    return rows.filter(is_total(name))


def apply_renames(rows: DataFrame, renames: DataFrame, key: str = "entity_key") -> DataFrame:
    """Old entity keys to current ones; keys without an entry stay.

    ``renames`` holds one row per old name.  It is joined without a hint: Spark
    broadcasts it while its measured size allows and shuffles it otherwise.
    """
    lookup = renames.select(F.col("old_name").alias("_old"), F.col("new_name").alias("_new"))
    return rows.join(lookup, F.col(key) == F.col("_old"), "left").withColumn(
        key, F.coalesce("_new", key)).drop("_old", "_new")


def assign_portfolio(rows: DataFrame, portfolios: DataFrame, key: str = "entity_key",
                     missing: str | None = UNMAPPED) -> DataFrame:
    """Add the portfolio of each entity; ``missing`` names those without one."""
    lookup = portfolios.select(F.col("entity_key").alias("_key"),
                               F.col("portfolio").alias("_portfolio"))
    joined = rows.drop("portfolio").join(lookup, F.col(key) == F.col("_key"), "left")
    value = F.nullif(F.col("_portfolio"), F.lit(""))
    if missing is not None:
        value = F.coalesce(value, F.lit(missing))
    return joined.withColumn("portfolio", value).drop("_key", "_portfolio")


def inject_headline(facts: DataFrame, headline: DataFrame) -> DataFrame:
    """Append published totals (fy, quarter, measure, value) as entity ``Total``."""
    rows = headline.select(
        F.lit(TOTAL_KEY).alias("entity_key"), F.lit(TOTAL_NAME).alias("entity_name"), "fy",
        F.col("quarter").cast("int").alias("quarter"), F.lit(MEASURE_GROUP).alias("measure_group"),
        "measure", F.lit("total").alias("bucket"), F.col("value").cast("double").alias("value"),
        F.lit(True).alias("derived"), F.lit("single_quarter").alias("window_mode"),
        F.lit(None).cast("string").alias("portfolio"))
    return facts.select(*FACT_COLUMNS).unionByName(rows)


def sheet_facts(sheet: DataFrame, ids_to_fy: Column, name: str, renames: DataFrame | None = None,
                **melt) -> DataFrame:
    """A whole sheet (first column the entity) to annual canonical rows."""
    rows = drop_total_rows(drop_note_rows(sheet, name), name)
    prefixes = melt.pop("prefixes", None)
    rows = rows.withColumn("fy", ids_to_fy)
    ids = [name, "fy"]
    long = melt_by_header(rows, ids, prefixes, **melt) if prefixes else melt_positional(
        rows, ids, **melt)
    long = long.withColumns({"entity_name": F.col(name), "entity_key": F.col(name)})
    if renames is not None:
        long = apply_renames(long, renames)
    return long.withColumns({
        "quarter": F.lit(None).cast("int"), "measure_group": F.lit(MEASURE_GROUP),
        "derived": F.lit(False), "window_mode": F.lit("fy"),
        "portfolio": F.lit(None).cast("string"),
    }).filter(F.col("value").isNotNull()).select(*FACT_COLUMNS)
