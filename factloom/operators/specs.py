"""Dashboard specs: panels may cite registry keys, chart types or pointers only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import CHART_TYPES, POINTER_PATTERN, SPEC

_WHOLE_POINTER = f"^{POINTER_PATTERN}$"


def panels(specs: DataFrame, spec: str = "spec_json") -> DataFrame:
    """One row per panel with its position; specs that are not JSON give none."""
    parsed = F.from_json(F.col(spec), SPEC)["panels"]
    ids = [c for c in specs.columns if c != spec]
    return specs.select(*ids, F.posexplode(parsed).alias("pos", "_panel")).select(
        *ids, "pos", F.col("_panel.title").alias("title"), F.col("_panel.stat").alias("stat"),
        F.col("_panel.figure").alias("figure"), F.col("_panel.basis").alias("basis"))


def _allowed(column: Column, keys) -> Column:
    return column.isNull() | column.isin(*keys) | column.rlike(_WHOLE_POINTER)


def audit_panels(panel_rows: DataFrame, stat_keys, figure_keys) -> DataFrame:
    """Panels that name anything else: a number the spec must not contain."""
    rows = panel_rows.select(
        *[c for c in panel_rows.columns if c not in ("stat", "figure", "title", "basis")],
        F.stack(F.lit(2),
                F.lit("stat"), F.col("stat"), _allowed(F.col("stat"), stat_keys),
                F.lit("figure"), F.col("figure"),
                _allowed(F.col("figure"), [*figure_keys, *CHART_TYPES]),
                ).alias("field", "named", "_ok"))
    return rows.filter(~F.col("_ok")).drop("_ok")


def panel_key(stat_keys, figure_keys) -> Column:
    """Registry key a panel cites: its stat if it names one, else its figure."""
    named = F.coalesce(F.nullif(F.col("stat"), F.lit("")), F.col("figure"))
    return F.when(named.isin(*stat_keys, *figure_keys), named)
