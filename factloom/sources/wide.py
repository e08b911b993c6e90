"""Readers for wide text sheets."""

from __future__ import annotations

import csv
import re
from collections.abc import Mapping
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.numbers import parse_number
from factloom.functions.periods import fiscal_label
from factloom.schema import HEADER_ROWS, POSITIONAL_WIDTH

# Header of the long-run file.
LONG_RUN_COLUMNS = {
    "Year": "year_label",
    "Requests for personal information": "personal",
    "Requests for other information": "other",
    "Total requests": "total",
    "Application fees AUD": "application_fees",
    "Internal review fees AUD": "review_fees",
    "Charges notified AUD": "charges_notified",
    "Charges collected AUD": "charges_collected",
    "Total fees and charges collected AUD": "total_collected",
    "Estimated costs AUD": "estimated_costs",
}


def _text_schema(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_wide(spark: SparkSession, path, width: int = POSITIONAL_WIDTH,
              headers: list[str] | None = None) -> DataFrame:
    """A sheet without banner rows as text cells, named by position or by the headers given.

    Short rows are padded with NULL.  Rows without an entity name are for the melt
    step to drop.  :func:`read_sheet` reads sheets that begin with header rows.
    """
    names = headers if headers is not None else [f"c{i}" for i in range(width)]
    return spark.read.schema(_text_schema(names)).option("mode", "PERMISSIVE").option(
        "multiLine", False).csv(path)


def _lines(spark: SparkSession, path) -> DataFrame:
    """(pos, line) of each file below ``path``; a sheet file is read whole, so its rows have
    places.  Cells don't hold line breaks."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))


def sheet_headers(spark: SparkSession, path) -> list[str]:
    """The header texts of a sheet: its first row.  Cells without one are named by place, as
    are those that repeat an earlier one.  Files whose first rows differ are refused: values
    would land under other files' headers."""
    found = [r[0] for r in _lines(spark, path).filter("pos = 0").select("line").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"files with different headers: {found[0]!r} and {found[1]!r}")
    first = found[0] if found else None
    names: list[str] = []
    for i, text in enumerate(next(csv.reader([first or ""]), [])):
        text = text.strip()
        names.append(text if text and text.lower() not in {n.lower() for n in names} else f"c{i}")
    return names


def read_sheet(spark: SparkSession, path, header_rows: int = HEADER_ROWS, by_header: bool = False,
               width: int = POSITIONAL_WIDTH) -> DataFrame:
    """A sheet as it comes: its first ``header_rows`` rows are no data, whatever they hold.

    Columns are named by place, or by the texts of the first row.  Files of one sheet
    have the same header.  Empty lines are dropped, short rows padded with NULL.
    """
    names = sheet_headers(spark, path) if by_header else [f"c{i}" for i in range(width)]
    rows = _lines(spark, path).filter((F.col("pos") >= header_rows) & (F.trim("line") != ""))
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return rows.select(F.from_csv("line", schema).alias("_row")).select("_row.*")


def union_periods(spark: SparkSession, paths: Mapping[str, str], width: int = POSITIONAL_WIDTH,
                  headers: Mapping[str, list[str]] | None = None) -> DataFrame:
    """Per-period sheets as one table with a ``fy`` column.

    Periods may differ in their headers; columns are matched by name.  All files are read in one
    scan, however many periods there are: a file's place tells its period, and its cells find their columns
    through that period's header.
    """
    if not paths:
        raise ValueError("no periods given")
    own = {fy: list((headers or {}).get(fy) or [f"c{i}" for i in range(width)]) for fy in paths}
    first, *_ = own.values()
    columns = list(dict.fromkeys([*first, "fy", *(n for names in own.values() for n in names)]))
    cells = _text_schema([f"c{i}" for i in range(max(map(len, own.values())))])
    periods = spark.createDataFrame([(_place(path), fy, names) for (fy, path), names in zip(paths.items(), own.values())],
                                    "_place string, fy string, _names array<string>")
    bare = F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "")
    single = [_place(p) for p in paths.values()]  # a period is a folder, or one file
    lines = spark.read.text(list(paths.values())).filter(F.trim("value") != "").select(
        F.from_csv("value", cells.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"mode": "PERMISSIVE"}).alias("_cells"),
        F.when(bare.isin(single), bare).otherwise(F.regexp_replace(bare, "/[^/]*$", "")).alias("_place"))
    lines = lines.select(F.array("_cells.*").alias("_cells"), "_place").join(periods, "_place", "left")
    unknown = F.raise_error(F.concat(F.lit("no period for "), F.col("_place"))).cast("string")

    def cell(name: str) -> Column:
        at = F.nullif(F.array_position("_names", name), F.lit(0).cast("bigint")).cast("int")
        return F.try_element_at("_cells", at).alias(name)

    return lines.withColumn("fy", F.coalesce("fy", unknown)).select(*[F.col("fy") if c == "fy" else cell(c) for c in columns])


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _place(path: str) -> str:
    """A path as file metadata has it, without scheme and host."""
    return quote(re.sub(_SCHEME, "", path).rstrip("/"), safe="/!$&'()*+,;=:@-._~")


def read_long_run(spark: SparkSession, path) -> DataFrame:
    """The long-run yearly file: one label form, and NULL for ``No data`` or blanks."""
    raw = spark.read.schema(_text_schema(LONG_RUN_COLUMNS)).option("header", True).csv(path)
    return raw.select(
        fiscal_label(F.col("Year")).alias("fy"),
        *[parse_number(F.col(f"`{source}`")).alias(name)
          for source, name in LONG_RUN_COLUMNS.items() if source != "Year"])
