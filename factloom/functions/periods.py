"""Fiscal calendar: years run July to June, quarter 1 is July to September."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fiscal_start_year(date: Column) -> Column:
    return F.year(date) - F.when(F.month(date) < 7, 1).otherwise(0)


def start_label(start: Column) -> Column:
    """Label of the fiscal year that starts in a calendar year, e.g. ``1999-00``."""
    return F.format_string("%d-%02d", start, F.pmod(start + 1, F.lit(100)))


def fiscal_year(date: Column) -> Column:
    return start_label(fiscal_start_year(date))


def fiscal_quarter(date: Column) -> Column:
    return F.floor(F.pmod(F.month(date) + 5, F.lit(12)) / 3).cast("int") + 1


def with_fiscal_period(df: DataFrame, date_column: str) -> DataFrame:
    date = F.col(date_column)
    return df.withColumns({"fy": fiscal_year(date), "quarter": fiscal_quarter(date)})


def fiscal_label(raw: Column) -> Column:
    """Bring ``1982-1983`` and ``1982-83`` to the one form ``1982-83``."""
    return F.regexp_replace(F.trim(raw), r"^(\d{4})-\d{2}(\d{2})$", "$1-$2")


def fiscal_range(fy: str) -> tuple[dt.datetime, dt.datetime]:
    """First instant of a fiscal year and of the next, for date pruning."""
    start = int(fy[:4])
    return dt.datetime(start, 7, 1), dt.datetime(start + 1, 7, 1)


def in_fiscal_years(date: Column, fys) -> Column:
    """Date-range predicate for the given years, one that reaches the scan."""
    if not fys:
        raise ValueError("at least one fiscal year is needed")
    spans = sorted(fiscal_range(fy) for fy in set(fys))
    merged = [spans[0]]
    for low, high in spans[1:]:
        if low == merged[-1][1]:
            merged[-1] = (merged[-1][0], high)
        else:
            merged.append((low, high))
    predicate = None
    for low, high in merged:
        # text literals: a datetime literal would pass through the session zone
        span = (date >= F.lit(low.isoformat(" ")).cast("timestamp_ntz")) & (
            date < F.lit(high.isoformat(" ")).cast("timestamp_ntz"))
        predicate = span if predicate is None else predicate | span
    return predicate


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    seconds = F.date_part(F.lit("SECOND"), ts)
    return (
        F.unix_date(ts.cast("date")).cast("bigint") * F.lit(86_400_000_000)
        + F.hour(ts).cast("bigint") * F.lit(3_600_000_000)
        + F.minute(ts).cast("bigint") * F.lit(60_000_000)
        + (seconds * 1_000_000).cast("bigint")
    )
