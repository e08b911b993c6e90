"""Number parsing, half-even rounding, guarded ratios and number labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def parse_number(raw: Column, on_bad: str = "null") -> Column:
    """Text cell to double: blanks trimmed, thousands commas dropped.

    Cells that hold no number become NULL, or 0 with ``on_bad='zero'`` (the
    behaviour of the published ingest).
    """
    if on_bad not in ("null", "zero"):
        raise ValueError(f"on_bad must be 'null' or 'zero', not {on_bad!r}")
    text = F.regexp_replace(F.regexp_replace(raw.cast("string"), r"^\s+|\s+$", ""), ",", "")
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.coalesce(value, F.lit(0.0)) if on_bad == "zero" else value


def half_even(value: Column, places: int = 0) -> Column:
    return F.bround(value.cast("double"), places)


def percent(part: Column, whole: Column, places: int = 0) -> Column:
    """100 x part / whole, half-even; NULL when either is NULL or whole is 0."""
    return half_even(F.try_divide(F.lit(100.0).cast("double") * part.cast("double"),
                                  whole.cast("double")), places)


def number_label(value: Column, missing: str = "no data") -> Column:
    """Thousands separators, at most two decimals, no trailing zeros."""
    text = F.regexp_replace(F.format_number(value.cast("double"), 2), r"\.?0+$", "")
    return F.coalesce(text, F.lit(missing))
