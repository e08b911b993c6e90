"""Canonical columns, domains and the fixed values the operators rely on."""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# These must be exactly so for results to be right.
# --------------------------------------------------------------------------

WINDOW_MODES = ("single_quarter", "cumulative", "fy")
BUCKETS = ("personal", "other", "total")
MEASURE_GROUP = "requests"
MEASURES = (
    "received",
    "finalised",
    "decided",
    "within_statutory",
    "granted_full",
    "granted_part",
    "refused",
    "withdrawn",
)

# Positional layout of a request sheet: measure -> (personal, other, total).
POSITIONAL_TRIPLES = {"received": (4, 5, 6), "finalised": (16, 17, 18)}
POSITIONAL_WIDTH = 22
HEADER_ROWS = 3

# Header prefix (lower case) -> measure, for the sheets found by header text.
ACTION_PREFIXES = {
    "granted in full": "granted_full",
    "granted in part": "granted_part",
    "access refused": "refused",
    "withdrawn": "withdrawn",
    "total determined": "decided",
}
RESPONSE_PREFIXES = {"response time within": "within_statutory"}

# Published single-quarter headline of the latest year's first quarter.
PUBLISHED_HEADLINE_PERIOD = ("2025-26", 1)
PUBLISHED_HEADLINE = {
    "received": 12359,
    "finalised": 11549,
    "decided": 7344,
    "within_statutory": 5167,
    "granted_full": 1426,
    "granted_part": 3968,
    "refused": 1950,
    "withdrawn": 3955,
}

TOTAL_KEY = "_all"
TOTAL_NAME = "Total"
UNMAPPED = "Unmapped"
DEFAULT_TOP_N = 20
DEFAULT_PAGE_LIMIT = 1000
QUOTA_LIMIT = 60
QUOTA_WINDOW_SECONDS = 60.0

CHART_TYPES = ("bar", "hbar", "line", "area", "pie", "table", "kpi")

# Text of a citation pointer: {c:job.turn.call.field.path}
POINTER_PATTERN = r"\{c:([\w.\[\]]+)\}"
# One step of a pointer's path: a name or an index in brackets.
POINTER_STEP = r"([^.\[\]]+)|(\[\d+\])"

# --------------------------------------------------------------------------
# Table schemas
# --------------------------------------------------------------------------


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


_S, _L, _I, _D, _B = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
)

FACTS = _struct(
    ("entity_key", _S, False),
    ("entity_name", _S, False),
    ("fy", _S, False),
    ("quarter", _I, True),
    ("measure_group", _S, False),
    ("measure", _S, False),
    ("bucket", _S, False),
    ("value", _D, False),
    ("derived", _B, False),
    ("window_mode", _S, False),
    ("portfolio", _S, True),
)
FACT_COLUMNS = tuple(FACTS.fieldNames())

# The columns a row hash covers.  The portfolio is looked up at read time, so a
# hash over it could not be reproduced from the stored table.
HASH_COLUMNS = tuple(c for c in FACT_COLUMNS if c != "portfolio")

# Natural key of a fact; quarter may be NULL and NULLs count as equal.
NATURAL_KEY = (
    "entity_key",
    "fy",
    "quarter",
    "measure_group",
    "measure",
    "bucket",
    "window_mode",
)

SNAPSHOTS = _struct(
    ("dataset_id", _L, False),
    ("period_label", _S, False),
    ("window_mode", _S, False),
    ("source_files", T.ArrayType(_S), False),
    ("normaliser_ver", _S, False),
    ("content_digest", _S, False),
    ("fact_count", _L, False),
    ("superseded_by", _L, True),
    ("created_at", T.TimestampType(), False),
)

ARTIFACTS = _struct(
    ("artifact_id", _L, False),
    ("version", _I, False),
    ("artifact_type", _S, False),
    ("artifact_key", _S, False),
    ("user_id", _L, True),
    ("dataset_id", _L, False),
    ("request_text", _S, False),
    ("spec_json", _S, False),
    ("model", _S, True),
    ("status", _S, False),
    ("created_at", T.TimestampType(), False),
)

OPS = _struct(
    ("op_id", _L, False),
    ("artifact_id", _L, False),
    ("dataset_id", _L, False),
    ("kind", _S, False),
    ("op", _S, False),
    ("params", _S, False),
    ("row_count", _L, True),
    ("rows_hash", _S, True),
    ("result_value", _S, False),
)

TOOL_CALLS = _struct(
    ("artifact_id", _L, False),
    ("seq", _I, False),
    ("tool", _S, False),
    ("op", _S, False),
    ("input_json", _S, False),
    ("output_json", _S, False),
)

SPEC = T.StructType(
    [
        T.StructField("title", _S),
        T.StructField(
            "panels",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("title", _S),
                        T.StructField("stat", _S),
                        T.StructField("figure", _S),
                        T.StructField("basis", _S),
                    ]
                )
            ),
        ),
    ]
)
