"""Domain, duplicate and foreign-key checks, reconciliation and gates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.numbers import half_even
from factloom.schema import BUCKETS, FACTS, NATURAL_KEY, WINDOW_MODES


FACT_RULE_NAMES = ("window_mode_domain", "bucket_domain", "quarter_domain") + tuple(
    f"{f.name}_not_null" for f in FACTS.fields if not f.nullable)


class GateError(RuntimeError):
    """A check that must hold does not."""


def fact_rules() -> dict[str, Column]:
    """Rule name -> condition that marks a violating fact row."""
    rules = {
        "window_mode_domain": ~F.col("window_mode").isin(*WINDOW_MODES),
        "bucket_domain": ~F.col("bucket").isin(*BUCKETS),
        "quarter_domain": ~F.col("quarter").between(1, 4),
    }
    for field in FACTS.fields:
        if not field.nullable:
            rules[f"{field.name}_not_null"] = F.col(field.name).isNull()
    return rules


def domain_check(rows: DataFrame, rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Violations per rule, all rules counted in one pass."""
    rules = fact_rules() if rules is None else rules
    counts = rows.agg(*[F.count_if(bad).alias(name) for name, bad in rules.items()])
    cells = []
    for name in rules:
        cells += [F.lit(name), F.col(name)]
    return counts.select(F.stack(F.lit(len(rules)), *cells).alias("rule", "violations"))


def duplicate_check(rows: DataFrame, key: Iterable[str] = NATURAL_KEY) -> DataFrame:
    """Keys held by more than one row; NULL parts of a key count as equal."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def fk_check(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Foreign keys without a parent (NULL included) and their row counts.

    The child is reduced to its distinct keys before the join, so one hot key
    costs one row in the shuffle.
    """
    keys = child.groupBy(F.col(fk).alias("key")).agg(F.count(F.lit(1)).alias("orphan_rows"))
    return keys.join(parent.select(F.col(pk).alias("key")), "key", "left_anti")


def reconcile_totals(rows: DataFrame, controls: DataFrame, keys: Iterable[str],
                     tolerance: float = 0.0) -> DataFrame:
    """Sums of ``rows`` against ``controls`` (keys + ``expected``), both ways round."""
    keys = list(keys)
    sums = rows.groupBy(*keys).agg(F.sum("value").alias("actual"))
    right = controls.select(*[F.col(k).alias(f"_{k}") for k in keys], "expected")
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_{k}"))
        on = same if on is None else on & same
    joined = sums.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), on, "full")
    status = (
        F.when(F.col("_r").isNull(), "no_control")
        .when(F.col("_l").isNull(), "no_rows")
        .when(F.abs(F.col("actual") - F.col("expected")) <= tolerance, "match")
        .otherwise("mismatch"))
    return joined.select(
        *[F.coalesce(k, f"_{k}").alias(k) for k in keys], "actual", "expected",
        (F.col("actual") - F.col("expected")).alias("diff"), status.alias("status"))


def golden_gate(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """Headline values against ``expected`` (fy, quarter, measure, expected).

    Missing rows sum to 0, which is a mismatch unless 0 was expected.
    """
    sums = facts.filter(
        (F.col("window_mode") == "single_quarter") & (F.col("bucket") == "total")
        & F.col("derived")
    ).groupBy("fy", "quarter", "measure").agg(F.sum("value").alias("_sum"))
    joined = expected.join(sums, ["fy", "quarter", "measure"], "left")
    actual = half_even(F.coalesce("_sum", F.lit(0.0)))
    return joined.select("fy", "quarter", "measure", "expected", actual.alias("actual"),
                         (actual == F.col("expected")).alias("passed"))


def require(checks: DataFrame, passed: Column, what: str, shown: int = 20) -> None:
    """Raise :class:`GateError` if any row of a check table does not pass."""
    failures = checks.filter(~F.coalesce(passed, F.lit(False))).limit(shown).collect()
    if failures:
        raise GateError(f"{what}: {[row.asDict() for row in failures]}")


def schema_diff(selected: Iterable[str], declared: T.StructType) -> dict[str, list[str]]:
    """Columns named on one side only."""
    selected, known = set(selected), set(declared.fieldNames())
    return {"undeclared": sorted(selected - known), "unused": sorted(known - selected)}


def row_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (with multiplicity) that only one of two tables holds."""
    columns = left.columns
    counted = left.select(*columns, F.lit(1).alias("_n")).unionByName(
        right.select(*columns, F.lit(-1).alias("_n")))
    return counted.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter(
        F.col("surplus") != 0)
