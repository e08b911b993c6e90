"""Ingest queries: fiscal periods, canonical facts, wide sheets, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.periods import fiscal_quarter, fiscal_year
from factloom.plans.facts import build_facts
from factloom.schema import FACT_COLUMNS
from factloom.suite.registry import query
from factloom.suite.sql import fy, over_facts, quarter

_COLUMNS = ", ".join(FACT_COLUMNS)


@query("fiscal_period", f"""
SELECT o_orderkey, {fy('o_orderdate')} AS fy, {quarter('o_orderdate')} AS quarter FROM orders""")
def _(t):
    date = F.col("o_orderdate")
    return t.orders.select("o_orderkey", fiscal_year(date).alias("fy"),
                           fiscal_quarter(date).alias("quarter"))


@query("build_facts", over_facts(f"""
SELECT {_COLUMNS} FROM facts WHERE window_mode <> 'cumulative'"""))
def _(t):
    return build_facts(t, levels=("fy", "single_quarter"), headline=True)


@query("cumulative_levels", over_facts(f"""
SELECT {_COLUMNS} FROM facts WHERE window_mode <> 'fy' AND NOT derived"""))
def _(t):
    return build_facts(t, levels=("single_quarter", "cumulative"))
