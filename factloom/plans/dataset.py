"""Question surface over a fact table: named dataset ops and the read API."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.operators import aggregates as A
from factloom.operators import filters as P
from factloom.operators import ranking as R
from factloom.plans import stats as S
from factloom.schema import DEFAULT_PAGE_LIMIT, DEFAULT_TOP_N

# The op names.
OPS = (
    "list_agencies", "filter_agencies", "summarize_agencies", "trend", "compare_period",
    "top_contributors", "by_portfolio", "kpis", "classes",
)


def run_op(facts: DataFrame, op: str, params: dict | None = None,
           pins: S.Pins = S.PUBLISHED_PINS) -> DataFrame:
    """Answer one named op.  ``window_mode`` picks the level (annual by default);
    without ``bucket`` every bucket counts, totals beside their parts.
    """
    params = dict(params or {})
    name = (op or "").strip().lower()
    level = params.get("window_mode", P.ANNUAL)
    chosen = {k: params.get(k) or None for k in ("fy", "measure", "bucket")}
    if name == "list_agencies":
        return P.list_entities(facts, ordered=True)
    if name in ("filter_agencies", "top_contributors"):
        return R.top_contributors(facts, **chosen, level=level,
                                  n=int(params.get("top_n", DEFAULT_TOP_N)))
    if name == "summarize_agencies":
        return A.summarize_entities(facts, chosen["measure"], chosen["bucket"], level)
    if name == "trend":
        return A.trend(facts, params.get("measure", "received")).orderBy("fy")
    if name == "compare_period":
        return A.compare_periods(facts, params.get("fy_a"), params.get("fy_b"),
                                 params.get("measure", "received"), level)
    if name == "by_portfolio":
        return A.by_portfolio(facts, **chosen, level=level)
    if name == "kpis":
        return S.kpi_values(facts, pins).select("stat_key", "value", "listed", "basis")
    if name == "classes":
        return P.list_groups(facts).orderBy("measure_group")
    if name == "gaps":
        raise ValueError("gaps does not apply here; use trend, compare_period or top_contributors")
    raise ValueError(f"unknown op {op!r}; allowed: {', '.join(OPS)}")


def dataset_info(facts: DataFrame) -> DataFrame:
    return P.dataset_profile(facts, {"figure_key": S.FIGURE_KEYS, "stat_key": S.STAT_KEYS})


def all_figures(facts: DataFrame, pins: S.Pins = S.PUBLISHED_PINS) -> DataFrame:
    return S.export_all(facts, pins)


def facts_page(facts: DataFrame, limit: int = DEFAULT_PAGE_LIMIT, offset: int = 0,
               after: dict | None = None, **search) -> DataFrame:
    """Filtered facts, one page of them, with the number found."""
    return R.page_facts(P.search_facts(facts, **search), limit, offset, after)


def measure_groups(facts: DataFrame) -> DataFrame:
    return P.measures_by_group(facts).orderBy("measure_group")
