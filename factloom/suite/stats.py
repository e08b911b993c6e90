"""Selections, sums, trends, comparisons and rankings over the canonical facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.operators import filters as P
from factloom.operators import ranking as R
from factloom.plans.facts import build_facts
from factloom.schema import FACT_COLUMNS, MEASURES, NATURAL_KEY
from factloom.sources.shared import fresh_path, settled
from factloom.sources.snapshots import SnapshotStore
from factloom.suite.registry import query
from factloom.suite.sql import over_facts

FY_A, FY_B, FY_TOP = "1998-99", "1999-00", "1999-00"
HEADLINE = ("2000-01", 1)
_COLUMNS = ", ".join(FACT_COLUMNS)


def _pct(part, whole, places):
    return f"round_even(100e0 * {part} / nullif({whole}, 0), {places})"


# -- selections --------------------------------------------------------------


@query("filter_facts", over_facts(f"""
SELECT {_COLUMNS} FROM facts WHERE window_mode = 'fy' AND fy = '{FY_A}'
  AND measure = 'received' AND bucket = 'personal'"""))
def _(t):
    return P.filter_facts(build_facts(t, ["received"], fys=[FY_A]), fy=FY_A,
                          measure="received", bucket="personal", level="fy")


@query("annual_rows", over_facts(f"""
SELECT {_COLUMNS} FROM facts WHERE quarter IS NULL"""))
def _(t):
    return P.annual_rows(build_facts(t, levels=("fy", "single_quarter")))


@query("search_facts", over_facts(f"""
SELECT {_COLUMNS} FROM facts
WHERE contains(lower(entity_name), 'r#00000001') AND measure = 'finalised'
  AND window_mode = 'single_quarter'"""))
def _(t):
    facts = build_facts(t, ["finalised"], levels=("single_quarter",), headline=True)
    return P.search_facts(facts, entity="R#00000001", measure="finalised", bucket="", fy="")


@query("list_entities", over_facts("""
SELECT DISTINCT entity_name FROM facts
WHERE NOT starts_with(entity_name, 'x') AND lower(entity_name) <> 'total'"""))
def _(t):
    return P.list_entities(build_facts(t, levels=("fy", "single_quarter"), headline=True))


@query("list_groups", over_facts("SELECT DISTINCT measure_group FROM facts"))
def _(t):
    return P.list_groups(build_facts(t))


@query("measures_by_group", over_facts("""
SELECT measure_group, array_to_string(list_sort(list(DISTINCT measure)), ',') AS measures
FROM facts GROUP BY measure_group"""))
def _(t):
    grouped = P.measures_by_group(build_facts(t, buckets=("total",)))
    return grouped.withColumn("measures", F.array_join("measures", ","))


@query("dataset_profile", over_facts("""
SELECT 'measure' AS attribute, measure AS value FROM facts GROUP BY ALL
UNION ALL SELECT 'measure_group', measure_group FROM facts GROUP BY ALL
UNION ALL SELECT 'fy', fy FROM facts GROUP BY ALL
UNION ALL SELECT 'window_mode', unnest(['single_quarter', 'cumulative', 'fy'])
UNION ALL SELECT 'fact_count', CAST(count(*) AS VARCHAR) FROM facts"""))
def _(t):
    return P.dataset_profile(build_facts(
        t, levels=("fy", "single_quarter", "cumulative"), headline=True))


@query("filter_options", over_facts("""
SELECT 'entity' AS dimension, entity_name AS option FROM facts GROUP BY ALL
UNION ALL SELECT 'bucket', bucket FROM facts GROUP BY ALL
UNION ALL SELECT 'fy', fy FROM facts GROUP BY ALL"""))
def _(t):
    return P.filter_options(build_facts(t, headline=True))


@query("present_buckets", over_facts("""
SELECT bucket, CAST(list_position(['personal', 'other', 'total'], bucket) AS INTEGER) AS ord
FROM facts GROUP BY bucket"""))
def _(t):
    return P.present_buckets(build_facts(t))


@query("exclude_pseudo", over_facts("""
SELECT fy, quarter, measure, bucket, count(*) AS entities, sum(value) AS value FROM facts
WHERE window_mode = 'single_quarter' AND lower(entity_name) <> 'total' GROUP BY ALL"""))
def _(t):
    facts = build_facts(t, levels=("single_quarter",), headline=True)
    return P.exclude_pseudo(facts).groupBy("fy", "quarter", "measure", "bucket").agg(
        F.count(F.lit(1)).alias("entities"), F.sum("value").alias("value"))


# -- sums and trends ---------------------------------------------------------


@query("sum_measure", over_facts("""
SELECT round_even(coalesce(sum(value), 0), 0) AS value FROM facts
WHERE window_mode = 'fy' AND measure = 'decided' AND bucket = 'total'"""))
def _(t):
    return A.sum_measure(P.at_level(build_facts(t, ["decided"])), "decided")


@query("summarize_entities", over_facts("""
SELECT count(*) AS row_count, round_even(sum(value), 0) AS total, 'fy' AS basis FROM facts
WHERE window_mode = 'fy' AND measure = 'refused' AND bucket = 'total'"""))
def _(t):
    return A.summarize_entities(build_facts(t, ["refused"]), measure="refused")


@query("entity_totals", over_facts(f"""
SELECT entity_name, round_even(sum(value), 0) AS value, 'fy' AS basis FROM facts
WHERE window_mode = 'fy' AND fy = '{FY_B}' AND measure = 'finalised' AND bucket = 'total'
GROUP BY entity_name"""))
def _(t):
    return A.entity_totals(build_facts(t, ["finalised"], fys=[FY_B]), FY_B, "finalised")


@query("distinct_entities", over_facts("""
SELECT count(DISTINCT entity_name) AS entities FROM facts
WHERE window_mode = 'fy' AND lower(entity_name) <> 'total'"""))
def _(t):
    return A.distinct_entities(build_facts(t, headline=True))


@query("trend", over_facts("""
SELECT fy, round_even(sum(CASE WHEN measure = 'received' AND bucket = 'total'
                               THEN value END), 0) AS value, 'fy' AS basis
FROM facts WHERE window_mode = 'fy' GROUP BY fy"""))
def _(t):
    return A.trend(build_facts(t, ["received"]), "received")


@query("compare_periods", over_facts(f"""
SELECT '{FY_A}' AS fy_a, '{FY_B}' AS fy_b, round_even(a, 0) AS value_a,
       round_even(b, 0) AS value_b, round_even(b - a, 0) AS change,
       {_pct('(b - a)', 'a', 0)} AS change_pct, 'fy' AS basis
FROM (SELECT coalesce(sum(value) FILTER (fy = '{FY_A}'), 0) AS a,
             coalesce(sum(value) FILTER (fy = '{FY_B}'), 0) AS b
      FROM facts WHERE window_mode = 'fy' AND measure = 'received' AND bucket = 'total')"""))
def _(t):
    return A.compare_periods(build_facts(t, ["received"], fys=[FY_A, FY_B]), FY_A, FY_B)


@query("by_portfolio", over_facts(f"""
SELECT coalesce(nullif(portfolio, ''), 'Unmapped') AS portfolio,
       round_even(sum(value), 0) AS value, 'fy' AS basis
FROM facts WHERE window_mode = 'fy' AND fy = '{FY_B}' AND measure = 'received'
  AND bucket = 'total' GROUP BY 1"""))
def _(t):
    return A.by_portfolio(build_facts(t, ["received"], fys=[FY_B]), FY_B, "received")


_QUARTER = (f"window_mode = 'single_quarter' AND derived AND fy = '{HEADLINE[0]}' "
            f"AND quarter = {HEADLINE[1]} AND bucket = 'total'")


@query("quarter_headline", over_facts(f"""
SELECT measure, round_even(sum(value), 0) AS value, count(*) AS source_rows
FROM facts WHERE {_QUARTER} GROUP BY measure"""))
def _(t):
    facts = build_facts(t, levels=("single_quarter",), headline=True, fys=[HEADLINE[0]])
    return A.quarter_headline(facts, *HEADLINE)


_SHARES = ("within_statutory", "granted_full", "granted_part", "refused")


@query("quarter_share", over_facts(f"""
SELECT p.measure, {_pct('p.value', 'd.value', 0)} AS share
FROM (SELECT measure, sum(value) AS value FROM facts WHERE {_QUARTER} GROUP BY measure) p,
     (SELECT sum(value) AS value FROM facts WHERE {_QUARTER} AND measure = 'decided') d
WHERE p.measure IN {_SHARES}"""))
def _(t):
    facts = build_facts(t, levels=("single_quarter",), headline=True, fys=[HEADLINE[0]])
    return A.quarter_share(facts, *HEADLINE, parts=_SHARES)


SERIES = ", ".join(
    f"round_even(sum(CASE WHEN measure = '{m}' AND bucket = 'total' THEN value END), 0) AS {m}"
    for m in MEASURES)


def over_series(body: str) -> str:
    """``body`` over ``series``: one row per annual year, one column per measure."""
    return over_facts(
        f", series AS (SELECT fy, {SERIES} FROM facts WHERE window_mode = 'fy' GROUP BY fy)\n{body}")


@query("pct_trend", over_series(
    f"SELECT fy, {_pct('refused', 'decided', 1)} AS value, 'fy' AS basis FROM series"))
def _(t):
    return A.ratio_trend(build_facts(t, ["refused", "decided"]), ["refused"])


@query("combined_pct_trend", over_series(
    f"SELECT fy, {_pct('(granted_full + granted_part)', 'decided', 1)} AS value, 'fy' AS basis FROM series"))
def _(t):
    parts = ["granted_full", "granted_part"]
    return A.ratio_trend(build_facts(t, [*parts, "decided"]), parts)


@query("within_pct_trend", over_series(
    f"SELECT fy, {_pct('within_statutory', 'decided', 1)} AS value, 'fy' AS basis FROM series"))
def _(t):
    return A.ratio_trend(build_facts(t, ["within_statutory", "decided"]), ["within_statutory"])


@query("multi_measure_trend", over_series(
    "SELECT fy, granted_full, granted_part, refused, withdrawn, 'fy' AS basis FROM series"))
def _(t):
    return A.multi_measure_trend(
        build_facts(t, ["granted_full", "granted_part", "refused", "withdrawn"]))


@query("zip_series", over_series("""
SELECT fy, finalised AS left_value, received AS right_value,
       finalised / nullif(received, 0) AS ratio, 'fy' AS basis FROM series"""))
def _(t):
    return A.zip_series(build_facts(t, ["finalised", "received"]), "finalised", "received")


def pearson_sql(x, y):
    """Coefficient over complete pairs of two expressions, by the database's own function."""
    both = f"FILTER ({x} IS NOT NULL AND {y} IS NOT NULL)"
    return (f"CASE WHEN count(*) {both} >= 2 AND min({x}) {both} < max({x}) {both} "
            f"AND min({y}) {both} < max({y}) {both} THEN round_even(corr({x}, {y}) {both}, 3) + 0e0 END")


@query("pearson", over_series(
    f"SELECT {pearson_sql('within_statutory', 'received')} AS value FROM series"))
def _(t):
    return A.pearson_trend(build_facts(t, ["within_statutory", "received"]))


@query("pearson_by_entity", over_facts(f"""
SELECT entity_name, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS years,
       {pearson_sql('x', 'y')} AS r
FROM (SELECT entity_name, fy, sum(value) FILTER (measure = 'within_statutory') AS x,
             sum(value) FILTER (measure = 'received') AS y
      FROM facts WHERE window_mode = 'fy' AND bucket = 'total'
        AND measure IN ('within_statutory', 'received') GROUP BY ALL)
GROUP BY entity_name"""))
def _(t):
    return A.pearson_by_entity(
        build_facts(t, ["within_statutory", "received"], buckets=("total",)))


# -- movers, rankings, pages -------------------------------------------------

_RATES = f"""
  SELECT entity_name,
         sum(value) FILTER (fy = '{FY_A}' AND measure = 'refused') AS pa,
         sum(value) FILTER (fy = '{FY_A}' AND measure = 'decided') AS wa,
         sum(value) FILTER (fy = '{FY_B}' AND measure = 'refused') AS pb,
         sum(value) FILTER (fy = '{FY_B}' AND measure = 'decided') AS wb
  FROM facts WHERE window_mode = 'fy' AND bucket = 'total' GROUP BY entity_name"""
MOVERS = f"""
SELECT entity_name, round_even(100e0 * pa / wa, 1) AS fy_a_rate,
       round_even(100e0 * pb / wb, 1) AS fy_b_rate,
       round_even(100e0 * pb / wb - 100e0 * pa / wa, 1) + 0e0 AS change, 'fy' AS basis
FROM ({_RATES}) WHERE wa > 0 AND wb > 0"""


def _rate_facts(t):
    return build_facts(t, ["refused", "decided"], fys=[FY_A, FY_B], buckets=("total",))


@query("period_movers", over_facts(MOVERS))
def _(t):
    return A.period_movers(_rate_facts(t), FY_A, FY_B)


_PERIODS = """SELECT fy, quarter, sum(value) AS v FROM facts
  WHERE window_mode = '{level}' AND NOT derived AND measure = '{measure}' AND bucket = 'total' GROUP BY fy, quarter"""


def _change_sql(level, measure):
    return (f"SELECT fy, quarter, round_even(v, 0) AS value, round_even(p, 0) AS previous, "
            f"round_even(v - p, 0) AS change, {_pct('(v - p)', 'p', 1)} AS change_pct, '{level}' AS basis "
            f"FROM (SELECT *, lag(v) OVER (ORDER BY fy, quarter) AS p FROM ({_PERIODS.format(level=level, measure=measure)}))")


@query("period_change", over_facts(
    f"{_change_sql('fy', 'received')} UNION ALL {_change_sql('single_quarter', 'received')}"))
def _(t):
    """Year on year and quarter on quarter."""
    facts = build_facts(t, ["received"], levels=("fy", "single_quarter"), folded=True)
    return A.period_change(facts).unionByName(A.period_change(facts, level="single_quarter"))


_CHANGES = f"""changes AS (
  SELECT entity_name, sum(CASE WHEN fy = '{FY_B}' THEN value ELSE -value END) AS change FROM facts
  WHERE window_mode = 'fy' AND measure = 'finalised' AND bucket = 'total' AND fy IN ('{FY_A}', '{FY_B}')
  GROUP BY entity_name)"""


@query("change_contributions", over_facts(f"""
, {_CHANGES}
SELECT entity_name, round_even(change, 0) AS change,
       {_pct('change', '(SELECT sum(change) FROM changes)', 1)} + 0e0 AS share_pct, 'fy' AS basis FROM changes"""))
def _(t):
    facts = build_facts(t, ["finalised"], fys=[FY_A, FY_B], buckets=("total",))
    return A.change_contributions(facts, FY_A, FY_B, "finalised")


@query("change_counts", over_facts(f"""
, {_CHANGES}
SELECT count(*) FILTER (change > 0) AS up, count(*) FILTER (change < 0) AS down,
       count(*) FILTER (change = 0) AS same FROM changes"""))
def _(t):
    facts = build_facts(t, ["finalised"], fys=[FY_A, FY_B], buckets=("total",))
    return A.change_counts(facts, FY_A, FY_B, "finalised")


@query("top_movers", over_facts(f"{MOVERS} ORDER BY abs(change) DESC, entity_name LIMIT 20"))
def _(t):
    return R.top_movers(_rate_facts(t), FY_A, FY_B)


def _top_sql(measure):
    return (f"SELECT entity_name, round_even(sum(value), 0) AS value FROM facts "
            f"WHERE window_mode = 'fy' AND fy = '{FY_TOP}' AND measure = '{measure}' "
            f"AND bucket = 'total' GROUP BY entity_name "
            f"ORDER BY sum(value) DESC, entity_name LIMIT 20")


@query("top_entities", over_facts(f"""
SELECT 'received' AS measure, * FROM ({_top_sql('received')})
UNION ALL SELECT 'decided', * FROM ({_top_sql('decided')})"""))
def _(t):
    def top(m):
        facts = build_facts(t, [m], fys=[FY_TOP], buckets=("total",))
        return R.top_entities(facts, m, FY_TOP).select(F.lit(m).alias("measure"), "*")

    return top("received").unionByName(top("decided"))


@query("top_contributors", over_facts(f"""
SELECT entity_name, round_even(sum(value), 0) AS value, 'fy' AS basis,
       count(*) OVER () AS entities
FROM facts WHERE window_mode = 'fy' AND fy = '{FY_TOP}' AND measure = 'finalised'
  AND bucket = 'total' GROUP BY entity_name ORDER BY value DESC, entity_name LIMIT 20"""))
def _(t):
    facts = build_facts(t, ["finalised"], fys=[FY_TOP], buckets=("total",))
    return R.top_contributors(facts, FY_TOP, "finalised")


@query("page_facts", over_facts(f"""
SELECT {_COLUMNS}, count(*) OVER () AS total FROM facts
WHERE window_mode = 'fy'
ORDER BY entity_key, fy, quarter NULLS FIRST, measure_group, measure, bucket, window_mode
LIMIT 1000 OFFSET 2000"""))
def _(t):
    return R.page_facts(build_facts(t, folded=True), limit=1000, offset=2000)


_PAGE_ORDER = "entity_key, fy, quarter NULLS FIRST, measure_group, measure, bucket, window_mode"


@query("page_stored", over_facts(f"""
, stored AS (SELECT {_COLUMNS}, count(*) OVER () AS total, row_number() OVER (ORDER BY {_PAGE_ORDER}) - 1 AS place
  FROM facts WHERE window_mode = 'fy')
SELECT page, {_COLUMNS}, total FROM stored, (VALUES ('first', 0, 100), ('deep', 2000, 3000), ('next', 3000, 3500)) p(page, low, high)
WHERE place >= low AND place < high"""))
def _(t):
    """Pages of a stored snapshot by position, and the next one by the last key seen."""
    store = SnapshotStore(t.spark, fresh_path(t.spark, "paged"))
    written = store.write(build_facts(t, folded=True), "all", "fy", ["orders"], "1")
    pages = store.pages(written.dataset_id, 4000)
    deep = settled(pages.page(1000, 2000), "page")
    last = deep.orderBy(*[F.desc_nulls_last(k) for k in NATURAL_KEY]).first().asDict()
    named = {"first": pages.page(100), "deep": deep, "next": store.page(written.dataset_id, 500, after=last)}
    out = None
    for name, rows in named.items():
        part = rows.select(F.lit(name).alias("page"), "*")
        out = part if out is None else out.unionByName(part)
    return out


@query("bar_scale", over_series("""
SELECT 'trend' AS figure_key, fy AS category, received AS value,
       100e0 * received / max(received) OVER () AS height FROM series"""))
def _(t):
    series = A.trend(build_facts(t, ["received"]), "received")
    return R.bar_scale(series.select(F.lit("trend").alias("figure_key"),
                                     F.col("fy").alias("category"), "value"))
