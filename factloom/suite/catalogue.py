"""The closed catalogue: stat board, figures, full export, filtered figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators.aggregates import presence_check
from factloom.plans import stats as S
from factloom.plans.dataset import run_op
from factloom.plans.facts import build_facts
from factloom.sources.shared import settled
from factloom.suite.registry import query
from factloom.suite.sql import over_facts
from factloom.suite.sqlstats import SERIES_CTE, figure_rows, hashed_facts, stat_rows
from factloom.suite.stats import FY_A, FY_B, FY_TOP, HEADLINE, MOVERS, pearson_sql

PINS = S.Pins(*HEADLINE, FY_TOP, (FY_A, FY_B))
STAT_LIST = ", ".join(f"'{k}'" for k in S.STAT_KEYS)
# annual rows of every entity plus the headline rows: what the catalogue reads
CATALOGUE = "window_mode = 'fy' OR derived"
CATALOGUE_HASHED = hashed_facts(CATALOGUE)


def catalogue_facts(t, **kw):
    return build_facts(t, levels=("fy",), headline=True, **kw)


@query("kpi_board", f"""
WITH {CATALOGUE_HASHED}
SELECT * FROM ({stat_rows(PINS, pearson_sql)}) WHERE stat_key IN ({STAT_LIST})""")
def _(t):
    return S.board_of(catalogue_facts(t, buckets=("total",)), PINS)


# the value of each list key as text
LISTED = f"""listed AS (
  SELECT figure_key AS stat_key, CAST(to_json(list({{'category': category, 'series': series, 'value': value}} ORDER BY category, series)) AS VARCHAR) AS listed
  FROM figs GROUP BY figure_key
  UNION ALL SELECT '{S.MOVERS_STAT}', CAST(to_json(list({{'entity_name': entity_name, 'fy_a_rate': fy_a_rate, 'fy_b_rate': fy_b_rate, 'change': change}}
    ORDER BY abs(change) DESC, entity_name)) AS VARCHAR) FROM (SELECT * FROM movers ORDER BY abs(change) DESC, entity_name LIMIT 20))"""


@query("kpi_values", f"""
WITH {CATALOGUE_HASHED}, {SERIES_CTE}, figs AS ({figure_rows(PINS)}), movers AS ({MOVERS}), {LISTED}
SELECT b.stat_key, value, listed, basis, source_rows
FROM ({stat_rows(PINS, pearson_sql)}) b LEFT JOIN listed USING (stat_key) WHERE b.stat_key IN ({STAT_LIST})""")
def _(t):
    return S.kpi_values(catalogue_facts(t, buckets=("total",)), PINS)


@query("figure_table", over_facts(f", {SERIES_CTE}\n{figure_rows(PINS)}"))
def _(t):
    facts = build_facts(t, buckets=("total",), folded=True)
    return S.figures(facts, S.summarised(facts, digest=False), PINS)


@query("export_all_stats", f"""
WITH {CATALOGUE_HASHED}, {SERIES_CTE},
board AS (SELECT * FROM ({stat_rows(PINS, pearson_sql)}) WHERE stat_key IN ({STAT_LIST})),
figs AS ({figure_rows(PINS)}),
movers AS ({MOVERS})
SELECT 'stat' AS kind, stat_key AS key, CAST(NULL AS VARCHAR) AS series,
       CAST(NULL AS VARCHAR) AS category, value, basis FROM board
UNION ALL SELECT 'figure', figure_key, series, category, value, 'fy' FROM figs
UNION ALL SELECT 'list', '{S.MOVERS_STAT}', unnest(['fy_a_rate', 'fy_b_rate', 'change']),
  entity_name, unnest([fy_a_rate, fy_b_rate, change]), 'fy' FROM movers""")
def _(t):
    return S.export_all(catalogue_facts(t, buckets=("total",)), PINS)


@query("presence_check", over_facts(f""", {SERIES_CTE}
, kept AS (SELECT * FROM facts WHERE window_mode = 'fy' AND measure <> 'refused'
             AND fy <> '{FY_TOP}'),
partial AS ({SERIES_CTE.split('AS (', 1)[1].rstrip(')').replace('FROM facts', 'FROM kept')}),
figs AS ({figure_rows(PINS).replace('FROM facts', 'FROM kept').replace('FROM series', 'FROM partial')}),
listed AS (SELECT unnest([{', '.join(f"'{k}'" for k, _ in S.catalogue_series())}]) AS figure_key,
                  unnest([{', '.join(f"'{n}'" for _, n in S.catalogue_series())}]) AS series)
SELECT l.figure_key, l.series, count(f.figure_key) > 0 AS has_data, count(f.value) > 0 AS has_values
FROM listed l LEFT JOIN figs f USING (figure_key, series) GROUP BY l.figure_key, l.series"""))
def _(t):
    """Facts without one measure and without the ranked year: some series have no value, some no row."""
    facts = build_facts(t, buckets=("total",), folded=True).filter(
        (F.col("measure") != "refused") & (F.col("fy") != FY_TOP))
    table = S.trend_figures(S.summarised(facts, digest=False), published=False).unionByName(
        S.top_figures(facts, PINS))
    listed = F.array(*[F.struct(F.lit(k).alias("figure_key"), F.lit(n).alias("series"))
                       for k, n in S.catalogue_series()])
    return presence_check(table, t.spark.range(1).select(F.inline(listed)))


@query("rederive_under_filter", over_facts(f"""
, scope AS (SELECT * FROM facts WHERE (window_mode = 'fy' OR derived)
            AND measure IN ('received', 'finalised')),
top AS (SELECT entity_name, sum(value) AS v FROM scope
        WHERE window_mode = 'fy' AND fy = '{FY_TOP}' AND measure = 'received'
          AND bucket = 'total' GROUP BY 1 ORDER BY v DESC, 1 LIMIT 20)
SELECT 'entity' AS filter, 'published' AS status, fy AS category, value,
       (SELECT count(*) FROM scope WHERE entity_name = 'Customer#000000007') AS fact_rows
FROM (SELECT fy, floor(sum(value) FILTER (measure = 'received' AND bucket = 'total') + 0.5) AS value
      FROM scope WHERE entity_name = 'Customer#000000007' AND quarter IS NULL GROUP BY fy)
UNION ALL SELECT 'bucket', 'not_published', NULL, NULL,
       (SELECT count(*) FROM scope WHERE bucket = 'personal')
UNION ALL SELECT 'fy', 'published', entity_name, floor(v + 0.5),
       (SELECT count(*) FROM scope WHERE fy = '{FY_TOP}') FROM top"""))
def _(t):
    facts = catalogue_facts(t, measures=["received", "finalised"])
    return S.rederive_all(facts, [
        S.Asked("entity", "requests_received_trend", entity="Customer#000000007"),
        S.Asked("bucket", "requests_finalised_trend", bucket="personal"),
        S.Asked("fy", "received_top20", fy=FY_TOP)], PINS)


_KINDS = {"year": ("fy",), "measure": ("measure",), "cell": ("fy", "measure", "bucket"), "all": ()}


def _counted_sql(kind, by):
    columns = [f"{c} AS {c}" if c in by else f"NULL AS {c}" for c in ("fy", "measure", "bucket")]
    return (f"SELECT '{kind}' AS selection, {', '.join(columns)}, count(DISTINCT entity_name) AS entities, true AS near FROM facts "
            f"WHERE window_mode = 'fy' AND lower(entity_name) <> 'total'"
            + (f" GROUP BY {', '.join(by)}" if by else ""))


# the exact counts, and that each sketched one is within four standard errors of it
@query("distinct_sketched", over_facts("\nUNION ALL ".join(_counted_sql(k, by) for k, by in _KINDS.items())))
def _(t):
    """Entities counted exactly from the facts, and from the sketches of the cells, which are made in one pass for all selections."""
    facts = build_facts(t, folded=True)
    cells = S.summarised(facts, digest=False, sketch=True)
    out = None
    for kind, by in _KINDS.items():
        exact = facts.groupBy(*by).agg(F.count_distinct("entity_name").alias("entities"))
        near = S.entities_in(cells, by).withColumnRenamed("entities", "_near")
        both = exact.join(near, list(by)) if by else exact.withColumn("_near", near.scalar())
        close = F.abs(F.col("_near") - F.col("entities")) <= 4 * S.SKETCH_ERROR * F.col("entities") + 1
        named = [F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in ("fy", "measure", "bucket")]
        part = both.select(F.lit(kind).alias("selection"), *named, "entities", close.alias("near"))
        out = part if out is None else out.unionByName(part)
    return out


_OP_SQL = f"""
op_facts AS (SELECT * FROM facts WHERE window_mode = 'fy' AND lower(entity_name) <> 'total'),
ops AS (
SELECT 'list_agencies' AS op, entity_name AS name, CAST(NULL AS VARCHAR) AS answer FROM op_facts WHERE NOT starts_with(entity_name, 'x') GROUP BY 2
UNION ALL SELECT 'top_contributors', entity_name, CAST(v AS VARCHAR) FROM (SELECT entity_name, round_even(sum(value), 0) AS v, sum(value) AS s FROM op_facts
  WHERE fy = '{FY_TOP}' AND measure = 'decided' AND bucket = 'total' GROUP BY 1 ORDER BY s DESC, 1 LIMIT 7)
UNION ALL SELECT 'summarize_agencies', CAST(count(*) AS VARCHAR), CAST(round_even(sum(value), 0) AS VARCHAR) FROM op_facts WHERE measure = 'refused' AND bucket = 'other'
UNION ALL SELECT 'trend', fy, CAST(round_even(sum(value) FILTER (measure = 'finalised' AND bucket = 'total'), 0) AS VARCHAR) FROM op_facts GROUP BY fy
UNION ALL SELECT 'compare_period', 'change', CAST(round_even(sum(value) FILTER (fy = '{FY_B}') - sum(value) FILTER (fy = '{FY_A}'), 0) AS VARCHAR)
  FROM op_facts WHERE measure = 'received' AND bucket = 'total'
UNION ALL SELECT 'by_portfolio', coalesce(portfolio, 'Unmapped'), CAST(round_even(sum(value), 0) AS VARCHAR) FROM op_facts
  WHERE measure = 'received' AND fy = '{FY_A}' AND bucket = 'total' GROUP BY 2
UNION ALL SELECT 'kpis', b.stat_key, coalesce(CAST(value AS VARCHAR), listed, 'null') FROM ({stat_rows(PINS, pearson_sql)}) b LEFT JOIN listed USING (stat_key)
  WHERE b.stat_key IN ({STAT_LIST})
UNION ALL SELECT 'classes', 'requests', NULL)"""


@query("dataset_ops", f"""
WITH {CATALOGUE_HASHED}, {SERIES_CTE}, figs AS ({figure_rows(PINS)}), movers AS ({MOVERS}), {LISTED}, {_OP_SQL}
SELECT op, name, answer FROM ops""")
def _(t):
    """The named ops as they are asked for by name and parameters, over facts that are stored once."""
    facts = settled(catalogue_facts(t), "facts")
    text = lambda c: F.col(c).cast("string")
    asked = {
        "list_agencies": ({}, "entity_name", F.lit(None).cast("string")),
        "top_contributors": ({"fy": FY_TOP, "measure": "decided", "bucket": "total", "top_n": 7}, "entity_name", text("value")),
        "summarize_agencies": ({"measure": "refused", "bucket": "other"}, "row_count", text("total")),
        "trend": ({"measure": "finalised"}, "fy", text("value")),
        "by_portfolio": ({"fy": FY_A, "measure": "received", "bucket": "total"}, "portfolio", text("value")),
        "kpis": ({}, "stat_key", F.coalesce(text("value"), F.col("listed"), F.lit("null"))),
        "classes": ({}, "measure_group", F.lit(None).cast("string")),
    }
    change = run_op(facts, "compare_period", {"fy_a": FY_A, "fy_b": FY_B, "measure": "received"})
    out = change.select(F.lit("compare_period").alias("op"), F.lit("change").alias("name"), text("change").alias("answer"))
    for op, (params, name, answer) in asked.items():
        out = out.unionByName(run_op(facts, op, params, PINS).select(F.lit(op).alias("op"), text(name).alias("name"), answer.alias("answer")))
    return out
