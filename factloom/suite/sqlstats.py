"""Check SQL of the catalogue: cells, digests, stats and figures (DuckDB dialect)."""

from __future__ import annotations

from factloom.functions.hashing import SLICES
from factloom.schema import HASH_COLUMNS, MEASURES
from factloom.suite.sql import FACTS

TEXT = {
    "value": "CAST(CAST(value AS DECIMAL(38,9)) AS VARCHAR)",
    "derived": "CASE WHEN derived THEN 'true' ELSE 'false' END",
    "quarter": "CAST(quarter AS VARCHAR)",
}


def line(columns=HASH_COLUMNS, text=TEXT):
    """Canonical line of a row, as the engine encodes it."""
    fields = []
    for c in columns:
        t = text.get(c, c)
        fields.append(f"coalesce(length({t}) || ':' || {t}, '-')")
    return " || ".join(fields)


def slices(hashed):
    return ", ".join(
        f"CAST('0x' || substr({hashed}, {1 + i * 15}, 15) AS BIGINT) AS h{i}" for i in range(SLICES))


def digest(count, sums):
    parts = " || ':' || ".join(
        [f"CAST({count} AS VARCHAR)"]
        + [f"CAST(CAST(coalesce({s}, 0) AS HUGEINT) AS VARCHAR)" for s in sums])
    return f"sha256({parts})"


def digest_where(condition):
    count = f"count(*) FILTER ({condition})"
    return count, digest(count, [f"sum(h{i}) FILTER ({condition})" for i in range(SLICES)])


def hashed_facts(where="true", cte="hashed"):
    """``FACTS`` plus a table expression of the chosen rows with their slices."""
    return FACTS + f""",
chosen AS (SELECT * FROM facts WHERE {where}),
{cte} AS (SELECT *, {slices('rh')} FROM (SELECT *, sha256({line()}) AS rh FROM chosen))
"""


def _pct(part, whole, places):
    return f"round_even(100e0 * {part} / nullif({whole}, 0), {places})"


def stat_rows(pins, pearson):
    """(stat_key, value, basis, source_rows, rows_hash) over ``hashed``."""
    from factloom.plans.stats import (
        CORRELATED, CORRELATION_STAT, FIGURE_KEYS, HEADLINE_STATS, MOVERS_STAT)

    pinned = (f"window_mode = 'single_quarter' AND derived AND bucket = 'total' "
              f"AND fy = '{pins.headline_fy}' AND quarter = {pins.headline_quarter}")

    def amount(m):
        return (f"round_even(coalesce(sum(value) FILTER ({pinned} AND measure = '{m}'), 0), 0)")

    rows = []
    for key, measures in HEADLINE_STATS.items():
        names = ", ".join(f"'{m}'" for m in measures)
        value = amount(measures[0])
        if len(measures) == 2:
            value = _pct(value, amount(measures[1]), 0)
        rows.append((key, value, "single_quarter", f"{pinned} AND measure IN ({names})"))
    a, b = pins.mover_fys
    rows.append((MOVERS_STAT, "CAST(NULL AS DOUBLE)", "fy",
                 f"window_mode = 'fy' AND bucket = 'total' AND fy IN ('{a}', '{b}')"))
    x, y = CORRELATED
    series = (f"(SELECT {pearson(x, y)} FROM (SELECT fy, "
              + ", ".join(f"round_even(sum(value) FILTER (measure = '{m}' AND bucket = 'total'), 0)"
                          f" AS {m}" for m in CORRELATED)
              + " FROM chosen WHERE window_mode = 'fy' GROUP BY fy))")
    rows.append((CORRELATION_STAT, series, "fy",
                 f"window_mode = 'fy' AND bucket = 'total' AND measure IN ('{x}', '{y}')"))
    rows += [(key, "CAST(NULL AS DOUBLE)", "fy", "true") for key in FIGURE_KEYS]
    parts = []
    for key, value, basis, where in rows:
        count, hashed = digest_where(where)
        parts.append(f"SELECT '{key}' AS stat_key, {value} AS value, '{basis}' AS basis, "
                     f"{count} AS source_rows, {hashed} AS rows_hash FROM hashed")
    return "\nUNION ALL ".join(parts)


SERIES_CTE = "series AS (SELECT fy, " + ", ".join(
    f"round_even(sum(value) FILTER (measure = '{m}' AND bucket = 'total'), 0) AS {m}"
    for m in MEASURES) + " FROM facts WHERE window_mode = 'fy' GROUP BY fy)"


def figure_rows(pins):
    """(figure_key, series, category, value) over ``facts`` and ``series``."""
    from factloom.plans.stats import RATIO_FIGURES, TOP_FIGURES, TREND_FIGURES

    parts = []
    for key, named in TREND_FIGURES.items():
        parts += [f"SELECT '{key}' AS figure_key, '{s}' AS series, fy AS category, {m} AS value "
                  f"FROM series" for s, m in named.items()]
    for key, (name, cols, whole) in RATIO_FIGURES.items():
        parts.append(f"SELECT '{key}', '{name}', fy, {_pct('(' + ' + '.join(cols) + ')', whole, 1)} "
                     f"FROM series")
    for key, m in TOP_FIGURES.items():
        parts.append(
            f"SELECT '{key}', '{m}', entity_name, v FROM (SELECT entity_name, "
            f"round_even(sum(value), 0) AS v FROM facts WHERE window_mode = 'fy' "
            f"AND fy = '{pins.top_fy}' AND measure = '{m}' AND bucket = 'total' "
            f"GROUP BY entity_name ORDER BY sum(value) DESC, entity_name LIMIT 20)")
    return "\nUNION ALL ".join(parts)
