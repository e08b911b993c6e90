"""Common table expressions of the check SQL (DuckDB dialect)."""

from __future__ import annotations

from factloom.schema import MEASURES

FY = ("printf('%d-%02d', year({d}) - CASE WHEN month({d}) < 7 THEN 1 ELSE 0 END,"
      " (year({d}) + CASE WHEN month({d}) < 7 THEN 0 ELSE 1 END) % 100)")
QUARTER = "CAST(((month({d}) + 5) % 12) // 3 + 1 AS INTEGER)"


def fy(d: str) -> str:
    return FY.format(d=d)


def quarter(d: str) -> str:
    return QUARTER.format(d=d)


_CLOSED = "o_orderstatus IN ('F', 'P')"
_DECIDED = f"({_CLOSED} AND o_orderpriority <> '4-NOT SPECIFIED')"
_URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
FLAG = {
    "received": "true",
    "finalised": _CLOSED,
    "decided": _DECIDED,
    "within_statutory": f"({_DECIDED} AND date_diff('day', CAST(o_orderdate AS DATE), CAST(first_ship AS DATE)) <= 30)",
    "granted_full": f"({_DECIDED} AND o_orderstatus = 'F')",
    "granted_part": f"({_DECIDED} AND o_orderstatus = 'P' AND {_URGENT})",
    "refused": f"({_DECIDED} AND o_orderstatus = 'P' AND NOT {_URGENT})",
    "withdrawn": f"({_CLOSED} AND o_orderpriority = '4-NOT SPECIFIED')",
}

REQUESTS = f"""
shipped AS (SELECT l_orderkey, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey),
raw_requests AS (
  SELECT o.*, {fy('o_orderdate')} AS fy, {quarter('o_orderdate')} AS quarter, s.first_ship,
         CASE WHEN {_URGENT} THEN 'personal' ELSE 'other' END AS kind
  FROM orders o LEFT JOIN shipped s ON s.l_orderkey = o.o_orderkey),
requests AS (
  SELECT q.*, CAST(o_custkey AS VARCHAR) AS entity_key, c.c_name AS entity_name,
         CASE WHEN r.r_name <> 'MIDDLE EAST' THEN r.r_name END AS portfolio
  FROM raw_requests q JOIN customer c ON c.c_custkey = q.o_custkey
  JOIN nation n ON n.n_nationkey = c.c_nationkey
  JOIN region r ON r.r_regionkey = n.n_regionkey),
"""

_NAMES = ", ".join(f"'{m}'" for m in MEASURES)
_VALUES = ", ".join(f"CASE WHEN {FLAG[m]} THEN 1 ELSE 0 END" for m in MEASURES)

FACTS = REQUESTS + f"""
flags AS (
  SELECT entity_key, entity_name, portfolio, fy, quarter, kind,
         unnest([{_NAMES}]) AS measure, unnest([{_VALUES}]) AS v
  FROM requests),
bucketed AS (
  SELECT entity_key, entity_name, portfolio, fy, quarter, measure, kind AS bucket, v FROM flags
  UNION ALL
  SELECT entity_key, entity_name, portfolio, fy, quarter, measure, 'total', v FROM flags),
single_quarter AS (
  SELECT entity_key, entity_name, portfolio, fy, quarter, measure, bucket,
         CAST(sum(v) AS DOUBLE) AS value
  FROM bucketed GROUP BY ALL),
cumulative AS (
  SELECT * REPLACE (sum(value) OVER (PARTITION BY entity_key, fy, measure, bucket
                                     ORDER BY quarter) AS value)
  FROM single_quarter),
annual AS (
  SELECT entity_key, entity_name, portfolio, fy, CAST(NULL AS INTEGER) AS quarter, measure,
         bucket, sum(value) AS value
  FROM single_quarter GROUP BY ALL),
headline AS (
  SELECT '_all' AS entity_key, 'Total' AS entity_name, CAST(NULL AS VARCHAR) AS portfolio,
         fy, quarter, measure, 'total' AS bucket, CAST(sum(v) AS DOUBLE) AS value
  FROM (SELECT fy, quarter, unnest([{_NAMES}]) AS measure, unnest([{_VALUES}]) AS v
        FROM raw_requests)
  GROUP BY ALL),
facts AS (
  SELECT entity_key, entity_name, fy, quarter, 'requests' AS measure_group, measure, bucket,
         value, false AS derived, 'fy' AS window_mode, portfolio FROM annual
  UNION ALL
  SELECT entity_key, entity_name, fy, quarter, 'requests', measure, bucket,
         value, false, 'single_quarter', portfolio FROM single_quarter
  UNION ALL
  SELECT entity_key, entity_name, fy, quarter, 'requests', measure, bucket,
         value, false, 'cumulative', portfolio FROM cumulative
  UNION ALL
  SELECT entity_key, entity_name, fy, quarter, 'requests', measure, bucket,
         value, true, 'single_quarter', portfolio FROM headline)
"""


def over_facts(body: str) -> str:
    """``body`` with every fact level available as a table expression."""
    return f"WITH {FACTS}\n{body}"


def over_requests(body: str) -> str:
    return f"WITH {REQUESTS.rstrip().rstrip(',')}\n{body}"
