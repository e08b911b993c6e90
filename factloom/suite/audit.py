"""Hashes, digests, replay, quality checks, reconciliation and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from factloom.functions.checked import computed_column
from factloom.functions.hashing import SLICES, content_digest, row_hash
from factloom.functions.numbers import half_even
from factloom.functions.periods import epoch_micros, with_fiscal_period
from factloom.operators import quality as Q
from factloom.operators.sequence import placed
from factloom.plans import lineage as L
from factloom.plans import stats as S
from factloom.plans.export import export_figures, read_exported
from factloom.plans.facts import build_facts, headline_facts
from factloom.schema import FACT_COLUMNS, FACTS, HASH_COLUMNS, MEASURES
from factloom.sources.digest_tree import DigestTree
from factloom.sources.shared import fresh_path, settled
from factloom.sources.snapshots import SnapshotStore, current_snapshots, find_snapshot
from factloom.suite.catalogue import CATALOGUE_HASHED, PINS, STAT_LIST, catalogue_facts
from factloom.suite.registry import query
from factloom.suite.sql import fy, over_facts
from factloom.suite.sqlstats import (
    SERIES_CTE, digest, figure_rows, hashed_facts, line, slices, stat_rows)
from factloom.suite.stats import FY_TOP, pearson_sql

# -- hashes ------------------------------------------------------------------


@query("row_hash", over_facts(f"""
SELECT entity_key, fy, measure, bucket, sha256({line()}) AS row_hash
FROM facts WHERE window_mode = 'fy'"""))
def _(t):
    facts = build_facts(t)
    return facts.select("entity_key", "fy", "measure", "bucket",
                        row_hash(facts).alias("row_hash"))


_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
_EVENT_TEXT = {"event_id": "CAST(event_id AS VARCHAR)", "ts": "CAST(epoch_us(ts) AS VARCHAR)", "user_id": "CAST(user_id AS VARCHAR)",
               "value": "CAST(CAST(value AS DECIMAL(38,9)) AS VARCHAR)"}


@query("content_digest", f"""
SELECT event_type, count(*) AS row_count,
       {digest('count(*)', [f'sum(h{i})' for i in range(SLICES)])} AS content_digest
FROM (SELECT event_type, {slices('rh')}
      FROM (SELECT event_type, sha256({line(_EVENT_COLUMNS, _EVENT_TEXT)}) AS rh FROM events))
GROUP BY event_type""")
def _(t):
    events = t.events.withColumn("ts", epoch_micros(F.col("ts")))
    return content_digest(events, _EVENT_COLUMNS, by=["event_type"])


@query("facts_digest", f"""
WITH {hashed_facts("window_mode = 'fy'")}
SELECT fy, count(*) AS row_count,
       {digest('count(*)', [f'sum(h{i})' for i in range(SLICES)])} AS content_digest
FROM hashed GROUP BY fy""")
def _(t):
    return content_digest(build_facts(t), HASH_COLUMNS, by=["fy"])


# -- replay ------------------------------------------------------------------

_OP = """CASE event_type WHEN 'click' THEN 'decided_q1' WHEN 'view' THEN 'refused_share_q1'
  WHEN 'purchase' THEN 'timeliness_slippage_corr' WHEN 'signup' THEN 'withdrawn_q1'
  ELSE 'no_such_key' END"""


def _op_of(kind):
    return (F.when(kind == "click", "decided_q1").when(kind == "view", "refused_share_q1")
            .when(kind == "purchase", "timeliness_slippage_corr")
            .when(kind == "signup", "withdrawn_q1").otherwise("no_such_key"))


@query("replay_verify", f"""
WITH {CATALOGUE_HASHED},
fresh AS ({stat_rows(PINS, pearson_sql)}),
ops AS (SELECT event_id AS op_id, user_id AS artifact_id,
               CASE WHEN value > 60 THEN 2 ELSE 1 END AS dataset_id, {_OP} AS op,
               CASE WHEN value < 2 THEN '' WHEN value < 5 THEN 'tampered' END AS forced,
        FROM events)
SELECT op_id, artifact_id, op, status, status = 'verified' AS verified FROM (
  SELECT op_id, artifact_id, op,
         CASE WHEN forced = '' OR f.rows_hash IS NULL OR dataset_id <> 1 THEN 'unverifiable'
              WHEN forced IS NULL THEN 'verified' ELSE 'mismatch' END AS status
  FROM ops LEFT JOIN fresh f ON f.stat_key = ops.op)""")
def _(t):
    board = S.board_of(catalogue_facts(t, buckets=("total",)), PINS).select(
        F.lit(1).cast("bigint").alias("dataset_id"), "stat_key", "rows_hash")
    op = _op_of(F.col("event_type"))
    cited = t.events.select(
        F.col("event_id").alias("op_id"), F.col("user_id").alias("artifact_id"),
        F.when(F.col("value") > 60, 2).otherwise(1).cast("bigint").alias("dataset_id"),
        op.alias("op"), "value")
    true_hash = board.select(F.col("stat_key").alias("op"), F.col("rows_hash").alias("_true"))
    stored = (F.when(F.col("value") < 2, "").when(F.col("value") < 5, "tampered")
              .otherwise(F.coalesce("_true", F.lit("lost"))))
    ops = cited.join(true_hash, "op", "left").select(
        "op_id", "artifact_id", "dataset_id", "op", stored.alias("rows_hash"))
    return L.replay_verify(ops, board).select("op_id", "artifact_id", "op", "status", "verified")


# -- quality -----------------------------------------------------------------


@query("domain_check", """
SELECT unnest(['status_domain', 'priority_domain', 'price_positive', 'custkey_not_null'])
         AS rule,
       unnest([count(*) FILTER (o_orderstatus NOT IN ('F', 'O')),
               count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
               count(*) FILTER (o_totalprice <= 1000), count(*) FILTER (o_custkey IS NULL)])
         AS violations FROM orders""")
def _(t):
    return Q.domain_check(t.orders, {
        "status_domain": ~F.col("o_orderstatus").isin("F", "O"),
        "priority_domain": ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"),
        "price_positive": F.col("o_totalprice") <= 1000,
        "custkey_not_null": F.col("o_custkey").isNull(),
    })


_RULES_SQL = {
    "window_mode_domain": "window_mode NOT IN ('single_quarter', 'cumulative', 'fy')",
    "bucket_domain": "bucket NOT IN ('personal', 'other', 'total')",
    "quarter_domain": "quarter NOT BETWEEN 1 AND 4",
} | {f"{f.name}_not_null": f"{f.name} IS NULL" for f in FACTS.fields if not f.nullable}


@query("fact_rules", over_facts(f"""
, defective AS (SELECT CASE WHEN measure = 'refused' AND bucket = 'other' THEN NULL ELSE entity_key END AS entity_key,
    CASE WHEN portfolio IS NULL AND measure = 'finalised' THEN NULL ELSE entity_name END AS entity_name,
    CASE WHEN measure = 'granted_part' AND quarter = 3 THEN NULL ELSE fy END AS fy,
    CASE WHEN measure = 'received' AND quarter = 4 THEN 5 WHEN measure = 'decided' AND quarter = 1 THEN 0 ELSE quarter END AS quarter,
    measure_group, measure, CASE WHEN measure = 'withdrawn' AND bucket = 'total' THEN 'all' ELSE bucket END AS bucket,
    CASE WHEN value = 1 AND measure = 'granted_full' THEN NULL ELSE value END AS value, derived,
    CASE WHEN window_mode = 'cumulative' AND quarter = 2 THEN 'monthly' ELSE window_mode END AS window_mode FROM facts)
SELECT rule, violations FROM (SELECT unnest([{', '.join(f"'{r}'" for r in _RULES_SQL)}]) AS rule,
  unnest([{', '.join(f"count(*) FILTER ({c})" for c in _RULES_SQL.values())}]) AS violations FROM defective)"""))
def _(t):
    """Facts of all levels with defects of every kind, counted by the rules."""
    facts = build_facts(t, levels=("fy", "single_quarter", "cumulative"), headline=True)
    measure, quarter, bucket = F.col("measure"), F.col("quarter"), F.col("bucket")

    def gone(where, column):
        return F.when(F.coalesce(where, F.lit(False)), F.lit(None)).otherwise(F.col(column)).alias(column)

    bad = {
        "entity_key": gone((measure == "refused") & (bucket == "other"), "entity_key"),
        "entity_name": gone(F.col("portfolio").isNull() & (measure == "finalised"), "entity_name"),
        "fy": gone((measure == "granted_part") & (quarter == 3), "fy"),
        "quarter": F.when((measure == "received") & (quarter == 4), 5).when((measure == "decided") & (quarter == 1), 0).otherwise(quarter).alias("quarter"),
        "bucket": F.when((measure == "withdrawn") & (bucket == "total"), "all").otherwise(bucket).alias("bucket"),
        "value": gone((F.col("value") == 1) & (measure == "granted_full"), "value"),
        "window_mode": F.when((F.col("window_mode") == "cumulative") & (quarter == 2), "monthly").otherwise(F.col("window_mode")).alias("window_mode"),
    }
    return Q.domain_check(facts.select(*[bad.get(c, F.col(c)) for c in facts.columns]))


@query("duplicate_check", """
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
GROUP BY ALL HAVING count(*) > 1""")
def _(t):
    return Q.duplicate_check(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("fact_duplicates", over_facts("""
SELECT entity_key, fy, quarter, measure, bucket, 2 AS copies FROM facts
WHERE window_mode = 'fy' AND fy <> (SELECT max(fy) FROM facts)"""))
def _(t):
    """The natural key of all levels, with the annual rows of all years but the last twice."""
    facts = build_facts(t, levels=("fy", "single_quarter"), headline=True, folded=True)
    last = facts.agg(F.max("fy").alias("last"))
    again = (F.col("window_mode") == "fy") & (F.col("fy") != last.scalar())
    twice = facts.withColumn("_copy", F.explode(F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_copy")
    return Q.duplicate_check(twice, ["entity_key", "fy", "quarter", "measure", "bucket"])


_RELATIONS = (("lineitem", "l_orderkey", "orders", "o_orderkey"),
              ("orders", "o_custkey", "customer", "c_custkey"),
              ("events", "user_id", "supplier", "s_suppkey"),
              ("labels", "doc_id", "documents", "doc_id"))


@query("fk_check", "\nUNION ALL ".join(
    f"SELECT '{c}.{fk}' AS relation, {fk} AS key, count(*) AS orphan_rows FROM {c} "
    f"WHERE {fk} IS NULL OR {fk} NOT IN (SELECT {pk} FROM {p}) GROUP BY {fk}"
    for c, fk, p, pk in _RELATIONS))
def _(t):
    checks = [
        Q.fk_check(getattr(t, c), fk, getattr(t, p), pk).select(
            F.lit(f"{c}.{fk}").alias("relation"), "key", "orphan_rows")
        for c, fk, p, pk in _RELATIONS]
    return reduce(lambda a, b: a.unionByName(b), checks)


_CONTROL = "CASE WHEN measure = 'withdrawn' AND quarter = 2 THEN value + 1 ELSE value END"


@query("reconcile_totals", over_facts(f"""
, parts AS (SELECT fy, quarter, measure, sum(value) AS actual FROM facts
            WHERE window_mode = 'single_quarter' AND NOT derived AND bucket = 'total'
              AND measure <> 'refused' GROUP BY ALL),
controls AS (SELECT fy, quarter, measure, {_CONTROL} AS expected FROM facts
             WHERE derived AND NOT (measure = 'received' AND quarter = 4))
SELECT coalesce(p.fy, c.fy) AS fy, coalesce(p.quarter, c.quarter) AS quarter,
       coalesce(p.measure, c.measure) AS measure, actual, expected, actual - expected AS diff,
       CASE WHEN c.fy IS NULL THEN 'no_control' WHEN p.fy IS NULL THEN 'no_rows'
            WHEN actual = expected THEN 'match' ELSE 'mismatch' END AS status
FROM parts p FULL JOIN controls c
  ON p.fy = c.fy AND p.quarter = c.quarter AND p.measure = c.measure"""))
def _(t):
    parts = build_facts(t, [m for m in MEASURES if m != "refused"], levels=("single_quarter",),
                        buckets=("total",))
    published = headline_facts(t)
    off = (F.col("measure") == "withdrawn") & (F.col("quarter") == 2)
    controls = published.filter(
        ~((F.col("measure") == "received") & (F.col("quarter") == 4))).select(
        "fy", "quarter", "measure",
        F.when(off, F.col("value") + 1).otherwise(F.col("value")).alias("expected"))
    return Q.reconcile_totals(parts, controls, ["fy", "quarter", "measure"])


@query("cross_source", over_facts("""
, a AS (SELECT fy, sum(value) AS actual FROM facts
        WHERE window_mode = 'fy' AND bucket = 'total' AND measure = 'decided' GROUP BY fy),
b AS (SELECT fy, sum(value) AS expected FROM facts
      WHERE window_mode = 'fy' AND bucket = 'total'
        AND measure IN ('granted_full', 'granted_part', 'refused') GROUP BY fy)
SELECT fy, actual, expected, actual - expected AS diff,
       CASE WHEN actual = expected THEN 'match' ELSE 'mismatch' END AS status
FROM a JOIN b USING (fy)"""))
def _(t):
    """Decided requests against the sum of their outcomes."""
    outcomes = ["granted_full", "granted_part", "refused"]
    controls = build_facts(t, outcomes, buckets=("total",)).groupBy("fy").agg(
        F.sum("value").alias("expected"))
    return Q.reconcile_totals(build_facts(t, ["decided"], buckets=("total",)), controls, ["fy"])


@query("two_sources", over_facts(f"""
, a AS (SELECT fy, sum(value) AS actual FROM facts
        WHERE window_mode = 'fy' AND bucket = 'total' AND measure = 'received' GROUP BY fy),
b AS (SELECT {fy('o_orderdate')} AS fy, count(*)::DOUBLE AS expected FROM orders
      WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1)
SELECT coalesce(a.fy, b.fy) AS fy, actual, expected, actual - expected AS diff,
       CASE WHEN b.fy IS NULL THEN 'no_control' WHEN a.fy IS NULL THEN 'no_rows'
            WHEN actual = expected THEN 'match' ELSE 'mismatch' END AS status
FROM a FULL JOIN b ON a.fy = b.fy"""))
def _(t):
    """Received requests as the orders have them, against those that line items know of."""
    shipped = t.orders.join(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    controls = with_fiscal_period(shipped, "o_orderdate").groupBy("fy").agg(F.count(F.lit(1)).cast("double").alias("expected"))
    return Q.reconcile_totals(build_facts(t, ["received"], buckets=("total",)), controls, ["fy"])


@query("golden_gate", over_facts("""
SELECT fy, quarter, measure, value + CASE WHEN measure = 'refused' THEN 1 ELSE 0 END AS expected,
       round_even(value, 0) AS actual, measure <> 'refused' AS passed
FROM facts WHERE derived"""))
def _(t):
    """The headline against sums over the entities, which are folded on their own."""
    facts = build_facts(t, levels=("single_quarter",), headline=True, buckets=("total",))
    off = F.when(F.col("measure") == "refused", 1.0).otherwise(0.0)
    parts = build_facts(t, levels=("single_quarter",), buckets=("total",))
    expected = parts.groupBy("fy", "quarter", "measure").agg((F.sum("value") + F.max(off)).alias("expected"))
    return Q.golden_gate(facts, expected)


def _stats_of(name, where, replace=""):
    """Stat rows over facts of their own: (table expressions, rows)."""
    own = lambda s: s.replace("hashed", f"hashed_{name}").replace("chosen", f"chosen_{name}")
    ctes = hashed_facts(where).split("chosen AS", 1)[1]
    if replace:
        ctes = ctes.replace("SELECT * FROM facts", f"SELECT * REPLACE ({replace}) FROM facts", 1)
    return own("chosen AS" + ctes), own(stat_rows(PINS, pearson_sql))


_PART = f"(window_mode = 'fy' OR derived) AND fy <> '{FY_TOP}'"
_ONE, _TWO = _stats_of("one", "window_mode = 'fy' OR derived"), _stats_of("two", _PART)
_BAD = _stats_of("bad", _PART, "CASE WHEN measure = 'refused' THEN value + 1 ELSE value END AS value")


@query("replay_stored", over_facts(f""", {_ONE[0]}, {_TWO[0]}, {_BAD[0]},
recorded AS (SELECT 1 AS dataset_id, * FROM ({_ONE[1]}) UNION ALL SELECT 2, * FROM ({_TWO[1]})),
again AS (SELECT 1 AS dataset_id, * FROM ({_ONE[1]}) UNION ALL SELECT 2, * FROM ({_BAD[1]})),
ops AS (SELECT event_id AS op_id, CASE WHEN value > 60 THEN 3 WHEN value > 30 THEN 2 ELSE 1 END::BIGINT AS dataset_id,
               {_OP} AS op FROM events)
SELECT op_id, o.dataset_id, op, CASE WHEN r.rows_hash IS NULL OR a.rows_hash IS NULL THEN 'unverifiable'
    WHEN r.rows_hash = a.rows_hash THEN 'verified' ELSE 'mismatch' END AS status
FROM ops o LEFT JOIN (SELECT * FROM recorded WHERE stat_key IN ({STAT_LIST})) r ON r.dataset_id = o.dataset_id AND r.stat_key = op
LEFT JOIN again a ON a.dataset_id = o.dataset_id AND a.stat_key = op"""))
def _(t):
    """Stats recorded when two snapshots are written, computed again from what is stored: one
    snapshot is whole, one has been tampered with, one that is cited doesn't exist."""
    store = SnapshotStore(t.spark, fresh_path(t.spark, "store"))
    facts = catalogue_facts(t)
    recorded = []
    for label, rows in (("all", facts), ("some", facts.filter(F.col("fy") != FY_TOP))):
        done = store.write(rows, label, "fy", ["orders", "lineitem"], "1")
        recorded.append(S.board_of(rows, PINS).select(
            F.lit(done.dataset_id).cast("bigint").alias("dataset_id"), F.col("stat_key").alias("op"), "rows_hash"))
    ops = t.events.select(
        F.col("event_id").alias("op_id"),
        F.when(F.col("value") > 60, 3).when(F.col("value") > 30, 2).otherwise(1).cast("bigint").alias("dataset_id"),
        _op_of(F.col("event_type")).alias("op"))
    ops = ops.join(recorded[0].unionByName(recorded[1]), ["dataset_id", "op"], "left")
    stored = store.load(1, ordered=False).unionByName(store.load(2, ordered=False))
    bad = (F.col("dataset_id") == 2) & (F.col("measure") == "refused")
    stored = stored.withColumn("value", F.when(bad, F.col("value") + 1).otherwise(F.col("value")))
    again = S.stat_board(settled(S.cell_summary(stored, by=("dataset_id",)), "cells"), PINS, by=("dataset_id",))
    return L.replay_verify(ops, again).select("op_id", "dataset_id", "op", "status")


_COLUMNS = ", ".join(FACT_COLUMNS)
_TOUCHED = "measure = 'decided' AND bucket = 'total' AND fy = '1998-99' AND entity_key IN ('7', '11', '40')"


@query("digest_tree", over_facts(f"""
, whole AS (SELECT {_COLUMNS} FROM facts WHERE window_mode = 'fy'),
other AS (SELECT * REPLACE (CASE WHEN {_TOUCHED} THEN value + 1 ELSE value END AS value) FROM whole
  WHERE NOT (measure = 'refused' AND entity_key = '10'))
SELECT {_COLUMNS}, 1 AS surplus FROM (SELECT * FROM whole EXCEPT ALL SELECT * FROM other)
UNION ALL SELECT {_COLUMNS}, -1 FROM (SELECT * FROM other EXCEPT ALL SELECT * FROM whole)"""))
def _(t):
    """A stored table against one in which some values were changed and some rows are missing."""
    facts = build_facts(t, folded=True)
    touched = F.expr(_TOUCHED)
    changed = facts.filter(~((F.col("measure") == "refused") & (F.col("entity_key") == "10"))).withColumn(
        "value", F.when(touched, F.col("value") + 1).otherwise(F.col("value")))
    trees = [DigestTree.build(rows, fresh_path(t.spark, "tree"), 2) for rows in (facts, changed)]
    return trees[0].differences(trees[1])


@query("row_diff", """
SELECT custkey, sum(n) AS surplus FROM (
  SELECT o_custkey AS custkey, 1 AS n FROM orders
  UNION ALL SELECT c_custkey, -1 FROM customer) GROUP BY custkey HAVING sum(n) <> 0""")
def _(t):
    return Q.row_diff(t.orders.select(F.col("o_custkey").alias("custkey")),
                      t.customer.select(F.col("c_custkey").alias("custkey")))


# -- computed columns and rounding -------------------------------------------


@query("computed_column", """
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_discount <> 0 AND l_quantity <> 1 THEN round_even(
         pow(l_extendedprice * (1 - l_discount), 0.5) / l_discount + l_quantity
         - (-l_tax) / (l_quantity - 1), 2) END AS value,
       CASE WHEN l_discount = 0 OR l_quantity = 1 THEN 'division by zero' END AS error
FROM lineitem""")
def _(t):
    def formula(x):
        net = x["l_extendedprice"] * (1 - x["l_discount"])
        return net ** 0.5 / x["l_discount"] + x["l_quantity"] - (-x["l_tax"]) / (x["l_quantity"] - 1)

    return computed_column(t.lineitem, formula).select(
        "l_orderkey", "l_linenumber", "l_partkey", "value", "error")


@query("half_even", """
SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_quantity / 2, 0) AS whole,
       round_even(l_quantity / 4, 1) AS tenth FROM lineitem""")
def _(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             half_even(q / 2).alias("whole"), half_even(q / 4, 1).alias("tenth"))


# -- snapshots and bundles ---------------------------------------------------


@query("write_snapshot", f"""
WITH {hashed_facts("window_mode = 'fy' OR derived")},
d AS (SELECT count(*) AS n, {digest('count(*)', [f'sum(h{i})' for i in range(SLICES)])} AS content_digest
      FROM hashed)
SELECT unnest([1, 2, 3]) AS attempt, unnest([1, 1, 2]::BIGINT[]) AS dataset_id,
       unnest([n, 0, (SELECT count(*) FROM hashed WHERE derived)]) AS inserted,
       unnest([content_digest, content_digest,
               (SELECT {digest('count(*)', [f'sum(h{i})' for i in range(SLICES)])}
                FROM hashed WHERE derived)]) AS content_digest FROM d""")
def _(t):
    """The same facts twice (the second adds nothing), then other facts."""
    store = SnapshotStore(t.spark, fresh_path(t.spark, "store"))
    facts = catalogue_facts(t)
    done = []
    for rows in (facts, facts, headline_facts(t)):
        done.append(store.write(rows, "all years", "fy", ["orders", "lineitem"], "1"))
    attempts = F.array(*[
        F.struct(F.lit(i + 1).alias("attempt"), F.lit(w.dataset_id).cast("bigint").alias("dataset_id"),
                 F.lit(w.inserted).cast("bigint").alias("inserted"),
                 F.lit(w.content_digest).alias("content_digest")) for i, w in enumerate(done)])
    return t.spark.range(1).select(F.inline(attempts))


_HEADERS = """headers AS (
  SELECT o_orderkey AS dataset_id, o_orderpriority AS period_label,
         CAST(o_custkey AS VARCHAR) AS content_digest, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'P' THEN o_orderkey + 1 END AS superseded_by FROM orders)"""


def _headers(t):
    """One snapshot header per order: its customer stands for the digest."""
    return t.orders.select(
        F.col("o_orderkey").alias("dataset_id"), F.col("o_orderpriority").alias("period_label"),
        F.col("o_custkey").cast("string").alias("content_digest"),
        F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderkey") + 1).alias("superseded_by"))


@query("find_snapshot", f"""WITH {_HEADERS}
SELECT max(dataset_id) AS dataset_id FROM headers
WHERE content_digest = '7' AND superseded_by IS NULL""")
def _(t):
    return find_snapshot(_headers(t), "7")


@query("current_snapshots", f"""WITH {_HEADERS}
SELECT * FROM headers QUALIFY row_number() OVER (
  PARTITION BY period_label ORDER BY created_at DESC, dataset_id DESC) = 1""")
def _(t):
    return current_snapshots(_headers(t))


@query("load_snapshot", over_facts(f"""
SELECT CAST(1 AS BIGINT) AS dataset_id, {_COLUMNS}, row_number() OVER (
  ORDER BY entity_key, fy NULLS FIRST, quarter NULLS FIRST, measure_group, measure, bucket, window_mode,
           entity_name NULLS FIRST, value, derived, portfolio NULLS FIRST) AS place
FROM facts WHERE window_mode = 'fy'"""))
def _(t):
    """All facts of a snapshot as they are reloaded: in the order of their key, numbered as they come."""
    store = SnapshotStore(t.spark, fresh_path(t.spark, "store"))
    done = store.write(build_facts(t, folded=True), "annual", "fy", ["orders"], "1")
    assert store.find(done.content_digest) == done.dataset_id
    return placed(store.load(done.dataset_id).select("dataset_id", *FACT_COLUMNS))


@query("reload_snapshot", over_facts(f"""
SELECT {_COLUMNS}, row_number() OVER (ORDER BY entity_key, fy, quarter NULLS FIRST, measure_group, measure, bucket) AS place
FROM facts WHERE window_mode = 'fy' AND measure = 'received'"""))
def _(t):
    """Stored facts in reload order: their places are numbered as they come."""
    store = SnapshotStore(t.spark, fresh_path(t.spark, "store"))
    done = store.write(build_facts(t, ["received"], folded=True), "annual", "fy", ["orders"], "1")
    return placed(store.load(done.dataset_id).select(*FACT_COLUMNS))


@query("export_figures", over_facts(f""", {SERIES_CTE},
figs AS ({figure_rows(PINS)}),
pages AS (SELECT unnest([{', '.join(f"'{p}'" for p, ks in S.PAGE_FIGURES.items() for _ in ks)}])
                 AS page,
                 unnest([{', '.join(f"'{k}'" for ks in S.PAGE_FIGURES.values() for k in ks)}])
                 AS figure_key),
chosen AS (SELECT * FROM facts WHERE window_mode = 'fy' AND bucket = 'total')
SELECT 'figure' AS part, page, figure_key, series, category, value,
       CASE WHEN value IS NOT NULL THEN coalesce(
         100e0 * value / nullif(max(value) OVER (PARTITION BY page, figure_key), 0), 0) END AS height,
       coalesce(regexp_replace(format('{{:,.2f}}', value), '\\.?0+$', ''), 'no data') AS label
FROM figs JOIN pages USING (figure_key)
UNION ALL SELECT 'fact', entity_key, fy, measure, entity_name, value, NULL, portfolio FROM chosen
UNION ALL SELECT DISTINCT 'filter', 'entity', entity_name, NULL, NULL, NULL, NULL, NULL FROM chosen
UNION ALL SELECT DISTINCT 'filter', 'bucket', bucket, NULL, NULL, NULL, NULL, NULL FROM chosen
UNION ALL SELECT DISTINCT 'filter', 'fy', fy, NULL, NULL, NULL, NULL, NULL FROM chosen"""))
def _(t):
    """Figures, facts and filter options as they are read back from the bundle."""
    from factloom.operators.filters import filter_options

    facts = build_facts(t, buckets=("total",), folded=True)
    table = S.figures(facts, S.summarised(facts, digest=False), PINS)
    path = fresh_path(t.spark, "bundle")
    export_figures(table, facts, filter_options(facts), path)
    read = read_exported(t.spark, path)
    figures = read["figures"].select(F.lit("figure").alias("part"), "page", "figure_key", "series", "category", "value", "height", "label")
    nothing, none = F.lit(None).cast("string"), F.lit(None).cast("double")
    rows = read["facts"].select(F.lit("fact"), "entity_key", "fy", "measure", "entity_name", "value", none, "portfolio")
    options = read["filters"].select(F.lit("filter"), "dimension", "option", nothing, nothing, none, none, nothing)
    return figures.union(rows).union(options)
