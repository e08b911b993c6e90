"""Ledger queries: transcripts, artifacts, citations, specs, screening, streams.

The ledger is derived from the events (one call per event, one build per user)
and the conversations (one artifact per conversation, one spec text per turn).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from factloom import schema as SCHEMA
from factloom.operators import citations as C
from factloom.operators import quality as Q
from factloom.operators import specs as SP
from factloom.operators.screen import SCOPE_RULES, SCOPE_TERMS, Rule, scope_screen
from factloom.operators.sequence import latest_by_key, numbered
from factloom.plans import lineage as L
from factloom.plans import stats as S
from factloom.schema import CHART_TYPES
from factloom.sources.checked import CheckedTables, Parent
from factloom.sources.ledger import append_rows, ledger_append, ledger_read, read_rows
from factloom.sources.shared import fresh_path, settled
from factloom.suite.catalogue import CATALOGUE_HASHED, LISTED, PINS, STAT_LIST, catalogue_facts
from factloom.suite.registry import query
from factloom.suite.sqlstats import SERIES_CTE, figure_rows, stat_rows
from factloom.suite.stats import MOVERS, pearson_sql

# -- the derived ledger ------------------------------------------------------


def ledger_events(t):
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k")
    cents = F.bround(F.col("value") * 100, 0).cast("bigint").cast("string")
    result = F.concat(
        F.lit('{"total":'), cents, F.lit(',"kind":"'), kind,
        F.lit('","top":[{"agency":"A'), k, F.lit('","value":'), k,
        F.lit('.0}],"even":'), (F.col("event_id") % 2 == 0).cast("string"), F.lit(',"none":null}'))
    return t.events.select(
        "event_id", "ts", F.col("user_id").alias("artifact_id"),
        F.when(kind == "signup", "request_received").otherwise("tool_call").alias("event"),
        F.when(kind == "error", "compute").otherwise("query_dataset").alias("tool"),
        kind.alias("op"), F.col("props").alias("args"), result.alias("result"))


_K = "(props->>'k')"
_LEDGER = f"""ledger AS (
  SELECT event_id, ts, user_id AS artifact_id,
         CASE WHEN event_type = 'signup' THEN 'request_received' ELSE 'tool_call' END AS event,
         CASE WHEN event_type = 'error' THEN 'compute' ELSE 'query_dataset' END AS tool,
         event_type AS op, props AS args,
         '{{"total":' || CAST(CAST(round_even(value * 100, 0) AS BIGINT) AS VARCHAR)
           || ',"kind":"' || event_type || '","top":[{{"agency":"A' || {_K}
           || '","value":' || {_K} || '.0}}],"even":' || CAST(event_id % 2 = 0 AS VARCHAR) || ',"none":null}}' AS result
  FROM events),
calls AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY artifact_id ORDER BY ts, event_id) AS INTEGER)
            AS seq
  FROM ledger WHERE event = 'tool_call')"""


def artifacts(t):
    """Two versions per conversation: its opening and its last turn."""
    return t.conversations.select(
        F.col("conv_id").alias("artifact_id"), F.col("turn").cast("int").alias("version"),
        F.lit("dashboard").alias("artifact_type"), F.col("role").alias("artifact_key"),
        F.when(F.col("turn") > 0, F.col("conv_id") % 9).alias("user_id"),
        F.when(F.col("role") == "assistant", 1).when(F.col("role") == "user", 2).otherwise(4)
        .cast("bigint").alias("dataset_id"), F.col("text").alias("request_text"),
        F.concat(F.lit('{"title":"'), F.col("role"), F.lit('"}')).alias("spec_json"),
        F.when(F.col("role") != "user", "m1").alias("model"),
        F.when(F.col("turn") == 0, "building").otherwise("done").alias("status"))


_ARTIFACTS = """artifacts AS (
  SELECT conv_id AS artifact_id, CAST(turn AS INTEGER) AS version, 'dashboard' AS artifact_type,
         role AS artifact_key, CASE WHEN turn > 0 THEN conv_id % 9 END AS user_id, CAST(CASE role WHEN 'assistant' THEN 1 WHEN 'user' THEN 2 ELSE 4 END
           AS BIGINT) AS dataset_id, text AS request_text,
         '{"title":"' || role || '"}' AS spec_json, CASE WHEN role <> 'user' THEN 'm1' END AS model,
         CASE WHEN turn = 0 THEN 'building' ELSE 'done' END AS status
  FROM conversations),
latest AS (SELECT * FROM artifacts
           QUALIFY row_number() OVER (PARTITION BY artifact_id ORDER BY version DESC) = 1)"""


@query("ledger_roundtrip", f"WITH {_LEDGER} SELECT * FROM ledger")
def _(t):
    """Events appended as JSON lines and read back."""
    path = fresh_path(t.spark, "ledger")
    ledger_append(ledger_events(t), path)
    return ledger_read(t.spark, path).drop("corrupt_line")


@query("transcript_table", f"""WITH {_LEDGER}
SELECT artifact_id, seq, tool, op, args AS input_json, result AS output_json FROM calls""")
def _(t):
    return L.transcript_table(ledger_events(t))


@query("assign_seq", """
SELECT conv_id, turn, role,
       row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS seq FROM conversations""")
def _(t):
    slices = F.floor(F.col("turn") / 4)
    return numbered(t.conversations, ["conv_id", "role"], ["turn"], slices).select(
        "conv_id", "turn", "role", "seq")


@query("latest_by_key", """
SELECT event_id, ts, user_id, event_type, value, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def _(t):
    return latest_by_key(t.events, ["user_id"], ["ts", "event_id"])


@query("update_artifact", f"""WITH {_ARTIFACTS}
SELECT artifact_id, version + 1 AS version, artifact_type, artifact_key, l.user_id, dataset_id, request_text,
       coalesce(n.spec, spec_json) AS spec_json, model, coalesce(n.status, l.status) AS status
FROM latest l JOIN (
  SELECT user_id, CASE WHEN sum(value) > 1500 THEN '{{}}' END AS spec,
         CASE WHEN count(*) > 60 THEN 'reviewed' END AS status FROM events GROUP BY user_id) n
  ON n.user_id = l.artifact_id WHERE n.spec IS NOT NULL OR n.status IS NOT NULL""")
def _(t):
    changes = t.events.groupBy(F.col("user_id").alias("artifact_id")).agg(
        F.when(F.sum("value") > 1500, "{}").alias("spec_json"),
        F.when(F.count(F.lit(1)) > 60, "reviewed").alias("status"))
    return L.update_artifact(artifacts(t), changes)


# -- reports -----------------------------------------------------------------

_SNAPSHOT = """SELECT CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT)
    AS dataset_id, o_orderstatus AS period_label, 'fy' AS window_mode, 'orders,' || o_orderstatus AS source_files,
  '1' AS normaliser_ver, sha256(o_orderstatus) AS content_digest,
  count(*) AS fact_count FROM orders GROUP BY o_orderstatus"""


def _snapshots(t):
    """One snapshot header per order status."""
    status = F.col("o_orderstatus")
    return t.orders.groupBy(status).agg(F.count(F.lit(1)).alias("fact_count")).select(
        F.when(status == "F", 1).when(status == "O", 2).otherwise(3).cast("bigint")
        .alias("dataset_id"), status.alias("period_label"), F.lit("fy").alias("window_mode"),
        F.array(F.lit("orders"), status).alias("source_files"), F.lit("1").alias("normaliser_ver"),
        F.sha2(status, 256).alias("content_digest"), "fact_count")


@query("lineage_report", f"""WITH {_LEDGER}, {_ARTIFACTS}, snapshots AS ({_SNAPSHOT}),
children AS (
  SELECT artifact_id AS parent, 'op' AS child, event_id AS ord, 'figure' AS name, op, args AS input,
         args AS payload, event_id % 5 AS row_count, sha256(args) AS rows_hash FROM ledger WHERE event <> 'tool_call'
  UNION ALL SELECT artifact_id, 'tool_call', seq, tool, op, args, result, NULL, NULL FROM calls)
SELECT artifact_id, artifact_type, artifact_key, user_id, dataset_id, request_text, spec_json, model, status,
       period_label, window_mode, source_files, normaliser_ver, content_digest, fact_count,
       child, ord, name, op, input, payload, row_count, rows_hash
FROM latest LEFT JOIN snapshots USING (dataset_id) LEFT JOIN children ON parent = artifact_id""")
def _(t):
    events = settled(ledger_events(t), "ledger")
    latest = latest_by_key(artifacts(t), ["artifact_id"], ["version"])
    report = L.lineage_report(latest, _snapshots(t), _ops(events), L.transcript_table(events))
    return report.withColumn("source_files", F.array_join("source_files", ","))


def _ops(events):
    return events.filter(F.col("event") != "tool_call").select(
        F.col("event_id").alias("op_id"), "artifact_id", F.lit(1).cast("bigint").alias("dataset_id"),
        F.lit("figure").alias("kind"), "op", F.col("args").alias("params"),
        (F.col("event_id") % 5).alias("row_count"), F.sha2("args", 256).alias("rows_hash"),
        F.col("args").alias("result_value"))


_RECORDED = {
    "artifacts": ("artifact_id", "version", "artifact_type", "artifact_key", "user_id", "dataset_id", "request_text", "spec_json", "model", "status"),
    "ops": ("op_id", "artifact_id", "dataset_id", "kind", "op", "params", "row_count", "rows_hash", "result_value"),
    "tool_calls": ("artifact_id", "seq", "tool", "op", "input_json", "output_json"),
}


def _line(columns):
    return " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in columns)


@query("record_ledger", f"""WITH {_LEDGER}, {_ARTIFACTS}, ops AS (
  SELECT event_id AS op_id, artifact_id, 1 AS dataset_id, 'figure' AS kind, op, args AS params, event_id % 5 AS row_count,
         sha256(args) AS rows_hash, args AS result_value FROM ledger WHERE event <> 'tool_call'),
tool_calls AS (SELECT artifact_id, seq, tool, op, args AS input_json, result AS output_json FROM calls)
""" + "\nUNION ALL ".join(f"""SELECT '{n}' AS recorded, {_line(c)} AS line, artifact_id IN (SELECT artifact_id FROM artifacts) AS has_parent
FROM {n}""" for n, c in _RECORDED.items()))
def _(t):
    """The three ledger tables appended in two parts and read back, whole rows, with whether their artifact is there."""
    root, events = fresh_path(t.spark, "tables"), settled(ledger_events(t), "ledger")
    tables = {"artifacts": (artifacts(t).withColumn("created_at", F.current_timestamp()), SCHEMA.ARTIFACTS),
              "ops": (_ops(events), SCHEMA.OPS), "tool_calls": (L.transcript_table(events), SCHEMA.TOOL_CALLS)}
    for name, (rows, schema) in tables.items():
        for part in (F.col("artifact_id") % 2 == 0, F.col("artifact_id") % 2 != 0):
            append_rows(rows.filter(part), f"{root}/{name}", schema)
    read = {name: read_rows(t.spark, f"{root}/{name}", schema) for name, (_, schema) in tables.items()}
    known = read["artifacts"].select(F.col("artifact_id").alias("_known")).distinct()

    def listed(name):
        rows = read[name].join(known, F.col("artifact_id") == F.col("_known"), "left")
        cells = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _RECORDED[name]]
        return rows.select(F.lit(name).alias("recorded"), F.concat_ws("|", *cells).alias("line"), F.col("_known").isNotNull().alias("has_parent"))

    return reduce(lambda a, b: a.unionByName(b), map(listed, read))


@query("checked_append", f"""WITH {_LEDGER}, {_ARTIFACTS}
SELECT artifact_id, seq, tool, op, args AS input_json, result AS output_json,
       CAST(EXISTS (SELECT 1 FROM calls WHERE artifact_id NOT IN (SELECT artifact_id FROM artifacts)) AS INTEGER) AS refused
FROM calls WHERE artifact_id IN (SELECT artifact_id FROM artifacts)""")
def _(t):
    """Calls appended in two batches: those whose artifact is there, then all others, which are refused whole."""
    tables = CheckedTables(t.spark, fresh_path(t.spark, "checked"), 8)
    tables.declare("artifacts", SCHEMA.ARTIFACTS, "artifact_id")
    tables.declare("tool_calls", SCHEMA.TOOL_CALLS, "artifact_id")
    tables.append("artifacts", latest_by_key(artifacts(t), ["artifact_id"], ["version"]).withColumn("created_at", F.current_timestamp()))
    calls = settled(L.transcript_table(ledger_events(t)), "transcript")
    known = tables.read("artifacts").select("artifact_id")
    parents, refused = {"artifact_id": Parent("artifacts", "artifact_id")}, 0
    for how in ("left_semi", "left_anti"):
        try:
            tables.append("tool_calls", calls.join(known, "artifact_id", how), parents)
        except Q.GateError:
            refused += 1
    return tables.read("tool_calls").select("artifact_id", "seq", "tool", "op", "input_json", "output_json", F.lit(refused).alias("refused"))


@query("load_dashboard", f"""WITH {_LEDGER}, {_ARTIFACTS}
SELECT l.artifact_id, spec_json, dataset_id, seq, tool, result
FROM latest l LEFT JOIN calls c ON c.artifact_id = l.artifact_id""")
def _(t):
    calls = settled(L.transcript_table(settled(ledger_events(t), "ledger")), "transcript")
    return L.load_dashboard(artifacts(t), calls)


# -- citations ---------------------------------------------------------------


def cited_texts(t):
    """A spec text per conversation turn, citing calls of the build of that number."""
    turn = F.col("turn").cast("string")
    nxt = (F.col("turn") + 2).cast("string")
    text = F.concat(
        F.lit("Turn "), turn, F.lit(": {c:0."), nxt, F.lit(".0.total} by {c:0."), nxt,
        F.lit(".1.top[0].agency} with {c:0."), nxt, F.lit(".0.top[0].value} {c:0."), nxt,
        F.lit(".0.even} {c:0."), nxt, F.lit(".0.none} ("), F.col("role"), F.lit(") {c:0."),
        (F.col("turn") * 20).cast("string"), F.lit(".0.kind}"),
        F.when(F.col("role") == "system", "{c:0.x.0.total}{c:1.2}").otherwise(
            F.lit(" {c:7.1.0.top[3].agency}")))
    return t.conversations.select("conv_id", "turn", F.col("conv_id").alias("artifact_id"),
                                  text.alias("text"))


_TEXTS = """texts AS (
  SELECT conv_id, turn, conv_id AS artifact_id,
         'Turn ' || turn || ': {c:0.' || (turn + 2) || '.0.total} by {c:0.' || (turn + 2)
         || '.1.top[0].agency} with {c:0.' || (turn + 2) || '.0.top[0].value} {c:0.' || (turn + 2)
         || '.0.even} {c:0.' || (turn + 2) || '.0.none} (' || role || ') {c:0.' || (turn * 20) || '.0.kind}'
         || CASE WHEN role = 'system' THEN '{c:0.x.0.total}{c:1.2}'
                 ELSE ' {c:7.1.0.top[3].agency}' END AS text
  FROM conversations),
found AS (
  SELECT conv_id, turn, artifact_id, unnest(range(len(ps))) AS pos, unnest(ps) AS pointer
  FROM (SELECT *, regexp_extract_all(text, '\\{c:([\\w.\\[\\]]+)\\}', 1) AS ps FROM texts)),
pointed AS (
  SELECT *, string_split(pointer, '.') AS parts FROM found),
resolved AS (
  SELECT p.conv_id, p.turn, p.artifact_id, p.pos, p.pointer,
         CASE json_type(c.result, '$.' || array_to_string(parts[4:], '.'))
           WHEN 'NULL' THEN 'None'
           WHEN 'BOOLEAN' THEN CASE WHEN json_extract_string(c.result, '$.' || array_to_string(parts[4:], '.')) = 'true'
                               THEN 'True' ELSE 'False' END
           ELSE json_extract_string(c.result, '$.' || array_to_string(parts[4:], '.')) END AS value,
         CASE WHEN len(parts) < 4 THEN 'too_short'
              WHEN NOT regexp_full_match(parts[2], '\\d+') THEN 'bad_turn'
              WHEN c.seq IS NULL THEN 'no_call'
              WHEN json_type(c.result, '$.' || array_to_string(parts[4:], '.')) IS NULL
              THEN 'no_field' ELSE 'resolved' END AS status
  FROM pointed p LEFT JOIN calls c ON c.tool = 'query_dataset' AND c.artifact_id = p.artifact_id
       AND len(parts) >= 4 AND c.seq = try_cast(parts[2] AS INTEGER))"""


def _transcript(t):
    return L.transcript_table(ledger_events(t)).withColumnRenamed("output_json", "result")


@query("resolve_pointers", f"""WITH {_LEDGER}, {_TEXTS}
SELECT conv_id, turn, pos, pointer, value, status FROM resolved""")
def _(t):
    pointers = C.find_pointers(cited_texts(t))
    return C.resolve_pointers(pointers, _transcript(t)).drop("artifact_id")


@query("resolve_citations", f"""WITH {_LEDGER}, {_TEXTS},
pieces AS (
  SELECT conv_id, turn, string_agg(lit || coalesce(
           CASE WHEN status = 'resolved' THEN value WHEN status IS NOT NULL
                THEN '{{c:' || pointer || '}}' END, ''), '' ORDER BY pos) AS resolved_text,
         count(*) FILTER (status <> 'resolved') AS unresolved
  FROM (SELECT conv_id, turn, unnest(ls) AS lit, unnest(range(len(ls))) AS pos
        FROM (SELECT *, regexp_split_to_array(text, '\\{{c:[\\w.\\[\\]]+\\}}') AS ls FROM texts))
  LEFT JOIN resolved USING (conv_id, turn, pos) GROUP BY conv_id, turn)
SELECT conv_id, turn, resolved_text, unresolved FROM pieces""")
def _(t):
    return C.resolve_citations(cited_texts(t), _transcript(t), ids=["conv_id", "turn"]).select(
        "conv_id", "turn", "resolved_text", "unresolved")


# -- specs -------------------------------------------------------------------

_STAT = """CASE event_type WHEN 'click' THEN '"decided_q1"' WHEN 'view' THEN '"12345"'
  WHEN 'purchase' THEN '"{c:0.1.0.total}"' WHEN 'signup' THEN '""' ELSE 'null' END"""
_FIGURE = """CASE WHEN value > 40 THEN '"bar"' WHEN value > 20 THEN '"received_top20"'
  WHEN value > 10 THEN '"sales"' ELSE 'null' END"""


def specs(t):
    kind, value = F.col("event_type"), F.col("value")
    stat = (F.when(kind == "click", '"decided_q1"').when(kind == "view", '"12345"')
            .when(kind == "purchase", '"{c:0.1.0.total}"').when(kind == "signup", '""')
            .otherwise("null"))
    figure = (F.when(value > 40, '"bar"').when(value > 20, '"received_top20"')
              .when(value > 10, '"sales"').otherwise("null"))
    return t.events.select("event_id", F.concat(
        F.lit('{"title":"t","panels":[{"stat":'), stat, F.lit(',"figure":'), figure,
        F.lit('},{"title":"k","stat":null,"figure":"timeliness_trend"}]}')).alias("spec_json"))


_PANELS = f"""panels AS (
  SELECT event_id, 0 AS pos, json_extract_string(s, '$') AS stat, json_extract_string(f, '$') AS figure
  FROM (SELECT event_id, {_STAT} AS s, {_FIGURE} AS f FROM events)
  UNION ALL SELECT event_id, 1, NULL, 'timeliness_trend' FROM events)"""
_KEYS = ", ".join(f"'{k}'" for k in (*S.STAT_KEYS, *S.FIGURE_KEYS))
_FIGURE_OK = ", ".join(f"'{k}'" for k in (*S.FIGURE_KEYS, *CHART_TYPES))
_POINTER = "'^\\{c:[\\w.\\[\\]]+\\}$'"


@query("audit_panels", f"""WITH {_PANELS}
SELECT event_id, pos, 'stat' AS field, stat AS named FROM panels
WHERE stat IS NOT NULL AND stat NOT IN ({STAT_LIST}) AND NOT regexp_matches(stat, {_POINTER})
UNION ALL SELECT event_id, pos, 'figure', figure FROM panels
WHERE figure IS NOT NULL AND figure NOT IN ({_FIGURE_OK})
  AND NOT regexp_matches(figure, {_POINTER})""")
def _(t):
    return SP.audit_panels(SP.panels(specs(t)), S.STAT_KEYS, S.FIGURE_KEYS)


@query("panel_key", f"""WITH {_PANELS}
SELECT event_id, pos, CASE WHEN coalesce(nullif(stat, ''), figure) IN ({_KEYS})
                           THEN coalesce(nullif(stat, ''), figure) END AS key FROM panels""")
def _(t):
    return SP.panels(specs(t)).select(
        "event_id", "pos", SP.panel_key(S.STAT_KEYS, S.FIGURE_KEYS).alias("key"))


@query("record_stat_ops", f"""
WITH {CATALOGUE_HASHED}, {SERIES_CTE}, figs AS ({figure_rows(PINS)}), movers AS ({MOVERS}), {LISTED},
{_PANELS}, board AS ({stat_rows(PINS, pearson_sql)}),
cited AS (SELECT event_id AS artifact_id, pos, coalesce(nullif(stat, ''), figure) AS op FROM panels)
SELECT artifact_id, CAST(1 AS BIGINT) AS dataset_id, pos, 'figure' AS kind, op, '{{}}' AS params,
       source_rows AS row_count, rows_hash, coalesce(CAST(value AS VARCHAR), listed, 'null') AS result_value
FROM cited JOIN board ON board.stat_key = op LEFT JOIN listed ON listed.stat_key = op""")
def _(t):
    facts = catalogue_facts(t)
    cells = S.summarised(facts)
    board = S.stat_board(cells, PINS).unionByName(S.headline_stats(cells, PINS, keys=S.FIGURE_KEYS))
    rows = SP.panels(specs(t)).withColumnRenamed("event_id", "artifact_id")
    return L.record_stat_ops(rows, board, listed=S.listed_values(facts, cells, PINS))


# -- screening ---------------------------------------------------------------


def _portable(rule):
    """The pattern with Unicode word boundaries spelt out (RE2 has ASCII ones)."""
    out, p, i = [], rule.pattern, 0
    while i < len(p):
        if p.startswith(r"\b", i):
            opens = i + 2 < len(p) and (p[i + 2].isalnum() or p[i + 2] == "(")
            out.append(r"(?:^|[^\pL\pN_])" if opens else r"(?:$|[^\pL\pN_])")
            i += 2
        else:
            out.append(p[i])
            i += 1
    text = "".join(out).replace("'", "''")
    return f"regexp_matches(text, '{'(?i)' if rule.ignore_case else ''}{text}')"


def screen_sql(table, ids, rules, terms):
    whens = [("text IS NULL OR NOT regexp_matches(text, '\\S')", "empty", "empty")]
    whens += [(_portable(r), r.verdict, r.rule_id) for r in rules]
    if terms:
        whens.append(("NOT (" + " OR ".join(f"contains(lower(text), '{w}')" for w in terms) + ")",
                      "off_topic", "no_scope_term"))
    verdict = " ".join(f"WHEN {w} THEN '{v}'" for w, v, _ in whens)
    rule = " ".join(f"WHEN {w} THEN '{r}'" for w, _, r in whens)
    return (f"SELECT {ids}, CASE {verdict} ELSE 'allowed' END AS verdict, "
            f"CASE {rule} END AS rule_id FROM {table}")


@query("scope_screen_conversations",
       screen_sql("conversations", "conv_id, turn", SCOPE_RULES, SCOPE_TERMS))
def _(t):
    return scope_screen(t.conversations).select("conv_id", "turn", "verdict", "rule_id")


DOCUMENT_RULES = (
    Rule("secret", "secret", r"\btoken = \"[0-9a-f]{40}\""),
    Rule("email", "personal", r"[a-z0-9.]+@[a-z0-9.]+\.com"),
    Rule("phone", "personal", r"\+1 \(\d{3}\) \d{3}-\d{4}"),
    Rule("card", "personal", r"\b\d{16}\b"),
    Rule("address", "personal", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"),
    Rule("licence", "licence", r"licensed under|released under the \w+ license"),
)


@query("scope_screen_documents", screen_sql("documents", "doc_id", DOCUMENT_RULES, ())
       .replace(r"\pN_])\d", r"\pN_])[0-9]"))
def _(t):
    return scope_screen(t.documents, rules=DOCUMENT_RULES, terms=()).select(
        "doc_id", "verdict", "rule_id")


# -- events ------------------------------------------------------------------


@query("json_props", """
SELECT event_id, CAST(props->>'k' AS BIGINT) AS k,
       '{"event_type":"' || event_type || '","k":' || (props->>'k') || '}' AS payload FROM events""")
def _(t):
    parsed = F.from_json("props", "k bigint")
    return t.events.select(
        "event_id", parsed["k"].alias("k"),
        F.to_json(F.struct("event_type", parsed["k"].alias("k"))).alias("payload"))


@query("event_counts", """
SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL""")
def _(t):
    return t.events.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"))
