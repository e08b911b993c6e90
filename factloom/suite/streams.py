"""Quota flags and the streaming jobs, each held against its batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions.periods import epoch_micros
from factloom.operators.quota import quota_flags
from factloom.sources.ledger import ledger_append
from factloom.sources.shared import fresh_path
from factloom.streaming.ledger import OnceTable, append_once, ledger_stream, windowed_counts, write_stream
from factloom.streaming.quota import quota_stream
from factloom.suite.ledger import _LEDGER, ledger_events
from factloom.suite.registry import query

LIMIT, WINDOW = 3, 86_400

_FOLD = f"""WITH RECURSIVE ranked AS (
  SELECT event_id, user_id, epoch_us(ts) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
fold AS (
  SELECT event_id, user_id, t, rn, t AS window_start, CAST(1 AS BIGINT) AS n_in_window
  FROM ranked WHERE rn = 1
  UNION ALL
  SELECT r.event_id, r.user_id, r.t, r.rn,
         CASE WHEN r.t - f.window_start >= {WINDOW}000000 THEN r.t ELSE f.window_start END,
         CASE WHEN r.t - f.window_start >= {WINDOW}000000 THEN 1 ELSE f.n_in_window + 1 END
  FROM fold f JOIN ranked r ON r.user_id = f.user_id AND r.rn = f.rn + 1)"""


# some events have no key, some no time; those without a key are one key
_HOLES = "SELECT event_id, CASE WHEN event_id % 50 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 11 <> 0 THEN ts END AS ts FROM events"


@query("quota_flags", f"""{_FOLD.replace('FROM events', f'FROM ({_HOLES}) WHERE ts IS NOT NULL').replace('r.user_id = f.user_id', 'r.user_id IS NOT DISTINCT FROM f.user_id')}
SELECT event_id, user_id, NULL AS window_start, NULL AS n_in_window, NULL AS allowed, NULL AS remaining,
       NULL AS retry_after FROM ({_HOLES}) WHERE ts IS NULL
UNION ALL SELECT event_id, user_id, window_start, n_in_window, n_in_window <= {LIMIT} AS allowed,
       CASE WHEN n_in_window <= {LIMIT} THEN {LIMIT} - n_in_window ELSE 0 END AS remaining,
       CASE WHEN n_in_window <= {LIMIT} THEN 0
            ELSE (window_start + {WINDOW}000000 - t) / 1e6 END AS retry_after FROM fold""")
def _(t):
    events = t.events.select("event_id", F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("user_id"),
                             F.when(F.col("event_id") % 11 != 0, F.col("ts")).alias("ts"))
    flags = quota_flags(events, "user_id", epoch_micros(F.col("ts")), "event_id", LIMIT, WINDOW)
    return flags.drop("ts")


def _logged(t):
    path = fresh_path(t.spark, "log")
    ledger_append(ledger_events(t), path)
    return path


def _drained(t, stream, schema_like):
    """Run a stream over everything that is there and read its sink."""
    sink = fresh_path(t.spark, "sink")
    write_stream(stream, sink, fresh_path(t.spark, "progress")).awaitTermination()
    return t.spark.read.schema(schema_like.schema).parquet(sink)


@query("ledger_stream", f"WITH {_LEDGER} SELECT * FROM ledger")
def _(t):
    stream = ledger_stream(t.spark, _logged(t))
    return _drained(t, stream, stream)


@query("ledger_stream_once", f"WITH {_LEDGER} SELECT * FROM ledger")
def _(t):
    """The log in several micro-batches; then one of them again, as after a failure, and a batch that failed before its commit."""
    log, place = fresh_path(t.spark, "log"), fresh_path(t.spark, "once")
    ledger_append(ledger_events(t).repartition(6), log)
    stream = ledger_stream(t.spark, log, max_files=2)
    table = OnceTable(t.spark, place, stream.schema)
    append_once(stream, table, fresh_path(t.spark, "progress")).awaitTermination()
    again = t.spark.read.schema(stream.schema).json(log)
    assert not table.append(again, 1)
    again.write.parquet(f"{place}/data/_folder=lost")
    return table.read()


@query("event_counts_stream", """
SELECT epoch_us(date_trunc('day', ts)) AS window_start, event_type AS op, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY
      <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY ALL""")
def _(t):
    counts = windowed_counts(ledger_stream(t.spark, _logged(t)))
    return _drained(t, counts, counts)


# Three micro-batches by date; some events come one batch late.  Of a key's state nothing is left when the
# watermark of the batch before (an hour behind what was seen until then) has passed its window.
_BATCH = """least(3, CASE WHEN ts < DATE '2024-01-11' THEN 1 WHEN ts < DATE '2024-01-21' THEN 2 ELSE 3 END
  + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END)"""
FILES_PER_BATCH = 8


@query("quota_stream", f"""WITH RECURSIVE batched AS (
  SELECT event_id, user_id, epoch_us(ts) AS t, {_BATCH} AS batch FROM events),
marks AS (SELECT b, coalesce((SELECT max(t) // 1000 - 3600000 FROM batched WHERE batch < b), 0) AS mark FROM range(0, 4) x(b)),
ranked AS (SELECT batched.*, mark, row_number() OVER (PARTITION BY user_id ORDER BY batch, t, event_id) AS rn
  FROM batched JOIN marks ON b = batch - 1),
fold AS (
  SELECT event_id, user_id, batch, rn, t AS window_start, CAST(1 AS BIGINT) AS n_in_window FROM ranked WHERE rn = 1
  UNION ALL
  SELECT event_id, user_id, batch, rn, CASE WHEN fresh THEN t ELSE window_start END, CASE WHEN fresh THEN 1 ELSE n_in_window + 1 END
  FROM (SELECT r.event_id, r.user_id, r.batch, r.rn, r.t, f.window_start, f.n_in_window,
               r.t - f.window_start >= {WINDOW}000000
               OR r.batch > f.batch AND r.mark >= -((-(f.window_start + {WINDOW}000000)) // 1000) AS fresh
        FROM fold f JOIN ranked r ON r.user_id = f.user_id AND r.rn = f.rn + 1))
SELECT event_id, user_id AS artifact_id, window_start, n_in_window, n_in_window <= {LIMIT} AS allowed FROM fold""")
def _(t):
    log = fresh_path(t.spark, "log")
    events = ledger_events(t)
    for batch in (1, 2, 3):
        ledger_append(events.filter(F.expr(_BATCH) == batch).repartition(FILES_PER_BATCH), log)
    stream = ledger_stream(t.spark, log, max_files=FILES_PER_BATCH)
    flags = quota_stream(stream, "artifact_id", epoch_micros(F.col("ts")), "event_id", LIMIT, WINDOW)
    return _drained(t, flags, flags)
