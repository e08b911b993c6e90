import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from factloom.functions.periods import epoch_micros
from factloom.sources.ledger import ledger_append
from factloom.streaming import quota
from factloom.streaming.ledger import ledger_stream
from factloom.streaming.quota import BUCKETS, quota_stream

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def flagged(spark, tmp_path):
    """Flags of micro-batches of (key, second, id), and each batch's state rows."""

    def run(batches, limit=2, window=60.0, delay="10 seconds"):
        log = str(tmp_path / "log")
        for batch in batches:
            rows = [(i, None if s is None else DAY + dt.timedelta(seconds=s), k) for k, s, i in batch]
            ledger_append(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, artifact_id long").coalesce(1), log)
        stream = ledger_stream(spark, log, max_files=1)
        flags = quota_stream(stream, "artifact_id", epoch_micros(F.col("ts")), "event_id", limit, window, delay)
        made = flags.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(
            availableNow=True).start()
        made.awaitTermination()
        progress = [p.stateOperators[0].numRowsTotal for p in made.recentProgress]
        zero = int((DAY - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
        got = {r.event_id: (r.artifact_id, None if r.window_start is None else (r.window_start - zero) / 1e6, r.n_in_window, r.allowed)
               for r in spark.read.schema(flags.schema).parquet(str(tmp_path / "out")).collect()}
        return got, progress

    return run


def test_three_batches_with_a_late_event(flagged):
    got, state = flagged([[(1, 0, 10), (1, 59, 11), (2, 5, 12), (None, 1, 13), (1, None, 14)],
                          [(1, 30, 20), (1, 60, 21), (2, 200, 22), (None, 2, 23)],
                          [(1, 61, 30), (2, 199, 31), (2, 190, 32), (3, 20, 33), (3, 500, 34)]])
    assert got == {10: (1, 0, 1, True), 11: (1, 0, 2, True), 12: (2, 5, 1, True), 13: (None, 1, 1, True), 14: (1, None, None, None),
                   20: (1, 0, 3, False), 21: (1, 60, 1, True), 22: (2, 200, 1, True), 23: (None, 1, 2, True),
                   30: (1, 60, 2, True), 32: (2, 200, 2, True), 31: (2, 200, 3, False), 33: (3, 20, 1, True), 34: (3, 500, 1, True)}
    assert max(state) > state[-1]  # only what is open at second 490 is left


def test_state_goes_with_its_window(flagged):
    got, state = flagged([[(k, k % 50, k) for k in range(200)], [(1000, 1000, 1000)], [(1000, 2000, 1001)], [(5, 7, 1002)]])
    assert state[0] >= 200 and state[-1] <= 4
    assert got[1002] == (5, 7, 1, True)  # its window is long gone, the event isn't
    assert len(got) == 203


def test_many_rows_of_one_key(spark, flagged):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        got, _ = flagged([[(7, i, i) for i in range(100)], [(7, i, i) for i in range(100, 150)]], limit=5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {i: g[1:] for i, g in got.items()} == {i: (i // 60 * 60, i % 60 + 1, i % 60 < 5) for i in range(150)}


def test_python_is_called_for_buckets(spark, tmp_path):
    """Keys share a call and its timer: a few thousand of them don't need as many."""
    spark.range(3 * BUCKETS).selectExpr("id event_id", "timestamp_ntz'2024-01-01' ts", "id artifact_id").coalesce(1).write.json(str(tmp_path / "log"))
    flags = quota_stream(ledger_stream(spark, str(tmp_path / "log")), "artifact_id", epoch_micros(F.col("ts")), "event_id", 2, 60.0)
    made = flags.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(
        availableNow=True).start()
    made.awaitTermination()
    first = made.recentProgress[0].stateOperators[0]
    assert first.numRowsTotal == 3 * BUCKETS and first.customMetrics["numRegisteredTimers"] <= BUCKETS
    assert spark.read.parquet(str(tmp_path / "out")).filter("n_in_window = 1 AND allowed").count() == 3 * BUCKETS


def test_large_numbers_among_missing_ones(flagged):
    """Neighbours above 2^53 stay apart, and a NULL key's events are in time order like any other's."""
    k, i = 2**53 + 1, 2**60 + 1
    got, _ = flagged([[(k, 1, i), (k - 1, 2, i + 1), (None, 9, i + 2), (0, 3, i + 3), (None, 4, i + 4), (k, None, i + 5)],
                      [(k, 5, 1), (None, 6, 2), (0, 7, 3)]])
    assert got == {i: (k, 1, 1, True), i + 1: (k - 1, 2, 1, True), i + 2: (None, 4, 2, True), i + 3: (0, 3, 1, True), i + 4: (None, 4, 1, True),
                   i + 5: (k, None, None, None), 1: (k, 1, 2, True), 2: (None, 4, 3, False), 3: (0, 3, 2, True)}


def test_many_keys_against_a_plain_walk(flagged):
    """Late events, windows that end as the watermark comes, and many keys of a bucket."""
    pick = random.Random(5)
    batches = [[(pick.randrange(5000), 35 * b + pick.randrange(-100 if i % 3 == 0 else 0, 70), 10_000 * b + i) for i in range(7000)] for b in range(5)]
    want, state, seen = {}, {}, []
    for batch in batches:
        mark = max(seen, default=-1000) - 10
        for k, t, i in sorted(batch):
            start, n = state.get(k, (None, 0))
            start, n = (t, 1) if start is None or t - start >= 60 else (start, n + 1)
            state[k] = start, n
            want[i] = k, start, n, n <= 2
        state = {k: v for k, v in state.items() if v[0] + 60 > mark}
        seen += [t for _, t, _ in batch]
    got, _ = flagged(batches)
    assert got == want


def test_only_busy_keys_are_walked_in_pieces(monkeypatch):
    monkeypatch.setattr(quota, "HELD_ROWS", 40)
    monkeypatch.setattr(quota, "BUSY_ROWS", 20)
    rows = pd.DataFrame({"k": [7, 7, 7, 1, 2, 0, 7, 7, 0, 3] * 20, "missing": [0, 0, 0, 0, 0, 0, 0, 0, quota.NO_KEY, 0] * 20, "t": range(200)})
    pieces = list(quota._pieces(rows.iloc[i:i + 10] for i in range(0, 200, 10)))
    assert sum(map(len, pieces)) == 200 and max(map(len, pieces)) <= 140 and len(pieces) > 2
    homes = {}
    for n, piece in enumerate(pieces):
        for name, own in piece.groupby(["k", "missing"])["t"]:
            assert own.is_monotonic_increasing and own.min() > max(homes.get(name, [(0, -1)]))[1]
            homes.setdefault(name, []).append((n, own.max()))
    assert len(homes[7, 0]) > 1 and all(len(homes[k]) <= 1 for k in homes if k != (7, 0))
    assert set(homes) == {(7, 0), (1, 0), (2, 0), (3, 0), (0, 0), (0, quota.NO_KEY)}
