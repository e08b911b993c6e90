import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.quota import quota_flags

SECOND = 1_000_000


def brute(events, limit, window):
    out, state = {}, {}
    for key, t, i in sorted(events):
        start, count = state.get(key, (None, 0))
        if start is None or t - start >= window:
            start, count = t, 0
        count += 1
        state[key] = (start, count)
        out[i] = (start, count, count <= limit, max(limit - count, 0))
    return out


def flags(spark, events, limit, seconds, per_chunk):
    df = spark.createDataFrame(events, "k string, t bigint, id bigint")
    out = quota_flags(df, "k", F.col("t"), "id", limit, seconds, per_chunk)
    return {r["id"]: (r["window_start"], r["n_in_window"], r["allowed"], r["remaining"])
            for r in out.collect()}


def regular(n):
    """One key, evenly spaced: no pause ever resets the chain."""
    return [("hot", 3_000_000 + i * 7_000_000, i) for i in range(n)]


def mixed(seed, n):
    rng, out, t = random.Random(seed), [], 0
    for i in range(n):
        t += rng.choice([0, 1, SECOND, 4 * SECOND, 9 * SECOND, 10 * SECOND, 25 * SECOND])
        out.append((rng.choice(["hot", "hot", "hot", "a", "b"]), t, i))
    return out


@pytest.mark.parametrize("per_range", [25, 200, 1 << 20])
def test_dense_key_without_pauses(spark, per_range):
    events = regular(300)
    assert flags(spark, events, 2, 20.0, per_range) == brute(events, 2, 20 * SECOND)


@pytest.mark.parametrize("seed,per_range", [(1, 20), (2, 100), (3, 1 << 20)])
def test_random_timelines(spark, seed, per_range):
    events = mixed(seed, 400)
    assert flags(spark, events, 3, 10.0, per_range) == brute(events, 3, 10 * SECOND)


def test_one_window_over_many_ranges(spark, monkeypatch):
    """A key with a third of all events inside one window is worked on in many tasks."""
    from factloom.operators import quota

    kept = {}
    monkeypatch.setattr(quota, "settled", lambda df, name, real=quota.settled: kept.setdefault(name, real(df, name)) if name == "quota-ranges" else real(df, name))
    events = [("hot", 5 * SECOND + 7 * i, i) for i in range(400)] + [(f"k{i % 200}", i * SECOND, 1000 + i) for i in range(800)]
    assert flags(spark, events, 100, 60.0, 100) == brute(events, 100, 60 * SECOND)
    assert kept["quota-ranges"].filter("k.k = 'hot'").select("part").distinct().count() > 4


def test_window_edges(spark):
    seconds = [0, 10, 59, 60, 61, 200]
    events = [("k", s * SECOND, i) for i, s in enumerate(seconds)]
    out = flags(spark, events, 2, 60.0, 64)
    assert [out[i][1] for i in range(6)] == [1, 2, 3, 1, 2, 1]
    assert [out[i][2] for i in range(6)] == [True, True, False, True, True, True]
    with pytest.raises(ValueError):
        flags(spark, events, 2, 0.0, 64)


def test_given_table_in_small_ranges(spark):
    """Many ranges of the events table agree with one."""
    from factloom.functions.periods import epoch_micros

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    runs = [
        {tuple(r) for r in quota_flags(
            events, "user_id", epoch_micros(F.col("ts")), "event_id", 3, 86_400.0, n).select(
            "event_id", "window_start", "n_in_window").collect()}
        for n in (100, 1 << 20)]
    assert runs[0] == runs[1]
