"""Cases that plain test data don't show: large numbers, missing keys, sessions without settings,
sheets with header rows, streams in several micro-batches."""

import posixpath

import pytest
from pyspark.sql import functions as F

from factloom.operators import aggregates as A
from factloom.operators import melt as M
from factloom.operators.quota import quota_flags
from factloom.plans import facts as facts_of
from factloom.plans import stats as S
from factloom.schema import ACTION_PREFIXES
from factloom.sources import shared
from factloom.sources.snapshots import SnapshotStore
from factloom.sources.tables import Tables
from factloom.sources.wide import read_sheet, sheet_headers
from factloom.streaming.quota import quota_stream

PATH = "/root/testdata/sf0.001"


@pytest.mark.parametrize("base", [0.0, 1e6, 1e8, 1e9, 1e12])
def test_correlation_of_large_values(spark, base):
    """The same pattern at any height has the same coefficient."""
    x, y = [3, 1, 4, 1, 5, 9, 2, 6], [2, 7, 1, 8, 2, 8, 1, 8]
    pairs = [(base + float(a), base + float(b)) for a, b in zip(x, y)] + [(None, 1.0), (base, None)]
    df = spark.createDataFrame(pairs, "x double, y double").repartition(4)
    n, mx, my = len(x), sum(x) / len(x), sum(y) / len(y)
    sxy = sum((a - mx) * (b - my) for a, b in zip(x, y))
    r = sxy / (sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y)) ** 0.5
    assert n == 8 and df.agg(A.pearson(F.col("x"), F.col("y"))).first()[0] == pytest.approx(r, abs=6e-4)


def test_correlation_needs_two_values_that_differ(spark):
    def r(pairs):
        return spark.createDataFrame(pairs, "x double, y double").agg(A.pearson(F.col("x"), F.col("y"))).first()[0]

    assert r([(1.0, 2.0)]) is None and r([(1.0, 2.0), (1.0, 3.0)]) is None and r([(None, None)]) is None
    assert r([(1.0, 2.0), (2.0, 4.0)]) == 1.0 and r([(1.0, 2.0), (2.0, 1.0)]) == -1.0


def test_a_session_without_the_setting(spark, monkeypatch):
    """Intermediate tables then go below the warehouse; nothing is set, no local folder made."""
    monkeypatch.setattr(shared, "_setting", lambda session: None)
    folder = shared.shared_folder(spark)
    assert folder == posixpath.join(spark.conf.get("spark.sql.warehouse.dir"), "_factloom")
    assert shared.settled(spark.range(5), "numbers").count() == 5


def test_quota_keeps_every_event(spark):
    events = [(None, 0, 1), (None, 5, 2), ("a", None, 3), (None, None, 4), ("a", 5, 5), (None, 9, 6), ("a", None, 7)]
    df = spark.createDataFrame([(k, None if t is None else t * 1_000_000, i) for k, t, i in events], "k string, t bigint, id bigint")
    got = {r["id"]: (r["window_start"], r["n_in_window"], r["allowed"], r["remaining"], r["retry_after"])
           for r in quota_flags(df, "k", F.col("t"), "id", 2, 60.0).collect()}
    assert got == {1: (0, 1, True, 1, 0.0), 2: (0, 2, True, 0, 0.0), 6: (0, 3, False, 0, 51.0), 5: (5_000_000, 1, True, 1, 0.0),
                   3: (None,) * 5, 4: (None,) * 5, 7: (None,) * 5}


def test_line_items_are_read_once(spark, monkeypatch):
    """A catalogue's facts come from counters that are written once; no later plan reads orders
    or line items again."""
    seen = []
    plain = facts_of.settled
    monkeypatch.setattr(facts_of, "settled", lambda df, name: seen.append(plan(df)) or plain(df, name))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()

    facts = facts_of.build_facts(Tables(spark, PATH), levels=("fy",), headline=True, buckets=("total",))
    pins = S.Pins("1995-96", 1, "1995-96", ("1994-95", "1995-96"))
    export = S.export_all(facts, pins)
    assert len(seen) == 1 and "l_shipdate" in seen[0]
    assert "l_shipdate" not in plan(export) and "o_orderdate" not in plan(export)


def test_known_facts_leave_nothing_behind(spark, fact_table, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    facts = fact_table(("A", "2020-21", None, "received", "total", 3))
    one = store.write(facts, "y", "fy", ["f"], "1")
    before = {str(p) for p in tmp_path.rglob("*")}
    assert store.write(facts, "y", "fy", ["f"], "1") == type(one)(one.dataset_id, 0, one.content_digest)
    assert {str(p) for p in tmp_path.rglob("*")} == before


SHEET = """Agency,Granted in full,,,Access refused (no.),,,Granted in full %
Agency name,12114,12114,12114,Personal,Other,Total,1
,1,2,3,4,5,6,7
Alpha,"1,000",2,"1,002",0,1,1,99
 Beta ,No data,5,5,,,,98

x a note,7,7,7,7,7,7,7
Total,8,8,8,8,8,8,8
Short,1
"""


def test_sheets_as_they_come(spark, tmp_path):
    """Header rows, numbers in them too, are no data; columns are found by place or by header."""
    (tmp_path / "a.csv").write_text(SHEET)
    path = str(tmp_path / "a.csv")
    assert sheet_headers(spark, path)[:5] == ["Agency", "Granted in full", "c2", "c3", "Access refused (no.)"]

    def cells(sheet, name, melt, **how):
        rows = M.drop_total_rows(M.drop_note_rows(sheet, name), name)
        return {(r[name], r["measure"], r["bucket"]): r["value"] for r in melt(rows, [name], **how).collect()}

    by_header = cells(read_sheet(spark, path, by_header=True), "Agency", M.melt_by_header, prefixes=ACTION_PREFIXES)
    assert {n for n, *_ in by_header} == {"Alpha", "Beta", "Short"}
    assert by_header["Alpha", "granted_full", "total"] == 1002 and by_header["Alpha", "refused", "other"] == 1
    assert by_header["Beta", "granted_full", "personal"] is None and by_header["Short", "refused", "total"] is None
    by_place = cells(read_sheet(spark, path, width=8), "c0", M.melt_positional, triples={"granted_full": (1, 2, 3)}, on_bad="zero")
    assert sum(by_place.values()) == 1000 + 2 + 1002 + 0 + 5 + 5 + 1


def test_quota_over_several_batches(spark, tmp_path):
    """A stream counts a late event in the window that is open when it comes; the batch
    operator, which sees all events in order, in its own."""
    events = spark.createDataFrame([("a", 10, 1), ("a", 100, 2), ("a", 30, 3), ("a", 105, 4)], "k string, t bigint, id bigint")
    source, second = str(tmp_path / "in"), 1_000_000
    micros = F.col("t") * second
    for part in ([1, 2], [3, 4]):
        events.filter(F.col("id").isin(part)).coalesce(1).write.mode("append").parquet(source)
        stream = quota_stream(spark.readStream.schema(events.schema).parquet(source), "k", micros, "id", 2, 60.0)
        (stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
         .trigger(availableNow=True).start().awaitTermination())
    late = {r["id"]: (r["window_start"] // second, r["n_in_window"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert late == {1: (10, 1), 2: (100, 1), 3: (100, 2), 4: (100, 3)}
    batch = {r["id"]: (r["window_start"] // second, r["n_in_window"]) for r in quota_flags(events, "k", micros, "id", 2, 60.0).collect()}
    assert batch == {1: (10, 1), 3: (10, 2), 2: (100, 1), 4: (100, 2)}
