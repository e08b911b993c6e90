import datetime as dt

import pytest
from pyspark.sql import functions as F

from factloom.operators.aggregates import distinct_entities, period_change
from factloom.operators.citations import resolve_pointers
from factloom.operators.quality import GateError, row_diff
from factloom.plans import stats as S
from factloom.schema import ARTIFACTS, FACT_COLUMNS, TOOL_CALLS
from factloom.sources.checked import CheckedTables, Parent
from factloom.sources.digest_tree import DigestTree, depth_for
from factloom.sources.ledger import EVENTS, ledger_append
from factloom.sources.wide import sheet_headers, union_periods
from factloom.streaming.ledger import OnceTable, append_once, ledger_stream

# -- digest tree ---------------------------------------------------------------


@pytest.fixture
def entities(fact_table):
    return fact_table(*[(f"E{i}", fy, q, "received", "total", i) for i in range(60) for fy in ("2021-22", "2022-23") for q in (None, 1)]).select(*FACT_COLUMNS)


def tree(rows, tmp_path, name, depth=2):
    return DigestTree.build(rows, str(tmp_path / name), depth)


def test_one_tampered_row_is_found_in_its_leaf(entities, tmp_path):
    whole = tree(entities, tmp_path, "a")
    odd = (F.col("entity_name") == "E7") & F.col("quarter").isNull() & (F.col("fy") == "2021-22")
    other = tree(entities.withColumn("value", F.when(odd, 99.0).otherwise(F.col("value"))), tmp_path, "b")
    assert len(whole.differing(other)) == 1
    found = whole.differences(other)
    assert sorted((r["entity_name"], r["quarter"], r["value"], r["surplus"]) for r in found.collect()) == [("E7", None, 7.0, 1), ("E7", None, 99.0, -1)]
    leaves = {f.split("_leaf=")[1].split("/")[0] for f in found.inputFiles()}
    assert len(leaves) == 1  # all other leaves stay closed


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_any_difference(entities, tmp_path, depth):
    whole = tree(entities, tmp_path, "a", depth)
    assert whole.differing(whole) == [] and whole.differences(whole).count() == 0
    fewer = entities.filter("entity_name NOT IN ('E1', 'E2', 'E30')")
    twice = entities.unionByName(entities.filter("entity_name = 'E5'"))
    for i, rows in enumerate((fewer, twice, entities.limit(0), entities.withColumn("fy", F.lit(None).cast("string")))):
        other = tree(rows, tmp_path, f"b{i}", depth)
        want = sorted(map(str, row_diff(entities, rows).collect()))
        assert sorted(map(str, whole.differences(other).collect())) == want
        assert sorted(r["surplus"] for r in other.differences(whole).collect()) == sorted(-r["surplus"] for r in whole.differences(other).collect())
    nodes = [whole.nodes(i).agg(F.sum("n"), F.sum("h0")).first() for i in range(depth + 1)]
    assert len(set(nodes)) == 1 and nodes[0][0] == 240


def test_depths(entities, tmp_path):
    assert [depth_for(n, 100) for n in (0, 100, 101, 1600, 1601, 10 ** 9)] == [0, 0, 1, 1, 2, 4]
    with pytest.raises(ValueError):
        tree(entities, tmp_path, "a", 1).differing(tree(entities, tmp_path, "b", 2))
    with pytest.raises(ValueError):
        tree(entities, tmp_path, "c", 5)


# -- sketches ------------------------------------------------------------------


def test_entities_from_sketches(spark):
    rows = spark.range(30_000).select(
        F.concat(F.lit("E"), F.col("id") % 5000).alias("entity_name"), F.concat(F.lit("20"), 10 + F.col("id") % 7).alias("fy"), F.lit(None).cast("int").alias("quarter"),
        F.lit("received").alias("measure"), F.when(F.col("id") % 3 == 0, "personal").otherwise("total").alias("bucket"), F.lit(1.0).alias("value"),
        F.lit(False).alias("derived"), F.lit("fy").alias("window_mode"))
    rows = rows.unionByName(rows.limit(50).withColumn("entity_name", F.lit("Total")))
    cells = S.cell_summary(rows, digest=False, sketch=True)
    for where, by in (("true", ()), ("bucket = 'personal'", ()), ("true", ("fy",)), ("fy = '2011'", ("bucket",))):
        exact = {tuple(r)[:-1]: r[-1] for r in rows.filter(where).filter("entity_name <> 'Total'").groupBy(*by).agg(F.count_distinct("entity_name")).collect()}
        got = {tuple(r)[:-1]: r[-1] for r in S.entities_in(cells.filter(where), by).collect()}
        assert got.keys() == exact.keys() and all(abs(got[k] - n) <= 4 * S.SKETCH_ERROR * n + 1 for k, n in exact.items())
    assert S.entities_in(cells.filter("false")).first()[0] == 0
    near = distinct_entities(rows, approximate=True).first()[0]
    assert abs(near - 5000) <= 0.2 * 5000 and distinct_entities(rows).first()[0] == 5000


# -- checked appends -----------------------------------------------------------


def test_children_need_their_parents(spark, tmp_path):
    tables = CheckedTables(spark, str(tmp_path / "t"), 4)
    tables.declare("artifacts", ARTIFACTS, "artifact_id")
    tables.declare("tool_calls", TOOL_CALLS, "artifact_id")
    artifacts = spark.range(100).select(*[F.col("id").alias(f.name) if f.name == "artifact_id" else
                                          (F.lit(None if f.nullable else {"bigint": 1, "int": 1}.get(f.dataType.simpleString(), "2024-01-01")).cast(f.dataType).alias(f.name))
                                          for f in ARTIFACTS.fields])
    assert tables.append("artifacts", artifacts) == 100
    parents = {"artifact_id": Parent("artifacts", "artifact_id")}
    calls = spark.range(300).select((F.col("id") % 100).alias("artifact_id"), F.col("id").cast("int").alias("seq"), F.lit("t").alias("tool"), F.lit("o").alias("op"),
                                    F.lit("{}").alias("input_json"), F.lit("{}").alias("output_json"))
    assert tables.append("tool_calls", calls, parents) == 300
    with pytest.raises(GateError, match="100"):
        tables.append("tool_calls", calls.withColumn("artifact_id", F.col("artifact_id") + 1), parents)
    with pytest.raises(Exception, match="must not be null"):
        tables.append("tool_calls", calls.withColumn("tool", F.lit(None).cast("string")), parents)
    again = CheckedTables(spark, str(tmp_path / "t"), 4)
    assert again.read("tool_calls").count() == 300 and again.read("artifacts").count() == 100
    # the parents' side is read in its buckets: no exchange
    lost = tables.orphans(calls, "artifact_id", parents["artifact_id"])
    plan = lost._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1  # the batch's


# -- exactly once --------------------------------------------------------------


def test_a_replayed_batch_adds_nothing(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")
    for part in range(3):
        rows = [(part * 10 + i, dt.datetime(2024, 1, 1 + part), i) for i in range(10)]
        ledger_append(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, artifact_id long").coalesce(1), log)
    table = OnceTable(spark, str(tmp_path / "once"), EVENTS)
    assert table.read().count() == 0
    failed = []

    def fails_once(self, batch_id, folder, real=OnceTable._commit):
        if batch_id == 1 and not failed:
            failed.append(folder)
            raise RuntimeError("lost before the commit")
        real(self, batch_id, folder)

    monkeypatch.setattr(OnceTable, "_commit", fails_once)
    stream = ledger_stream(spark, log, max_files=1)
    with pytest.raises(Exception, match="lost before the commit"):
        append_once(stream, table, str(tmp_path / "at")).awaitTermination()
    assert failed and table.read().count() == 10  # what wasn't committed isn't read
    append_once(stream, table, str(tmp_path / "at")).awaitTermination()
    assert sorted(r["event_id"] for r in table.read().collect()) == list(range(30))
    assert not table.append(table.read(), 2) and table.read().count() == 30
    append_once(stream, table, str(tmp_path / "elsewhere")).awaitTermination()  # from the start
    assert table.read().count() == 30


# -- sheets --------------------------------------------------------------------


def test_periods_of_different_headers_in_one_scan(spark, tmp_path):
    sheets = {"2021-22": ("a dir", ["name", "x", "y"], ["A,1,2", "B,3"]), "2022-23": ("b", ["y", "name"], ["5,C", "", '"6,5","D d"']),
              "2023-24": ("c+%", ["name", "z", "x", "y"], ["E,7,8,9,10"])}
    paths, headers = {}, {}
    for fy, (place, names, lines) in sheets.items():
        folder = tmp_path / place
        folder.mkdir()
        (folder / "s.csv").write_text("\n".join(lines) + "\n")
        paths[fy], headers[fy] = str(folder), names
    single = tmp_path / "one.csv"
    single.write_text("F,1,1\n")
    paths["2024-25"], headers["2024-25"] = f"file:{single}", ["name", "x", "y"]
    made = union_periods(spark, paths, headers=headers)
    assert made.columns == ["name", "x", "y", "fy", "z"]
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    got = sorted(tuple(r) for r in made.select("fy", "name", "x", "y", "z").fillna("-").collect())
    assert got == [("2021-22", "A", "1", "2", "-"), ("2021-22", "B", "3", "-", "-"), ("2022-23", "C", "-", "5", "-"), ("2022-23", "D d", "-", "6,5", "-"),
                   ("2023-24", "E", "8", "9", "7"), ("2024-25", "F", "1", "1", "-")]
    placed = union_periods(spark, {fy: paths[fy] for fy in ("2021-22", "2022-23")}, 4)
    assert placed.columns == ["c0", "c1", "c2", "c3", "fy"] and placed.count() == 4
    with pytest.raises(ValueError):
        union_periods(spark, {})


def test_files_of_a_sheet_share_their_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Agency,Refused\nx,1\n")
    (tmp_path / "b.csv").write_text("Agency,Refused\ny,2\n")
    assert sheet_headers(spark, str(tmp_path)) == ["Agency", "Refused"]
    (tmp_path / "c.csv").write_text("Agency,Granted\ny,2\n")
    with pytest.raises(ValueError, match="different headers"):
        sheet_headers(spark, str(tmp_path))


# -- smaller repairs -----------------------------------------------------------


def test_a_gap_between_periods_has_no_change(fact_table, rows):
    facts = fact_table(("A", "2019-20", None, "received", "total", 10), ("A", "2021-22", None, "received", "total", 20), ("A", "2022-23", None, "received", "total", 15))
    assert rows(period_change(facts), "fy", "value", "previous", "change") == [
        ("2019-20", 10.0, None, None), ("2021-22", 20.0, None, None), ("2022-23", 15.0, 20.0, -5.0)]
    facts = fact_table(*[("A", fy, q, "received", "total", v) for fy, q, v in (("2019-20", 4, 1), ("2020-21", 1, 3), ("2020-21", 3, 4))])
    got = rows(period_change(facts, level="single_quarter"), "fy", "quarter", "previous", "change")
    assert got == [("2019-20", 4, None, None), ("2020-21", 1, 1.0, 2.0), ("2020-21", 3, None, None)]


def test_the_first_recorded_call_is_cited(spark):
    calls = spark.createDataFrame([(1, 1, "query_dataset", '{"n": 1}', 20), (1, 1, "query_dataset", '{"n": 2}', 10)],
                                  "artifact_id bigint, seq int, tool string, result string, ts int")
    pointer = spark.createDataFrame([(1, "0.1.0.n")], "artifact_id bigint, pointer string")
    assert resolve_pointers(pointer, calls, recorded="ts").first()["value"] == "2"
    assert resolve_pointers(pointer, calls).first()["value"] == "1"


def test_only_missing_operators_on_text_pass(monkeypatch):
    import builtins

    import __spark_entry__ as entry

    def without(name):
        def load(module, *args, real=builtins.__import__, **kw):
            if module in ("corpus_pipeline", "factloom.llm.queries"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(module, *args, **kw)

        monkeypatch.setattr(builtins, "__import__", load)

    without("factloom.llm")
    assert entry._llm() == ({}, {})
    monkeypatch.undo()
    without("numpy")
    with pytest.raises(ModuleNotFoundError):
        entry._llm()
